"""Similar words, search with corrections and mentions in texts, against plain loops."""

from __future__ import annotations

import random

import pytest

from touchline.operators import mentions as M


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 2 * common(a, b) / (len(a) + len(b))


def made_up(seed, n, letters="abc", longest=14):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("cutoff", [0.8, 0.88])
def test_similar_words_lose_no_pair(spark, cutoff):
    vocabulary = sorted(set(made_up(1, 150) + made_up(2, 6, "ab", 150) + ["x" * 70, "haaland", "odegaard"]))
    words = sorted(set(made_up(3, 200) + [v[:k] + v[k + 1 :] for v in vocabulary if len(v) > 40 for k in (0, 35, len(v) - 1)] + ["haland", "x" * 64, "odegard"]))
    v = spark.createDataFrame([(x,) for x in vocabulary], "v string")
    got = {(r.word, r.v): r.ratio for r in M.similar_words(spark.createDataFrame([(x,) for x in words], "word string"), v, cutoff).collect()}
    want = {(a, b): ratio(a, b) for a in words for b in vocabulary if ratio(a, b) >= cutoff - 1e-12}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_corrections_leave_known_words_and_beginnings(spark):
    v = spark.createDataFrame([("haaland",), ("salah",), ("son",)], "word string")
    w = spark.createDataFrame([(x,) for x in ("haland", "haal", "salah", "sallah", "sn", "zzzz")], "word string")
    assert {(r.word, r.corrected) for r in M.correct_typos(w, v).collect()} == {("haland", "haaland"), ("sallah", "salah")}


NAMES = [
    ("Conor Coventry", 1000040), ("Pierre Lees-Melou", 50), ("Martin Ødegaard", 1000700), ("N'Golo Kanté", 400), ("Mohamed Salah", 1001500),
    ("Erling Haaland", 1001000), ("Young", 10), ("Ashley Young", 300), ("Salah Salah", 1), ("Gabriel", 900), ("Gabriel Jesus", 800), ("Gabriel dos Santos Magalhães", 700),
]


def mentions_of(spark, *texts):
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    found = M.mentions(t, spark.createDataFrame(NAMES, "name string, popularity long"), "id").collect()
    return [[(r["at"], r.words, r.name, r.full_name) for r in sorted(found, key=lambda r: r["at"]) if r.id == k] for k in range(len(texts))]


def test_mentions_by_the_rule(spark):
    got = mentions_of(
        spark, "Is Martin Ødegaard (Arsenal) better than N'Golo Kanté?", "Salah or Haland?", "Salah's form: is Mohamed Salah worth it?", "Coventry City vs Leeds United",
        "?!", None, "", "good young players score goals", "Ashley Young or Young", "gabriel dos santos magalhaes, Gabriel Jesus and Gabriel", "mohamed salah mohamed salah",
    )
    assert got[0] == [(1, 2, "Martin Ødegaard", True), (6, 3, "N'Golo Kanté", True)]
    assert got[1] == [(0, 1, "Mohamed Salah", False), (2, 1, "Erling Haaland", False)]
    assert got[2] == [(0, 1, "Mohamed Salah", False), (4, 2, "Mohamed Salah", True)]
    assert got[3] == [(0, 1, "Conor Coventry", False), (3, 1, "Pierre Lees-Melou", False)]
    assert got[4] == got[5] == got[6] == []
    assert got[7] == [(1, 1, "Young", True)]  # a name of one word is a full name, a stop word on its own is none
    assert got[8] == [(0, 2, "Ashley Young", True)]  # the first "young" lies in it and later ones are stop words
    assert got[9] == [(0, 4, "Gabriel dos Santos Magalhães", True), (4, 2, "Gabriel Jesus", True), (7, 1, "Gabriel", False)]
    # of two names as long, the earlier one stays; what is left are single words
    assert got[10] == [(0, 2, "Mohamed Salah", True), (2, 1, "Mohamed Salah", False), (3, 1, "Mohamed Salah", False)]


def test_names_of_every_length_in_long_texts(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    names = [(" ".join(rnd.choice(words) for _ in range(k)), k) for k in range(1, 61)]
    texts = [(k, " ".join(rnd.choice(words) for _ in range(20000)) + " " + names[59 - k][0]) for k in range(20)]
    t = spark.createDataFrame(texts, "id int, text string").repartition(4)
    found = M.mentions(t, spark.createDataFrame(names, "name string, popularity long"), "id").filter("full_name").collect()
    assert {(r.id, r.form) for r in found if r.words >= 40} == {(k, names[59 - k][0]) for k in range(20)}


def test_names_in_order_of_appearance(spark):
    t = spark.createDataFrame([(1, "Haaland, Salah, Haaland and Kanté")], "id int, text string")
    found = M.mentions(t, spark.createDataFrame(NAMES, "name string, popularity long"), "id")
    assert [(r.rank_no, r.name) for r in M.mentioned_names(found, "id").orderBy("rank_no").collect()] == [(1, "Erling Haaland"), (2, "Mohamed Salah")]


def test_search_falls_back_to_the_corrected_query(spark):
    entries = spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate(NAMES)], "entry_id int, name string, popularity long")
    queries = spark.createDataFrame([(1, "haland"), (2, "erl haal"), (3, "mohamed sallah"), (4, "zzzz"), (5, "salah zzzz"), (6, "")], "query_id int, query string")
    got = {}
    for r in M.search(queries, entries).orderBy("query_id", "rank_no").collect():
        got.setdefault(r.query_id, []).append((r.name, r.tier, r.corrected))
    assert got[1] == [("Erling Haaland", 3, "haaland")]
    assert got[2] == [("Erling Haaland", 3, None)]
    assert got[3] == [("Mohamed Salah", 4, "mohamed salah")]
    assert 4 not in got and 6 not in got
    assert [x[0] for x in got[5]] == ["Mohamed Salah", "Salah Salah"] and all(x[1:] == (1, None) for x in got[5])
