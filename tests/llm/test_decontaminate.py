"""The positional index against a plain search."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from touchline.llm import decontaminate as dc


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(13, len(iw))
            if not n:
                continue
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    if item_id is not None:
                        ids.add(str(item_id))
        joined = ",".join(sorted(ids))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "Of", "é", "Ünder"]
    pick = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, pick(rng.choice([13, 14, 20, 40]))) for i in range(12)]
    items += [(50, "w1 w2 w3"), (51, "the"), (52, None), (53, " ,;"), (None, pick(15)), (3, pick(16)), (54, "w7 " * 20), (55, "w7 " * 30)]
    docs = []
    for i in range(80):
        text = pick(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            w = words(items[rng.randrange(len(items))][1])
            a = rng.randint(0, max(0, len(w) - 13))
            text += " - " + " ".join(w[a : a + rng.randint(11, 25)]).upper() + "! " + pick(rng.randint(0, 20))
        docs.append((i, text))
    docs += [(7, docs[7][1]), (None, docs[8][1]), (90, None), (91, ""), (92, "\x00\x01"), (93, "w7 " * 300), (94, "w1\tw2\nw3")]
    return docs, items


def test_against_a_plain_search(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, word string").selectExpr("*", "monotonically_increasing_id() as k")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = dc.contamination(df, "k", bench).drop("row").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    kept = dc.drop_contaminated(df.drop("k"), bench)
    assert kept.columns == ["doc_id", "text", "word"]
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])


def test_white_space_beyond_ascii(spark):
    """White space beyond ASCII is part of a word: alone, inside and at either end of one."""
    rng = random.Random(5)
    spaces = ["\u00a0", "\u3000", "\u0085", "\u2003", "\u202f", "\u2028"]
    vocabulary = [*spaces, *(f"w{s}w" for s in spaces), *(f"w{s}" for s in spaces), *(f"{s}w" for s in spaces), "w", "v"]
    pick = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, pick(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 30])] + [(50, "a \u00a0 b"), (51, "\u3000"), (52, "c d\u00a0e f g h i j k l m n"), (53, "p\u00a0 q r")]
    docs = [(i, pick(rng.randint(0, 40)) + " - " + items[rng.randrange(len(items))][1] + ". " + pick(rng.randint(0, 40))) for i in range(60)]
    docs += [(70, "a \u00a0 b"), (71, "x \u3000"), (72, "c d\u00a0e f g h i j k l m n o"), (73, "p q r"), (74, "a b"), (75, "c d e f g h i j k l m n")]
    for i in range(9):  # one word short of a window, with words that hold white space
        w = words(items[8][1])
        docs.append((80 + i, "x " + " ".join(w[i : i + 12]) + " y"))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "monotonically_increasing_id() as k")
    got = dc.contamination(df, "k", spark.createDataFrame(items, "item_id long, text string")).drop("row").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "monotonically_increasing_id() as k")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(df.limit(0), "k", bench).count() == 0
    none = dc.contamination(df, "k", bench.limit(0))
    assert none.count() == len(docs) and none.filter("n_hit > 0 or contaminated").count() == 0


def test_proximity(spark):
    item = " ".join(f"q{i}" for i in range(13))
    common = "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 "
    texts = [(1, f"{common} a q11 b q12"), (2, f"{common} q11 a b c d q12"), (3, f"{common} q11"), (4, common * 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "monotonically_increasing_id() as k").repartition(1)
    ids = {r.k: r.doc_id for r in df.collect()}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    near = {ids[r.row]: r.apart for r in dc.proximity_matches(df, "k", bench, 2).collect()}
    assert near == {1: 1}
    assert {ids[r.row]: r.apart for r in dc.proximity_matches(df, "k", bench, 4).collect()} == {1: 1, 2: 4}


def test_what_is_stored_of_a_long_item_grows_with_its_words(spark):
    words = [f"v{k}" for k in range(30000)]
    items = spark.createDataFrame([("long", " ".join(words)), ("short", "v5 v6")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[200:260]) + " y"), (2, " ".join(words)), (3, "v5 v6")], "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    got = {r.doc_id: (r.n_hit, r.n_items) for r in dc.contamination(docs, "row", items).collect()}
    assert got == {1: (60, 1), 2: (30000, 2), 3: (2, 1)}
