"""Repeated passages: symbols, ranges and the operator against plain comparison of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect

from touchline.llm import recompression as R
from touchline.llm.queries import ORACLES, QUERIES


def plain(docs, window):
    """(doc_id, n_words, n_removed, sha) by comparing every window with every other."""
    words = [R.split_words(t) for _, t in docs]
    first = {}
    for (doc_id, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            known = first.get(key)
            first[key] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            least = first[tuple(w[i : i + window])]
            if least is not None and (doc_id is None or least < doc_id):
                gone.update(range(i, i + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def made_up(seed, n=40, letters="ab", unit=12):
    """Texts from few words, with runs, periods and passages in common."""
    rnd = random.Random(seed)
    pieces = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(1, 3 * unit))) for _ in range(8)]
    pieces += ["x " * rnd.randint(1, 3 * unit), "a b " * unit, "a b c " * unit]
    docs = [(i, " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 6)))) for i in range(n)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", [f"w{i}" for i in range(300)]])
def test_equal_windows_are_known_by_equal_symbols(letters):
    for seed in range(5):
        line = R.Line([R.split_words(t) for _, t in made_up(seed, letters=letters)])
        places, names = R.known_by(line, 20)
        seen = {}
        for p, n in zip(places.tolist(), names.tolist()):
            assert seen.setdefault(tuple(line.names[p : p + 20].tolist()), n) == n


def test_symbols_do_not_depend_on_the_documents_beside():
    docs = [R.split_words(t) for _, t in made_up(7, letters=[f"w{i}" for i in range(300)])] + [[b"a"], [], [b"q"] * 100]
    together = R.ranges(R.Line(docs), 20)
    for i, d in enumerate(docs):
        alone = R.ranges(R.Line([d]), 20)
        own = together["document"] == i
        assert all(together[c][own].tolist() == alone[c].tolist() for c in ("name", "content", "lo", "hi"))


def test_hash_of_words_does_not_depend_on_their_place():
    line = R.Line([R.split_words("q a b c d r a b c d"), R.split_words("a b c d")])
    h = line.hasher(0)(np.array([2, 7, 12, 1]), np.array([6, 11, 16, 5]))
    assert h[0] == h[1] == h[2] != h[3]


@pytest.mark.parametrize("seed", range(3))
def test_operator_against_plain_comparison(spark, seed):
    docs = made_up(seed) + made_up(seed + 100, n=20, letters=[f"w{i}" for i in range(50)])
    docs = [(i + (1000 if k >= 40 else 0), t) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows, row = R.numbered(df)
    got = R.repeated_words(rows, row, 20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, 20)
    assert any(r.n_removed for r in got)


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [
        (None, passage), (None, "own " + passage), (3, passage), (3, passage), (5, "before " + passage + " after"), (6, None), (7, ""), (8, " \t\n"),
        (9, passage + " "), (10, "run " * 5000 + passage), (11, "run " * 400), (2, " ".join(f"p{i}" for i in range(19))),
    ]
    df = spark.createDataFrame([(*d, "x", 1, "m") for d in docs], "doc_id long, text string, row_key string, key int, met string")
    rows, row = R.numbered(df)
    got = R.repeated_words(rows, row, 20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, 20)
    cut = R.without_repeats(df, 20)
    assert cut.columns == df.columns and cut.count() == len(docs)
    assert [r.text for r in cut.filter("doc_id = 5").collect()] == ["before after"]
    assert [r.text for r in cut.filter("doc_id = 8").collect()] == [" \t\n"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    rows, row = R.numbered(df)
    assert R.repeated_words(rows, row).count() == 0
    assert R.without_repeats(df).count() == 0


def test_whole_table_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    compare(QUERIES["op13_recompression"](spark, folder), connect(folder), ORACLES["op13_recompression"])


def test_only_a_stretch_of_a_batch_is_taken_apart_at_a_time(monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 10)
    batch = pa.RecordBatch.from_pydict({"n": [1, 2, 3, 4, 5], "t": ["aaaa", None, "bbbbbb", "é" * 8, "c"]})
    assert [c.column("n").to_pylist() for c in R.chunks(batch, "t")] == [[1, 2, 3], [4], [5]]
