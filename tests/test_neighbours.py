"""Nearest vectors: exact answers against all products, recall of the lists alone, hot lists and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from touchline.operators import neighbours as N


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>, kind string, name string").repartition(3)


def made_up(seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    x = centre[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    rows = [(k, v.tolist(), "ab"[k % 2], f"n{k % 50}") for k, v in enumerate(x)]
    return rows + [(n, [0.0] * dim, "a", "zero"), (n + 1, None, "a", "none")]


def plain(queries, items, k, same=(), apart=None):
    out = set()
    for q in queries:
        if q[1] is None:
            continue
        found = []
        for i in items:
            if i[1] is None or any(q[c] != i[c] for c in same) or (apart is not None and q[apart] == i[apart]):
                continue
            a, b = np.array(q[1]), np.array(i[1])
            size = np.linalg.norm(a) * np.linalg.norm(b)
            found.append((-round(float(a @ b / size), 6) if size else 0.0, i[0]))
        out |= {(q[0], i, rank, s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("how", ["all", "within", "apart"])
@pytest.mark.parametrize("block", [N.BLOCK, 25])
def test_exact_answers(spark, monkeypatch, how, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = made_up(3)
    asked = [r for r in rows if r[0] % 7 == 0 or r[0] >= 400]
    more = {"all": {"apart": "id"}, "within": {"within": ["kind"], "apart": "id"}, "apart": {"apart": "name"}}[how]
    got = N.nearest(frame(spark, asked), frame(spark, rows), "id", "v", 4, probes=1, lists=12, **more).collect()
    want = plain(asked, rows, 4, [2] if how == "within" else [], {"apart": 3}.get(how, 0))
    near = lambda s: {(q, i, r, round(x, 4)) for q, i, r, x in s}
    assert near((r.query_id, r.item_id, r.rank_no, -r.similarity + 0.0) for r in got) == near(want)


def test_recall_of_the_lists_alone(spark):
    rows = [r for r in made_up(4, 900) if r[0] >= 300 and r[1]]
    df = frame(spark, rows)
    exact = N.nearest(df.filter(N.divisible("id", 10)), df, "id", "v", 5, apart="id")
    guess = N.nearest(df, df, "id", "v", 5, apart="id", exact=False)
    assert {r.query_id for r in guess.collect()} == {r[0] for r in rows}
    assert N.recall(guess, exact).first()["recall"] >= 0.9


def test_no_items(spark):
    df = frame(spark, made_up(5, 20))
    assert N.nearest(df, df.limit(0), "id", "v", 3).count() == 0
    assert N.nearest(df.limit(0), df, "id", "v", 3).count() == 0


@pytest.mark.parametrize("tile", [3])
def test_lists_are_looked_into_in_bundles_and_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N, "WIDE", 40)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "SAMPLE", 30)
    rows = made_up(5, 200)
    queries = [r for r in rows if r[0] % 7 == 0]
    got = N.nearest(frame(spark, queries), frame(spark, rows), "id", "v", 4, apart="name", probes=1)
    assert {(r["query_id"], r["item_id"], r["rank_no"], -r["similarity"]) for r in got.collect()} == plain(queries, rows, 4, apart=3)


def test_centroids_look_at_the_lowest_hashes_only(spark, monkeypatch):
    """The sample is the rows of the lowest hashes, and not every partition sends as many rows to the driver."""
    rows = frame(spark, made_up(6, 600))
    taken = []
    limit = type(rows).limit
    monkeypatch.setattr(type(rows), "limit", lambda self, n: taken.append(self.count()) or limit(self, n))
    monkeypatch.setattr(N, "SAMPLE", 100)
    few = N.centroids(rows, "id", "v", 5)
    assert few.shape == (5, 8) and 100 <= taken[0] < 200
    monkeypatch.setattr(N, "SAMPLE", 10**6)
    assert np.allclose(few, N.centroids(rows.join(limit(rows.filter("v IS NOT NULL").selectExpr("id", "xxhash64(id) AS h").orderBy("h", "id"), 100), "id"), "id", "v", 5))


def test_every_vector_asks(spark):
    import __spark_entry__ as entry
    from oracle import compare, connect

    folder = "/root/testdata/sf0.001"
    found = entry.queries()["T8_nearest"](spark, folder)
    asked = {r["vec_id"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()}
    assert {r["query_id"] for r in found.select("query_id").collect()} == asked
    compare(found, connect(folder), entry.oracle_sql()["T8_nearest"])


def test_vectors_are_not_sent_to_every_task(spark):
    x = np.random.default_rng(5).normal(size=(4000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        got = N.nearest(df, df, "id", "v", 2, apart="id", exact=False).count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == 8000
