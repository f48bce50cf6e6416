"""Extendible hashing: limits, splits and lookups against a plain recursion, and SQL with a small limit."""

from __future__ import annotations

import hashlib

import pytest
from oracle import compare, connect

from touchline.llm import sharding


def split(rows, limit, prefix=""):
    """Plain recursion over (bits, bytes)."""
    if not rows:
        return {}
    if sum(b for _, b in rows) <= limit or len(rows) == 1:
        return {prefix: sorted(rows)}
    d = len(prefix)
    return {k: v for bit in "01" for k, v in split([r for r in rows if r[0][d] == bit], limit, prefix + bit).items()}


@pytest.mark.parametrize("limit,at_once", [(40, 12), (7, 5), (10_000, 12)])
def test_shards(spark, limit, at_once):
    rows = [(i % 50 if i % 11 else None, "x" * (i % 13), "a") for i in range(120)] + [(3, "same words", "b")] * 9 + [(4, None, None), (4, "y" * 200, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    numbered = sharding.kept(df.selectExpr("*", "monotonically_increasing_id() as k"), "test")
    got = sharding.shards(numbered, "k", limit, at_once).collect()
    assert len(got) == len(rows)
    bits = {r.row: (r.bits, r.bytes) for r in sharding.placed(numbered, "k").collect()}
    want = split(list(bits.values()), limit)
    seen = {}
    for r in got:
        seen.setdefault(r.shard, []).append(bits[r.row])
        assert r.shard_bytes <= limit or r.shard_docs == 1
        assert r.depth == len(r.shard)
    assert {k: sorted(v) for k, v in seen.items()} == want
    out = sharding.sharded_documents(df, limit)
    assert out.columns == ["doc_id", "text", "shard", "shard_", "shard_bytes"] and out.count() == len(rows)


def test_bits():
    h = hashlib.md5(b"1:a").hexdigest()
    assert bin(int(h[:15], 16))[2:].zfill(60)[:8] == bin(int(h[:2], 16))[2:].zfill(8)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.sharded_documents(df).count() == 0


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * i) for i in range(30)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_sql_with_a_small_limit(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "monotonically_increasing_id() as k")
    compare(sharding.shards(docs, "k", 20_000).drop("row"), connect(folder), sharding.sharding_sql(20_000))
