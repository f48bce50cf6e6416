"""The mix: targets, quotas, disjoint blocks, and SQL on a table with nulls and repeats."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from oracle import compare
from pyspark.sql import functions as F

from touchline.llm import mixing


def frame(spark):
    rows = [(i, " ".join(["word"] * (i * 7 % 90)), f"s{i % 5}", 1) for i in range(300)]
    rows += [(i, "tiny text", "zz", 1) for i in range(300, 303)] + [(5, "again and again", "s1", 2)] * 4
    rows += [(None, "no id here", "s2", 1), (400, None, "s0", 1), (401, "a\tb\x0bc", None, 1), (402, "", "empty", 1), (403, "d e f", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_sql_and_bounds(spark):
    df = frame(spark).selectExpr("doc_id", "source", "text", "monotonically_increasing_id() as row")
    rows = mixing.kept(mixing.slim_rows(df, "row"), "test")
    mixed = mixing.kept(mixing.mix(rows, block_words=16, shards=4), "mixed")
    taken = F.aggregate("laps", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, r.text, r.source) for r in df.collect()], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    compare(mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken")), con, mixing.OP8_SQL)
    laps = mixed.join(rows.select("row", "source"), "row").select("source", "target", F.explode("laps").alias("lap")).select("source", "target", "lap.*").collect()
    by_block, per_shard = {}, {}
    for r in laps:
        assert by_block.setdefault((r.source, r.block), r.shard) == r.shard
    for s in by_block.values():
        per_shard[s] = per_shard.get(s, 0) + 1
    assert set(per_shard) <= set(range(4))
    words = {}
    for r in laps:
        words[r.source] = words.get(r.source, 0) + r.words
    for r in laps:
        assert abs(words[r.source] - r.target) <= 0.5


def test_draw(spark):
    quotas = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 1000, 37, 1])], "place long, blocks long")
    ends = {r.place: r.ends for r in mixing.shard_ends(quotas, 8).collect()}
    counts = {p: [b - a for a, b in zip([0, *e], e)] for p, e in ends.items()}
    assert {p: e[-1] for p, e in ends.items()} == {0: 5, 1: 0, 2: 1000, 3: 37, 4: 1}
    assert all(c >= 0 for row in counts.values() for c in row)
    columns = [sum(row[j] for row in counts.values()) for j in range(8)]
    assert max(columns) - min(columns) <= 1
    assert ends == {r.place: r.ends for r in mixing.shard_ends(quotas, 8).collect()}
    assert len({tuple(c) for c in counts.values()}) > 2
    with pytest.raises(ValueError):
        mixing.shard_ends(quotas, 6)


def test_draw_in_groups_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES_AT_ONCE", 3)
    quotas = spark.range(20).selectExpr("id as place", "id * 3 as blocks")
    ends = [r.ends for r in mixing.shard_ends(quotas, 4).collect()]
    counts = [[b - a for a, b in zip([0, *e], e)] for e in ends]
    columns = [sum(row[j] for row in counts) for j in range(4)]
    assert sum(columns) == 570 and max(columns) - min(columns) <= 1


def test_documents(spark):
    df = frame(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    times = {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(n for i, n in times.items() if i not in (5, None)) <= 2
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_registered_shards_follow_the_draw(spark):
    """The blocks of a source in a shard are as many as the tree drew, in the registered result."""
    folder = "/root/testdata/sf0.001"
    got = mixing.op8_mixing_shards(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "source", "text", "monotonically_increasing_id() as row")
    targets = mixing.source_targets(mixing.kept(mixing.slim_rows(docs, "row"), "test")).collect()
    quotas = spark.createDataFrame([(r.place, -(-int(r.target + 0.5) // mixing.BLOCK_WORDS)) for r in targets], "place long, blocks long")
    ends = {r.place: r.ends for r in mixing.shard_ends(quotas).collect()}
    most = {(r.source, j): b - a for r in targets for j, (a, b) in enumerate(zip([0, *ends[r.place]], ends[r.place]))}
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.shard), set()).add(r.block)
    assert blocks and all(len(b) <= most[k] for k, b in blocks.items())  # a block in which no document begins has no row
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
    assert taken == {r.doc_id: r.taken for r in mixing.op8_mixing(spark, folder).collect() if r.taken}


def test_documents_lie_shard_by_shard(spark):
    """The partitions of the mixed documents, one after the other, hold the shards in their order."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed_documents(df).select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    laps = mixing.op8_mixing_shards(spark, "/root/testdata/sf0.01").filter("2 * words >= size").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["at"])] == [r.doc_id for r in sorted(laps, key=lambda r: (r.shard, r.order))]


def test_a_mix_of_any_size_has_blocks_that_can_be_drawn(spark):
    assert mixing.words_of_a_block(10**6, 20) == mixing.BLOCK_WORDS
    words = [2 * 10**9 * mixing.BLOCK_WORDS, 5 * 10**15, 3, 0]
    size = mixing.words_of_a_block(sum(words), len(words))
    quotas = [-(-w // size) for w in words]
    assert sum(quotas) <= mixing.MOST_BLOCKS
    ends = {r.place: r.ends for r in mixing.shard_ends(spark.createDataFrame(list(enumerate(quotas)), "place long, blocks long"), 4).collect()}
    assert [ends[k][-1] for k in range(4)] == quotas
