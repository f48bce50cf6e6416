"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact components.

Fingerprints are split into blocks; two that differ in at most ``bits`` bits agree on at least
``blocks - bits`` whole blocks, so every choice of that many blocks is a join key and each close
pair meets under at least one of them. Rows with equal fingerprints are folded before the join.

Defined cases: a null text, or one without a word, has fingerprint zero and is linked like any other.
Repeated rows have one fingerprint and fall in one group. A row without doc_id takes part; a group's
id is the smallest doc_id in it, null only if no row of it has one. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import components, kept, numbered, table

SEED = 42


def fingerprint(text: str | None, words_in_shingle: int = 4) -> int:
    """Fingerprint of one text as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= words_in_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    first = [0, *(ends[:-1] + 1).tolist()]
    last = ends[words_in_shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first, last)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # a long text in pieces, so that its bits stay small
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, row: str, words_in_shingle: int = 4) -> DataFrame:
    """(row, doc_id, fp): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = [fingerprint(t, words_in_shingle) for t in pdf["t"]]
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "fp": np.array(fps, np.uint64).astype(np.int64)})

    slim = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("t"))
    out = slim.mapInPandas(run, f"row {docs.schema[row].dataType.simpleString()}, doc_id string, fp long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _block_masks(blocks: int, agree: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(own, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_edges(fps: DataFrame, bits: int = 4, blocks: int = 7, dense: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that keep every connected component whole.

    More ``blocks`` mean longer join keys, hence fewer chance meetings and more rows; 7 suit some
    hundred million texts. A bucket of up to ``dense`` fingerprints is searched breadth first inside
    one row and gives a spanning forest, not its pairs. Fingerprints of a larger bucket meet at
    midpoints instead: two at ``bits`` or fewer differing bits have a midpoint at ``bits / 2`` from both,
    and all fingerprints around one midpoint are linked to the smallest, which is exact and linear.
    """
    if bits % 2 or not 0 < bits < blocks:
        raise ValueError("bits must be even, positive and less than blocks")
    # a fingerprint becomes as many rows as there are choices, so the few bytes are dealt out first
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    masks = _block_masks(blocks, blocks - bits)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    entries = fps.select("fp", F.posexplode(keys).alias("choice", "key"))
    sizes = entries.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark sizes exploded rows as if there were one per fingerprint and would send them to every task
    shared = kept(entries.join(sizes.hint("merge"), ["choice", "key"]), "blocks")
    buckets = shared.filter(F.col("n") <= dense).groupBy("choice", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [], []
            for fps in pdf["fps"]:
                for x, y in _spanning(np.asarray(fps, np.int64).view(np.uint64), bits):
                    a.append(x)
                    b.append(y)
            yield pd.DataFrame({"a": np.array(a, np.uint64).astype(np.int64), "b": np.array(b, np.uint64).astype(np.int64)})

    near = buckets.select("fps").mapInPandas(forest, "a long, b long").distinct()
    flips = [0] + [_signed(sum(1 << i for i in c)) for r in range(1, bits // 2 + 1) for c in combinations(range(64), r)]
    points = (
        shared.filter(F.col("n") > dense).select("fp").distinct()
        .select("fp", F.explode(F.expr(f"array({','.join(f'{x}L' if x > -(1 << 63) else '-9223372036854775807L - 1L' for x in flips)})")).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    )
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    far = points.join(hubs.hint("merge"), "point").filter("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    return near.unionByName(far)


def _spanning(fps: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among a few fingerprints, each step against those left."""
    left = fps
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found, left = left[near], left[~near]
                frontier.extend(found)
                for y in found:
                    yield x, y


def near_duplicates(docs: DataFrame, row: str, bits: int = 4, blocks: int = 7, dense: int = 4096, words_in_shingle: int = 4) -> DataFrame:
    """(row, doc_id, fp, component_id): one row per document with the smallest doc_id reachable over
    links of at most ``bits`` differing bits. ``row`` numbers the rows of ``docs``."""
    fps = kept(fingerprints(docs, row, words_in_shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(close_edges(distinct.select("fp"), bits, blocks, dense)).withColumnRenamed("node", "fp")
    known = kept(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = known.join(ids, "root").select("fp", "component_id", "root")
    return fps.join(classes, "fp")


def keep_one(docs: DataFrame, bits: int = 4) -> DataFrame:
    """One document of every group: the one that gives the group its id, and of rows that repeat it, one.
    A group without any doc_id keeps its first row."""
    rows, row = numbered(docs)
    found = near_duplicates(rows, row, bits)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("m"))
    keep = first.select(F.col("m")["row"].alias(row))
    return rows.join(keep, row, "left_semi").select(*docs.columns)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    found = near_duplicates(docs, "row")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
