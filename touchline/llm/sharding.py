"""Sharding by extendible hashing.

A document's place is a bit string, the MD5 of its id and text; a shard is a prefix of it. All
documents start in the shard of the empty prefix; a shard above the byte limit that holds more than one
document is split on its next bit, and only such shards are. Several bits are looked at in a round:
sums of the prefixes below the oversized shards tell at which bit each of them falls under the limit.

Defined cases: a null text has 0 bytes; null ids and repeated rows are documents of their own. Rows that
agree in id and text, hence in every bit of the MD5, are told apart by bits of a hash of their row number
that follow, so a repeated row splits as well. A document above the limit stays alone in its shard.
An empty table has no shards. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import fresh_name, kept, numbered, table

#: Byte limit of a shard.
LIMIT = 1 << 20
#: Bits looked at in one round: an oversized shard has at most this power of two of sums.
ROUND = 12
HASH_BITS = 60


def placed(docs: DataFrame, row: str) -> DataFrame:
    """(row, doc_id, bytes, bits): the bit string holds the MD5's first 60 bits and 60 of the row number's hash."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    later = F.md5(F.col(row).cast("string"))
    bits = [F.lpad(F.conv(F.substring(h, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0") for h in (key, later)]
    return docs.select(F.col(row).alias("row"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.concat(*bits).alias("bits"))


def directory(rows: DataFrame, limit: int = LIMIT, bits_at_once: int = ROUND) -> tuple[DataFrame, int]:
    """(cell, shard, shard_bytes, shard_docs) and the cells' number of bits: the directory maps the
    first bits of every document to its shard's prefix. A shard above the limit has one document."""
    done: list[DataFrame] = []
    open_cells, depth = None, 0
    while depth < 2 * HASH_BITS:
        deeper = min(depth + bits_at_once, 2 * HASH_BITS)
        here = rows if open_cells is None else rows.join(open_cells, F.substring("bits", 1, depth) == F.col("open"), "left_semi")
        cells = here.groupBy(F.substring("bits", 1, deeper).alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        cells = kept(cells, "cells")
        prefixes = F.transform(F.sequence(F.lit(depth if depth == 0 else depth + 1), F.lit(deeper)), lambda d: F.substring(F.col("cell"), F.lit(1), d))
        spread = cells.select("cell", "b", "n", F.explode(prefixes).alias("shard"))
        sums = spread.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
        first = spread.join(fits, "shard").groupBy("cell").agg(F.min_by(F.struct("shard", "shard_bytes", "shard_docs"), F.length("shard")).alias("s"))
        settled = kept(cells.join(first, "cell", "left").select("cell", "s.*"), "directory")
        done.append(settled.filter("shard is not null"))
        over = settled.filter("shard is null").select(F.col("cell").alias("open"))
        depth, open_cells = deeper, over
        if over.isEmpty():
            break
    else:
        raise ValueError("rows could not be told apart")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, depth


def lookup(rows: DataFrame, cells: DataFrame, depth: int, bits_at_once: int = ROUND) -> DataFrame:
    """Join rows with ``bits`` to the directory: cells of each round's number of bits in turn."""
    widths = list(range(bits_at_once, depth + 1, bits_at_once)) or [depth]
    if widths[-1] != depth:
        widths.append(depth)
    out = rows
    names = ["shard", "shard_bytes", "shard_docs"]
    for k, w in enumerate(widths):
        part = cells.filter(F.length("cell") == w).select(F.col("cell").alias(f"__cell{k}"), F.struct(*names).alias(f"__s{k}"))
        out = out.join(part, F.substring("bits", 1, w) == F.col(f"__cell{k}"), "left").drop(f"__cell{k}")
    found = F.coalesce(*[F.col(f"__s{k}") for k in range(len(widths))])
    return out.withColumn("__s", found).select(*rows.columns, *[F.col("__s")[n].alias(n) for n in names])


def shards(docs: DataFrame, row: str, limit: int = LIMIT, bits_at_once: int = ROUND) -> DataFrame:
    """(row, doc_id, bytes, shard, depth, shard_bytes, shard_docs) of every document."""
    rows = kept(placed(docs, row), "places")
    cells, depth = directory(rows, limit, bits_at_once)
    return lookup(rows, cells, depth, bits_at_once).drop("bits").withColumn("depth", F.length("shard"))


def sharded_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents with the columns ``shard`` and ``shard_bytes``, in no order; :func:`write_shards`
    writes those of a shard together."""
    rows, row = numbered(docs)
    shard, size = fresh_name(docs.columns, "shard"), fresh_name(docs.columns, "shard_bytes")
    own = shards(rows, row, limit).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("shard_bytes").alias(size))
    return rows.join(own, row).select(*docs.columns, shard, size)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the documents as Parquet, a folder per shard."""
    out = sharded_documents(docs, limit)
    shard = out.columns[-2]
    out.repartition(shard).write.partitionBy(shard).parquet(path)


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return shards(docs, "row").drop("row")


def sharding_sql(limit: int = LIMIT, deepest: int = 24) -> str:
    """DuckDB SQL for tables whose shards have at most ``deepest`` bits."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
p AS (SELECT r, doc_id, bytes, k AS depth, h >> (60 - k) AS prefix FROM d, range({deepest + 1}) t(k)),
g AS (SELECT *, sum(bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs FROM p WINDOW w AS (PARTITION BY depth, prefix)),
f AS (SELECT * FROM g WHERE shard_bytes <= {limit} OR shard_docs = 1 QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM f
"""


OP1_SQL = sharding_sql()
