"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents lie end to end, in an order given by a hash, on a line that is run twice; the
part of the line before the source's target is taken, so a document is taken at most twice. The line is
cut into blocks of ``block_words`` words. The tree halves the set of output shards again and again
and draws, at every node, how many of each source's blocks go to the left half, such that all shards
get equally many blocks; a shard then takes that many blocks of the source's permuted order, none twice,
and its documents are ordered by a second hash.

Defined cases: a null text has size 0 and is taken 0 times; null is a source of its own, the last; rows
that repeat are documents of their own; without words every target is 0. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import kept, numbered, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of a block, and most blocks of a mix: the draw takes below a billion. A larger mix has larger blocks.
BLOCK_WORDS, MOST_BLOCKS = 4096, 900_000_000
SHARDS = 16
#: Pieces of a source's line that are summed before they are laid end to end.
PIECES = 4096
#: Sources that one task of the draw holds.
SOURCES_AT_ONCE = 4096
#: Primes above any number of blocks of a source; one of them multiplies a block's number.
PRIMES = (1000000007, 1000000009, 1000000021, 1000000033)


def word_count(text: str = "text") -> F.Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def slim_rows(docs: DataFrame, row: str) -> DataFrame:
    """(row, doc_id, source, size, key, piece): what the mix needs of a document. ``key`` orders a source."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    piece = F.conv(F.substring("key", 1, 3), 16, 10).cast("int") * PIECES / 4096
    return docs.select(F.col(row).alias("row"), "doc_id", "source", word_count().alias("size"), key.alias("key")).withColumn("piece", piece.cast("int"))


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, place, source_size, target): words each source should give.

    Sources in code point order take the weights in turn. A target above ``most`` times its source's
    size stops there, and what is over is shared again by weight, round after round, until none is.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    ordered = kept(sizes.withColumn("at", F.monotonically_increasing_id()), "sources")  # rises with the source; consecutive within a part
    part = F.shiftright("at", 33)
    parts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row per file part
    place = (F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    listed = ordered.withColumn("part", part).join(ahead, "part").select("source", "source_size", place.alias("place"))
    turn = (F.col("place") % len(weights)).cast("int")
    weight = F.array(*[F.lit(w) for w in weights])[turn]
    listed = kept(listed.withColumn("weight", weight).withColumn("top", F.col("source_size") * most), "targets")
    level, full = -1.0, -1
    while True:
        is_full = F.col("top") < F.lit(level) * F.col("weight")
        got = listed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(is_full, F.col("top")).otherwise(0)).alias("used"),
            F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("open"), F.sum(is_full.cast("int")).alias("full"),
        ).first()
        if got["full"] == full or not got["open"]:
            break
        full, level = got["full"], (share * got["all"] - got["used"]) / got["open"]
    target = F.least(F.col("top").cast("double"), F.lit(max(level, 0.0)) * F.col("weight"))
    return listed.select("source", "place", "source_size", target.alias("target"))


def lines(rows: DataFrame) -> DataFrame:
    """The rows with ``start``: where a document begins on its source's line. A source is summed in
    pieces first, so a source that holds a third of all rows is ordered in many tasks."""
    sums = rows.groupBy("source", "piece").agg(F.sum("size").alias("in_piece"))
    earlier = sums.select("source", "piece", (F.sum("in_piece").over(Window.partitionBy("source").orderBy("piece")) - F.col("in_piece")).alias("before"))
    inside = Window.partitionBy("source", "piece").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = rows.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    same = ordered["source"].eqNullSafe(earlier["source"]) & (ordered["piece"] == earlier["piece"])
    return ordered.join(earlier, same).select(*[ordered[c] for c in rows.columns], (F.col("within") + F.col("before")).alias("start"))


def shard_ends(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(place, ends): per source, up to which permuted block each shard's draw goes.

    ``quotas`` has (place, blocks). The sources are drawn in two steps, groups of sources first, so a
    task holds ``SOURCES_AT_ONCE`` sources or one number per group.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")

    def split(counts: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A matrix of counts by color and shard, whose columns add up to ``sizes``."""
        if len(sizes) == 1:
            return counts[:, None]
        half = len(sizes) // 2
        left = rng.multivariate_hypergeometric(counts, int(sizes[:half].sum()), method="marginals")
        return np.hstack([split(left, sizes[:half], rng), split(counts - left, sizes[half:], rng)])

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        counts = pdf["blocks"].to_numpy(np.int64)
        total = int(counts.sum())
        if total >= 10**9:
            raise ValueError("the draw takes below a billion blocks")
        sizes = np.array([total * (i + 1) // shards - total * i // shards for i in range(shards)], np.int64)
        drawn = split(counts, sizes, np.random.default_rng([seed, 0]))
        return pd.DataFrame({"part": pdf["part"], "sizes": drawn.tolist()})

    def members(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        sizes = np.array(pdf["sizes"].iloc[0], np.int64)
        drawn = split(pdf["blocks"].to_numpy(np.int64), sizes, np.random.default_rng([seed, 1, int(key[0])]))
        return pd.DataFrame({"place": pdf["place"], "ends": drawn.cumsum(axis=1).tolist()})

    own = quotas.withColumn("part", F.floor(F.col("place") / SOURCES_AT_ONCE).cast("long"))
    parts = own.groupBy("part").agg(F.sum("blocks").alias("blocks")).withColumn("one", F.lit(0))
    sizes = parts.groupBy("one").applyInPandas(groups, "part long, sizes array<long>")
    return own.join(sizes, "part").groupBy("part").applyInPandas(members, "place long, ends array<long>")


def words_of_a_block(total: int, sources: int, least: int = BLOCK_WORDS) -> int:
    """So many words that a mix of ``total`` words has at most MOST_BLOCKS blocks, ends of sources included."""
    return max(least, -(-total // max(1, MOST_BLOCKS - sources)))


def dealt(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Rows of :func:`slim_rows` with source, source_size, target and ``laps``: for each of the two runs of the
    line, the words taken of the document, its block, its output shard and its order in the shard."""
    targets = source_targets(rows, weights, share).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    total, sources = targets.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    block_words = words_of_a_block(total, sources, block_words)
    targets = targets.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    ends = shard_ends(targets.select("place", "blocks"), shards, seed)
    plan = kept(targets.join(ends, "place"), "plan")
    prime = F.array(*[F.lit(p) for p in PRIMES])[F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(len(PRIMES))).cast("int")]
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "words", "blocks", "ends", prime.alias("prime"), F.pmod(F.xxhash64("place", F.lit(seed + 1)), F.greatest("blocks", F.lit(1))).alias("turn"))
    placed = lines(rows)
    placed = placed.join(plan, placed["source"].eqNullSafe(plan["plan_source"]))

    def lap(k: int) -> F.Column:
        start = F.col("start") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - start))
        block = F.floor(start / block_words).cast("long")
        place = (block * F.col("prime") + F.col("turn")) % F.greatest("blocks", F.lit(1))
        shard = F.size(F.filter("ends", lambda end: end <= place))
        taken = F.struct(F.lit(k).alias("lap"), words.cast("long").alias("words"), block.alias("block"), shard.alias("shard"), F.xxhash64("key", F.lit(k), F.lit(seed)).alias("order"))
        return F.when(words > 0, taken)

    laps = F.filter(F.array(*[lap(k) for k in range(MOST)]), lambda x: x.isNotNull())
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", laps.alias("laps"))


def mix(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """:func:`dealt` without the source."""
    return dealt(rows, weights, share, block_words, shards, seed).drop("source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents in the mix, each as often as it is taken, shard by shard in the order of the mix: a
    partition holds one shard or a piece of it that follows the piece in the partition before.
    A document that the target cuts counts as taken if at least half of its words are."""
    rows, row = numbered(docs)
    laps = mix(kept(slim_rows(rows, row), "sizes")).select(F.col("row").alias(row), "size", F.explode("laps").alias("lap"))
    shard, order = "mix_shard" + row, "mix_order" + row
    taken = laps.filter(2 * F.col("lap.words") >= F.col("size")).select(row, F.col("lap.shard").alias(shard), F.col("lap.order").alias(order))
    pieces = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    piece = F.shiftright((F.shiftright(order, 32) + F.lit(1 << 31)) * pieces, 32)  # the orders are hashes, so the pieces are alike
    mixed = rows.join(taken, row).repartitionById(SHARDS * pieces, (F.col(shard) * pieces + piece).cast("int"))
    return mixed.sortWithinPartitions(shard, order).select(*docs.columns)


def op8_mixing_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, size, lap, words, block, shard, order): where the draw puts every document that is
    taken, a row for each time; the ``words`` of a document add up to ``taken`` of :func:`op8_mixing`."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    rows = kept(slim_rows(docs, "row"), "sizes")
    return dealt(rows).select("doc_id", "source", "size", F.inline("laps"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    taken = F.aggregate("laps", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return mix(kept(slim_rows(docs, "row"), "sizes")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights,
         coalesce(sum(2 * source_size) OVER o, 0) AS used, coalesce(sum(weight) OVER o, 0) AS gone, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS i
  FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(CAST(whole - used AS DOUBLE) / (weights - gone), i) AS level FROM r WHERE 2 * source_size >= CAST(whole - used AS DOUBLE) / (weights - gone) * weight),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), level * weight) AS target FROM w, l),
x AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size)) AS taken
FROM x
"""
