"""Ranked lexical search over bags of item words, each distinct bag scored once.

Documents are restricted to the words of the items. What a score depends on is then the vector of term
frequencies and the length norm m: documents that agree in both form a class, found by hash and told
apart by the vectors themselves. A class is scored once against all items; only then do its members, by
ascending doc_id, take its place in the ranking. Ten classes an item and ten members a class suffice for
the first ten documents, as a class is as good as its first member.

Items are taken in blocks of about BLOCK_WORDS words, so that what every task holds of them is bounded
however many there are; the documents are read once for each block.

Defined cases: a null or empty text has no terms: such a document has no score, such an item no rows. Every
row of the items is an item of its own, also where item_id is null or repeats. Rows of documents that
repeat a doc_id are ranked one by one; those without doc_id come last among equal scores. If no document
has a term, nothing is ranked. A text of any length is counted whole. doc_id is an integer. Extra columns
are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import kept, table
from touchline.llm.decontaminate import words_of

DEPTH = 10
#: Words of items whose vocabulary and lists are sent to every task at once; one longer item is a block alone.
BLOCK_WORDS = 1 << 19
#: Products of (term of a class, item) formed at once in a task.
PRODUCTS = 1 << 21


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): the terms of every item; ``item`` numbers the rows of ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(words_of(t)) for t in batch.column("t").to_pylist()]
            own = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
            terms = pa.array([w.decode() for c in counts for w in c], pa.string())
            times = pa.array([n for c in counts for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(own), batch.column("item_id").take(own), terms, times], ["item", "item_id", "term", "times"])

    slim = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").alias("t"))
    return slim.mapInArrow(run, f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, term string, times long")


def item_blocks(terms: DataFrame, block_words: int) -> list[Column]:
    """Conditions that deal the items into blocks of at most ``block_words`` different terms, or one item."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n))
        sizes = terms.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("item").alias("items"))
        most = sizes.filter("items > 1").agg(F.max("terms")).first()[0] or 0
        if most <= block_words:
            return [block == k for k in range(n)]
        n *= 2


def bags(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(doc_id, n, bag): number of terms of each document and, of those in the vocabulary, their numbers in
    ascending order followed by their frequencies, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column("t").to_pylist():
                words = words_of(text)
                found = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                sizes.append(len(words))
                packed.append(np.array(found, np.int32).T.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "bag"])

    return docs.select("doc_id", F.col("text").alias("t")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, bag binary")


def unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bag, term number and frequency of every entry of some bags."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
    both = np.frombuffer(b"".join(packed), np.int32)
    which = np.repeat(np.arange(len(packed)), sizes)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(which)) + first[which]  # a bag's frequencies stand behind its numbers
    return which, both[at], both[at + sizes[which]].astype(np.int64)


def holding(found: DataFrame, size: int) -> np.ndarray:
    """In how many bags each of ``size`` terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            own += np.bincount(unpacked(batch.column("bag").to_pylist())[1], minlength=size)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["term", "df"])

    counts = found.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[counts["term"].to_numpy()] = counts["df"].to_numpy()
    return out


def bag_classes(found: DataFrame, documents: int, terms: int, depth: int = DEPTH) -> DataFrame:
    """(m, bag, members): the classes of equal bag and norm, with their first members by ascending doc_id."""
    norm = F.lit(100 - 75) + F.expr(f"(75L * n * {documents}L) div {terms}L")
    rows = found.filter(F.octet_length("bag") > 0).select("doc_id", "bag", norm.alias("m")).withColumn("hash", F.xxhash64("bag", "m"))
    # ordered by hash, the vectors are compared only where hashes agree
    same = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    first = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= depth)
    return first.groupBy("hash", "m", "bag").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("l")).select("m", "bag", F.col("l.doc_id").alias("members"))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def best_documents(classes: DataFrame, lists: Broadcast, depth: int = DEPTH) -> DataFrame:
    """(place, doc_id, score): of every item, by its place in the block, the first documents of each task.
    ``lists`` holds per term the weight and where its items and their counts stand."""

    def order(x: tuple) -> tuple:
        return (-x[0], x[1] is None, x[1] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, item, times, n_items = lists.value
        width = np.diff(start)
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)
        for batch in batches:
            members, packed = batch.column("members").to_pylist(), batch.column("bag").to_pylist()
            norm = batch.column("m").to_numpy()
            which, term, tf = unpacked(packed)
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[which]))
            work = np.bincount(which, weights=width[term], minlength=len(packed)) + n_items
            turn = (np.cumsum(work) // PRODUCTS).astype(np.int64)
            for lo, hi in zip(*(np.searchsorted(turn, np.unique(turn), s).tolist() for s in ("left", "right"))):
                a, b = np.searchsorted(which, [lo, hi])
                reach = width[term[a:b]]
                at = np.repeat(start[term[a:b]] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
                scores = np.zeros((hi - lo) * n_items, np.int64)
                np.add.at(scores, np.repeat(which[a:b] - lo, reach) * n_items + item[at], np.repeat(value[a:b], reach) * times[at])
                good = np.flatnonzero(scores >= np.tile(least, hi - lo))
                by_item = good[np.argsort(good % n_items, kind="stable")]
                own, cuts = np.unique(by_item % n_items, return_index=True)
                for i, places in zip(own.tolist(), np.split(by_item, cuts[1:])):
                    if len(places) > depth:  # those below the score at this depth cannot be among the first
                        places = places[scores[places] >= np.partition(scores[places], -depth)[-depth]]
                    found = [(int(scores[p]), members[lo + p // n_items][0], members[lo + p // n_items]) for p in places.tolist()]
                    best[i] = heapq.nsmallest(depth, best[i] + found, key=order)
                    if len(best[i]) == depth:
                        least[i] = max(1, best[i][-1][0])
        out = [(i, d, s) for i, l in enumerate(best) for s, d in heapq.nsmallest(depth, ((s, d) for s, _, m in l for d in m), key=order)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["place", "doc_id", "score"])

    return classes.mapInArrow(run, "place long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, depth: int = DEPTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item, item_id, rank, doc_id, score): the ``depth`` best documents with a score above 0 of every item,
    equal scores by ascending doc_id."""
    context = docs.sparkSession.sparkContext
    terms = kept(item_terms(items), "item_terms")
    first = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    parts = []
    for block in item_blocks(terms, block_words):
        own = terms.filter(block).select("item", "term", "times").toArrow()
        names = own["item"].combine_chunks().dictionary_encode()
        words = own["term"].combine_chunks().dictionary_encode()
        term, n_terms, n_items = words.indices.to_numpy(), len(words.dictionary), len(names.dictionary)
        found = kept(bags(docs, context.broadcast({w.encode(): k for k, w in enumerate(words.dictionary.to_pylist())})), "bags")
        documents, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total or not n_terms:
            continue
        order = np.argsort(term, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
        lists = (weights(holding(found, n_terms), documents), start, names.indices.to_numpy()[order].astype(np.int64), own["times"].to_numpy()[order], n_items)
        top = best_documents(bag_classes(found, documents, total, depth), context.broadcast(lists), depth)
        place = docs.sparkSession.createDataFrame(pa.table({"place": pa.array(np.arange(n_items)), "item": names.dictionary}))
        parts.append(top.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= depth).join(F.broadcast(place), "place").drop("place"))
    none = docs.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts, none).join(terms.select("item", "item_id").distinct(), "item").select(
        "item", "item_id", "rank", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score"
    )


def op11_bag_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("item")


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
s AS (SELECT count(*) FILTER (len(words) > 0) AS big_n, CAST(sum(len(words)) AS BIGINT) AS l FROM d),
q AS (SELECT i, item_id, word, count(*) AS times FROM (SELECT i, item_id, unnest(words) AS word FROM b) GROUP BY ALL),
tf AS (SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
df AS (SELECT word, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY word, big_n),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * len(words) * big_n) // l) AS m FROM d, s WHERE l > 0),
sc AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (word) JOIN df USING (word) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k FROM sc WHERE score > 0)
SELECT item_id, CAST(k AS INT) AS rank, doc_id, score FROM o WHERE k <= 10
"""
