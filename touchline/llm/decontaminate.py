"""Benchmark decontamination with a positional inverted index.

The corpus is read twice. The first pass counts how often every benchmark word occurs. Each window of
an item is then represented by its two rarest words; the second pass stores the postings of those words
(document, position, words around). Lists are intersected after subtracting each word's offset in
the item, rarest first, and what survives is compared word for word with the words around.

Words are runs of digits, ASCII letters in either case, and everything beyond ASCII. Defined cases: a
null or empty text has no words and no hits; an item without words has no windows; an item without
item_id marks words as hit but is neither counted nor listed; rows of ``benchmark`` that repeat an
item_id count once. Repeated documents get a row each. A text of any length is read whole; what is stored of
an item grows with its words, not their square. An empty table gives an empty result, or no hits. Extra columns
are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import kept, numbered, table

WINDOW = 13
#: Slots of the table sent to every task. Its size is the same for any benchmark; a benchmark of more
#: words than slots only makes the passes keep some words that no item has.
SLOTS = 1 << 22
_AS_SPACE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return (text or "").encode("utf-8", "replace").lower().translate(_AS_SPACE).split()


def _slots(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (SLOTS - 1)


def item_lists(items: DataFrame) -> DataFrame:
    """(item, item_id, n, words): the words of every item that has any; ``item`` numbers the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item": pdf["item"], "item_id": pdf["item_id"], "words": [[w.decode() for w in words_of(t)] for t in pdf["t"]]})

    slim = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("t"))
    lists = slim.mapInPandas(run, "item long, item_id string, words array<string>").filter(F.size("words") > 0)
    return lists.select("item", "item_id", F.size("words").alias("n"), "words")


def item_words(lists: DataFrame) -> DataFrame:
    """(item, n, pos, word): one row per word of an item."""
    return lists.select("item", "n", F.posexplode("words").alias("pos", "word"))


def _reach(words: DataFrame) -> np.ndarray:
    """Per slot, one more than the number of words around that (word, around) rows ask for; 0: no word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"slot": _slots([w.encode() for w in pdf["word"]]), "reach": pdf["around"] + 1})

    rows = words.mapInPandas(run, "slot long, reach int").groupBy("slot").agg(F.max("reach").alias("reach")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[rows["slot"].to_numpy()] = rows["reach"].to_numpy()
    return out


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, occurrences) over all texts, for words that share a slot with one of ``words``."""
    around = words.select("word", F.lit(0).alias("around")).distinct()
    reach = docs.sparkSession.sparkContext.broadcast(_reach(around))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for text in pdf["t"]:
                words = words_of(text)
                if words:
                    seen.update([words[i] for i in np.flatnonzero(reach.value[_slots(words)]).tolist()])
            if seen:
                yield pd.DataFrame({"word": [w.decode() for w in seen], "c": list(seen.values())})

    return docs.select(F.col("text").alias("t")).mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("occurrences"))


def window_pairs(words: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item, p, q) such that p and q are the places of the two rarest words of some window.
    Windows with a word that the corpus lacks are left out; q is null for windows of one word."""
    start = F.explode(
        F.when(F.col("n") < window, F.array(F.lit(0))).otherwise(
            F.sequence(F.greatest(F.col("pos") - (window - 1), F.lit(0)), F.least(F.col("pos"), F.col("n") - window))
        )
    )
    known = words.join(counts, "word", "left").select("item", "pos", "n", F.coalesce("occurrences", F.lit(0)).alias("c"))
    per_window = known.withColumn("start", start).groupBy("item", "start").agg(F.array_sort(F.collect_list(F.struct("c", "pos"))).alias("l"))
    return per_window.filter(F.col("l")[0]["c"] > 0).select("item", F.col("l")[0]["pos"].alias("p"), F.get("l", F.lit(1))["pos"].alias("q")).distinct()


def postings(docs: DataFrame, row: str, terms: DataFrame) -> DataFrame:
    """The positional index of the terms: (row, doc_id, n_words, word, pos, before, after).

    One row per document, with ``word`` null, and one per occurrence of a (word, around) of ``terms``,
    with that many words on either side. A few words that share a slot with a term are in it too.
    """
    reach = docs.sparkSession.sparkContext.broadcast(_reach(terms))
    cols = ["row", "doc_id", "n_words", "word", "pos", "before", "after"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for r, doc_id, text in zip(pdf["row"], pdf["doc_id"], pdf["t"]):
                words = words_of(text)
                out.append((r, doc_id, len(words), None, None, None, None))
                if not words:
                    continue
                need = reach.value[_slots(words)]
                for i in np.flatnonzero(need).tolist():
                    k = int(need[i]) - 1
                    before, after = b" ".join(words[max(0, i - k) : i]), b" ".join(words[i + 1 : i + 1 + k])
                    out.append((r, None, None, words[i].decode(), i, before.decode(), after.decode()))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=cols).astype({"n_words": "Int64", "pos": "Int64"})
                    out = []
            if out:
                yield pd.DataFrame(out, columns=cols).astype({"n_words": "Int64", "pos": "Int64"})

    slim = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("t"))
    return slim.mapInPandas(run, f"row {docs.schema[row].dataType.simpleString()}, doc_id string, n_words long, word string, pos int, before string, after string")


def _anchored(lists: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """Pairs with their words and, around p, the item's words that a window can hold."""
    side = window - 1
    p, q = F.col("p"), F.col("q")
    low = F.greatest(p - side, F.lit(0))
    return pairs.join(lists, "item").select(
        "item", "item_id", "n", "p", "q", F.col("words")[p].alias("word"), F.get("words", q).alias("word_q"),
        F.array_join(F.slice("words", low + 1, p - low), " ").alias("item_before"),
        F.array_join(F.slice("words", p + 2, F.lit(side)), " ").alias("item_after"),
    )


def intersect(index: DataFrame, pairs: DataFrame, slop: int = 0) -> DataFrame:
    """Postings of each pair's rarest word whose offset-adjusted place the second list shares, or has
    within ``slop`` words; (row, pos, item, p, ...)."""
    first = index.filter("word is not null").select("row", "word", "pos", "before", "after").join(pairs, "word").withColumn("at", F.col("pos") - F.col("p"))
    single, double = first.filter("q is null"), first.filter("q is not null")
    second = index.filter("word is not null").select("row", F.col("word").alias("word_q"), F.col("pos").alias("pos_q"))
    second = second.join(pairs.select("item", "p", "q", "word_q").filter("q is not null"), "word_q").select("row", "item", "p", "q", (F.col("pos_q") - F.col("q")).alias("at"))
    keys = ["row", "item", "p", "q"]
    if not slop:
        return double.join(second, [*keys, "at"], "left_semi").unionByName(single.select(double.columns))
    step = F.lit(slop + 1)
    cells = F.explode(F.array(F.floor(F.col("at") / step) - 1, F.floor(F.col("at") / step), F.floor(F.col("at") / step) + 1)).alias("cell")
    there = second.select(*keys, F.col("at").alias("at_q"), cells)
    near = double.withColumn("cell", F.floor(F.col("at") / step)).join(there, [*keys, "cell"]).filter(F.abs(F.col("at") - F.col("at_q")) <= slop)
    return near.groupBy(*keys, "item_id", "pos", "at").agg(F.min(F.abs(F.col("at") - F.col("at_q"))).alias("apart")).unionByName(
        single.select(*keys, "item_id", "pos", "at", F.lit(0).cast("int").alias("apart"))
    )


def exact_spans(candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item_id, lo, hi): stretches of a document, first and last word, made of whole windows of an
    item, from comparing the words around both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, item, pos, p, n, b, a, ib, ia in zip(*(pdf[c] for c in ("row", "item_id", "pos", "p", "n", "before", "after", "item_before", "item_after"))):
                left = _same(_words(b)[::-1], _words(ib)[::-1])
                right = _same(_words(a), _words(ia))
                if left + 1 + right >= window or n < window and left == p and right == n - 1 - p:
                    out.append((r, item, pos - left, pos + right))
            if out:
                yield pd.DataFrame(out, columns=["row", "item_id", "lo", "hi"])

    return candidates.select("row", "item_id", "pos", "p", "n", "before", "after", "item_before", "item_after").mapInPandas(
        run, f"row {candidates.schema['row'].dataType.simpleString()}, item_id string, lo long, hi long"
    )


def _words(joined: str) -> list[str]:
    """Words joined by ASCII spaces; white space beyond ASCII is part of a word."""
    return joined.split(" ") if joined else []


def _same(a: list[str], b: list[str]) -> int:
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return k


def _indexed(docs: DataFrame, row: str, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    lists = kept(item_lists(items), "items")
    words = item_words(lists)
    pairs = kept(_anchored(lists, window_pairs(words, word_counts(docs, words), window), window), "anchors")
    around = F.when(F.col("n") < window, F.greatest(F.col("p"), F.col("n") - 1 - F.col("p"))).otherwise(window - 1)
    terms = pairs.select("word", around.alias("around")).unionByName(pairs.filter("q is not null").select(F.col("word_q").alias("word"), F.lit(0).alias("around")))
    return kept(postings(docs, row, terms.groupBy("word").agg(F.max("around").alias("around"))), "postings"), pairs


def phrase_matches(docs: DataFrame, row: str, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words) and exact matches (row, item_id, lo, hi) of item windows in them."""
    index, pairs = _indexed(docs, row, items, window)
    spans = exact_spans(intersect(index, pairs), window).distinct()
    return index.filter("word is null").select("row", "doc_id", "n_words"), spans


def proximity_matches(docs: DataFrame, row: str, items: DataFrame, slop: int, window: int = WINDOW) -> DataFrame:
    """(row, item_id, pos, apart): places where the two rarest words of an item window lie as far from
    each other as in the item, give or take ``slop`` words; ``apart`` is the least difference."""
    if slop < 1:
        raise ValueError("slop counts words and starts at 1; phrase_matches is the exact search")
    index, pairs = _indexed(docs, row, items, window)
    return intersect(index, pairs, slop).select("row", "item_id", "pos", "apart").distinct()


def contamination(docs: DataFrame, row: str, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document; it is
    contaminated if it has a hit and one word in ``share`` or more is hit."""
    texts, spans = phrase_matches(docs, row, items, window)
    spans = kept(spans, "spans")
    before = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before) + 1, F.lit(0))) + 1
    hits = spans.select("row", "lo", "hi").distinct().select("row", F.greatest(new, F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    found = spans.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    none = F.array().cast("array<string>")
    ids, n_hit = F.coalesce("ids", none), F.coalesce("n_hit", F.lit(0))
    return texts.join(hits.join(found, "row"), "row", "left").select(
        "row", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without the contaminated ones."""
    rows, row = numbered(docs)
    bad = contamination(rows, row, items).filter("contaminated").select(F.col("row").alias(row))
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return contamination(docs, "row", table(spark, folder, "benchmark")).drop("row")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
b1 AS (SELECT item_id, words, len(words) AS n, least(len(words), 13) AS w FROM b WHERE len(words) > 0),
b2 AS (SELECT item_id, words, w, unnest(range(1, n - w + 2)) AS i FROM b1),
win AS (SELECT DISTINCT item_id, w, array_to_string(list_slice(words, i, i + w - 1), ' ') AS s FROM b2),
lens AS (SELECT DISTINCT w FROM win),
grams AS (SELECT r, words, unnest(range(1, len(words) - w + 2)) AS i, w FROM d, lens WHERE len(words) >= w),
hit AS (
  SELECT DISTINCT g.r, g.i, g.w, win.item_id
  FROM (SELECT r, i, w, array_to_string(list_slice(words, i, i + w - 1), ' ') AS s FROM grams) g JOIN win USING (w, s)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + w)) AS p FROM hit) GROUP BY r),
hi AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
