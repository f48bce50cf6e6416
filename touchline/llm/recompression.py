"""Repeated passages by recompression.

Words are compressed in rounds: runs of one symbol become a symbol, then pairs of a left and a right
symbol do; which is which is a bit of the symbol's name. A name is a hash of what it stands for, so it
is the same in every document and task without a dictionary. Each symbol carries the stretch of words
that settles it: wherever that stretch occurs, the symbol occurs in it. A window of words is known by the
longest symbol settled inside it, so equal windows have equal symbols at equal places.

Spark then works in three rounds, each on what the one before left open:

1. neighbouring windows known by one symbol form a range; symbols of one document only are left out;
2. ranges are named by symbol and all their words: one that an earlier document has is repeated whole, and
   only the first of its holders goes on, if another document's open range has the symbol;
3. the windows of the others are named one by one (128 bits of all their words), and those that an earlier
   document has are repeated.

Defined cases: a null or empty text has no words. Words are compared byte for byte. A text shorter than
the window is kept whole. Rows that share a doc_id are equally early: neither removes the other. A row
without doc_id is later than all others, and its windows make no other row's windows repeated. A text of any
length is worked on whole, in memory that grows with it. An empty table gives an empty result. Extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import forget, kept, numbered, stretches, table

WINDOW = 50
#: Bytes of text whose arrays are in memory at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
_U = np.uint64
_NONE = _U((1 << 64) - 1)
#: Words of the symbols that windows are known by where there are any.
LONG = 4
#: Runs are named in every RUNS-th round; pairs in all.
RUNS = 3
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "replace").split()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well spread 64-bit function of 64-bit numbers."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Line:
    """The words of some documents side by side, with a wall before, between and behind them."""

    def __init__(self, documents: list[list[bytes]]):
        self.sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        self.starts = np.cumsum(self.sizes + 1) - self.sizes
        total = int(self.sizes.sum()) + len(documents) + 1
        self.wall = np.ones(total, bool)
        self.names = np.zeros(total, _U)
        for at, words in zip(self.starts.tolist(), documents):
            self.names[at : at + len(words)] = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
            self.wall[at : at + len(words)] = False

    def window_starts(self, window: int) -> np.ndarray:
        """Every place where a whole window of one document begins, in order."""
        n = np.maximum(self.sizes - window + 1, 0)
        first = np.repeat(self.starts - (np.cumsum(n) - n), n)
        return first + np.arange(len(first))

    def hasher(self, which: int):
        """hash(lo, hi) of the words from place ``lo`` up to ``hi``, whatever their place."""
        base = _BASES[which]
        inverse = _U(pow(int(base), -1, 1 << 64))
        ones = np.full(len(self.names), base, _U)
        ones[0] = 1
        powers = np.cumprod(ones)
        ones[1:] = inverse
        back = np.cumprod(ones)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(self.names, which + 1) * powers)])

        def hash_of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return mix((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(_U), which + 3)

        return hash_of


def symbols(line: Line, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Every run and pair symbol that a window can settle: its ``name``, the words it covers ``start`` to
    ``stop`` and those that settle it ``low`` to ``high``, in the order of ``low``."""
    name, wall = line.names, line.wall
    start = np.arange(len(name))
    stop = start + 1
    far = 2 * len(name) + window  # what a wall settles is settled in no window
    low, high = np.where(wall, -far, start), np.where(wall, far, stop)
    made: list[tuple[np.ndarray, ...]] = []

    def keep(which: np.ndarray) -> None:
        which = which & (high - low <= window)
        made.append(tuple(a[which] for a in (name, start, stop, low, high)))

    # symbols only ever need more words to be settled, so the last round is the same whatever else is in line
    turn = 0
    while (high - low <= window).any():
        if turn % RUNS == 0:  # a symbol, or a run of it, ends where another symbol stands on either side
            head = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | wall[1:] | wall[:-1]]))
            tail = np.append(head[1:], len(name)) - 1
            count = tail - head + 1
            low, high = low[np.maximum(head - 1, 0)], high[np.minimum(tail + 1, len(name) - 1)]
            name = np.where(count > 1, mix(name[head] ^ mix(count.astype(_U), 7), 5), name[head])
            start, stop, wall = start[head], stop[tail], wall[head]
            keep((count > 1) & ~wall)
        # pairs: a left symbol takes the right symbol behind it
        right = (mix(name, 100 + turn) >> _U(63)).astype(bool) & ~wall
        left = ~right & ~wall
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & right[1:]
        joined = np.zeros(len(name), bool)
        joined[1:] = joins[:-1]
        after, before = np.append(np.arange(1, len(name)), len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
        pair = mix(name * _U(0xC2B2AE3D27D4EB4F) + mix(name[after], 11), 13)
        own_low, own_high = np.where(right, low[before], low), np.where(left, high[after], high)
        name = np.where(joins, pair, name)
        low, high, stop = np.where(joins, low, own_low), np.where(joins, high[after], own_high), np.where(joins, stop[after], stop)
        stay = ~joined
        name, start, stop, low, high, wall, fresh = (a[stay] for a in (name, start, stop, low, high, wall, joins))
        keep(fresh)
        turn += 1
    columns = [np.concatenate(c) for c in zip(*made)]
    order = np.argsort(columns[3], kind="stable")
    return dict(zip(("name", "start", "stop", "low", "high"), (c[order] for c in columns)))


def known_by(line: Line, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows and the name of the symbol each is known by: the least name among the symbols of
    LONG words or more that are settled inside the window, so that neighbouring windows mostly agree. A window
    without one takes the least name of its shorter symbols, and one that settles none, such as the inside of
    a long run, its first word."""
    places = line.window_starts(window)
    names = mix(line.names[places], 17)
    if not len(places):
        return places, names
    s = symbols(line, window)
    length = s["stop"] - s["start"]
    todo = np.arange(len(places))
    for own in (length >= LONG, length < LONG):
        first, last = np.maximum(s["high"][own] - window, 0), s["low"][own]
        best = least_over(first, last, s["name"][own], len(line.names), window)[places[todo]]
        found = best != _NONE
        names[todo[found]] = best[found]
        todo = todo[~found]
        if not len(todo):
            break
    return places, names


def least_over(first: np.ndarray, last: np.ndarray, value: np.ndarray, n: int, longest: int) -> np.ndarray:
    """The least value among the intervals ``first`` to ``last`` over each of ``n`` places. An interval is two
    overlapping stretches whose length is a power of two; long stretches hand their value down to halves."""
    power = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    below = np.full(n, _NONE)
    for k in range(longest.bit_length(), -1, -1):
        own = power == k
        np.minimum.at(below, first[own], value[own])
        np.minimum.at(below, last[own] - (1 << k) + 1, value[own])
        if k:
            half = 1 << (k - 1)
            below[half:] = np.minimum(below[half:], below[:-half].copy()) if half < n else below[half:]
    return below


def ranges(line: Line, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Neighbouring windows known by one symbol: ``document``, ``name``, first and last place ``lo`` and ``hi``
    within the document, and the hash ``content`` of all words from the first to the last window."""
    places, names = known_by(line, window)
    if not len(places):
        none = np.zeros(0, np.int64)
        return {"document": none, "name": none.astype(_U), "content": none.astype(_U), "lo": none, "hi": none}
    document = np.searchsorted(line.starts, places, "right") - 1
    head = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (places[1:] != places[:-1] + 1)]))
    tail = np.append(head[1:], len(places)) - 1
    own = document[head]
    return {
        "document": own, "name": names[head], "content": line.hasher(0)(places[head], places[tail] + window),
        "lo": places[head] - line.starts[own], "hi": places[tail] - line.starts[own],
    }


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose texts have about CHUNK bytes; only one of them is Python objects at a time."""
    return stretches(batch, column, CHUNK)


_SIGNED = np.int64
_INDEX = pa.schema([
    ("key", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()),
    ("name", pa.list_(pa.int64())), ("content", pa.list_(pa.int64())), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())),
])


def range_index(docs: DataFrame, row: str, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, key, n_words, sha256, name, content, lo, hi): one row per document with its ranges as
    lists; ``key`` is a number for the row that holds once this frame is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for given in chunks(batch, "t"):
                words = [split_words(t) for t in given.column("t").to_pylist()]
                found = ranges(Line(words), window)
                cuts = pa.array(np.searchsorted(found["document"], np.arange(len(words) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(found[c].view(_SIGNED))) for c in ("name", "content")]
                lists += [pa.ListArray.from_arrays(cuts, pa.array(found[c].astype(np.int32))) for c in ("lo", "hi")]
                own = [pa.array(np.arange(key, key + len(words))), pa.array([len(w) for w in words], pa.int64())]
                own.append(pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words]))
                key += len(words)
                yield pa.RecordBatch.from_arrays([given.column("row"), given.column("doc_id"), *own, *lists], ["row", "doc_id", *_INDEX.names])

    slim = docs.select(F.col(row).alias("row"), "doc_id", F.col("text").alias("t"))
    types = f"row {docs.schema[row].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    return slim.mapInArrow(run, f"{types}, key long, n_words long, sha256 string, name array<long>, content array<long>, lo array<int>, hi array<int>")


def later(doc_id: Column, first: Column) -> Column:
    """Whether a document comes after the first holder; one without doc_id comes after all that have one."""
    return F.coalesce(doc_id > first, first.isNotNull())


def sort_ranges(index: DataFrame) -> DataFrame:
    """(key, lo, hi, whole) of ranges that an earlier document has whole and, ``whole`` false, of those whose
    windows have to be compared one by one."""
    own = index.filter(F.size("name") > 0)
    # a symbol of one document only is no repeat; most are
    names = own.select("doc_id", F.explode("name").alias("name")).groupBy("name")
    names = names.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max(F.col("doc_id").isNull()).alias("n"))
    several = names.filter((F.col("a") != F.col("b")) | F.col("n") & F.col("a").isNotNull()).select("name")
    zipped = F.explode(F.arrays_zip("name", "content", "lo", "hi")).alias("z")
    entries = kept(own.select("key", "doc_id", zipped).select("key", "doc_id", "z.*").join(several, "name", "left_semi"), "entries")
    firsts = kept(entries.groupBy("name", "content").agg(F.min("doc_id").alias("first")), "firsts")
    none = F.col("first").isNull()
    open_names = firsts.groupBy("name").agg(F.min("first").alias("a"), F.max("first").alias("b"), F.max(none).alias("n"))
    open_names = open_names.filter((F.col("a") != F.col("b")) | F.col("n") & F.col("a").isNotNull()).select("name", F.lit(True).alias("open"))
    met = entries.join(firsts, ["name", "content"]).withColumn("whole", later(F.col("doc_id"), F.col("first")))
    met = kept(met.join(open_names, "name", "left").filter("whole or open").select("key", "lo", "hi", "whole"), "met")
    forget(entries, firsts)
    return met


def compared_windows(suspects: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, place): windows of open ranges whose words an earlier document's open range has too.
    ``suspects`` carries key, doc_id, text and the open ranges as lists ``lo`` and ``hi``."""
    schema = ["key", "doc_id", "place", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given in chunks(batch, "text"):
                line = Line([split_words(t) for t in given.column("text").to_pylist()])
                lo = [np.asarray(x, np.int64) + s for x, s in zip(given.column("lo").to_pylist(), line.starts)]
                n = [np.asarray(y, np.int64) + s - x + 1 for x, y, s in zip(lo, given.column("hi").to_pylist(), line.starts)]
                document = np.repeat(np.arange(given.num_rows), [int(x.sum()) for x in n])
                lo, n = np.concatenate(lo), np.concatenate(n)
                places = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                names = [pa.array(line.hasher(w)(places, places + window).view(_SIGNED)) for w in (0, 1)]
                own = pa.array(document)
                yield pa.RecordBatch.from_arrays(
                    [given.column("key").take(own), given.column("doc_id").take(own), pa.array((places - line.starts[document]).astype(np.int32)), *names], schema
                )

    doc_id = suspects.schema["doc_id"].dataType.simpleString()
    windows = kept(
        suspects.filter(F.size("lo") > 0).select("key", "doc_id", "text", "lo", "hi").mapInArrow(run, f"key long, doc_id {doc_id}, place int, h1 long, h2 long"), "windows"
    )
    firsts = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    return windows.join(firsts, ["h1", "h2"]).filter(later(F.col("doc_id"), F.col("first"))).select("key", "place")


def _covered(n: int, window: int, lo: list[int], hi: list[int], places: list[int]) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray([*lo, *places], np.int64), 1)
    np.subtract.at(edge, np.asarray([*hi, *places], np.int64) + window, 1)
    return np.cumsum(edge)[:n] > 0


def repeated_words(docs: DataFrame, row: str, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, n_removed, kept_sha256, kept): what is left of every document without the words
    of windows that an earlier document has; ``kept`` is null where nothing goes. ``row`` names the rows of
    ``docs`` and must be the same on every reading."""
    index = kept(range_index(docs, row, window), "index")
    met = sort_ranges(index)
    span = F.struct("lo", "hi")
    lists = met.groupBy("key").agg(F.collect_list(F.when(F.col("whole"), span)).alias("w"), F.collect_list(F.when(~F.col("whole"), span)).alias("o"))
    lists = lists.select("key", F.col("w.lo").alias("whole_lo"), F.col("w.hi").alias("whole_hi"), F.col("o.lo").alias("lo"), F.col("o.hi").alias("hi"))
    heads = index.select("row", "doc_id", "key", "n_words", "sha256")
    found = heads.join(lists, "key")
    suspects = kept(docs.select(F.col(row).alias("row"), "text").join(found, "row"), "suspects")
    places = compared_windows(suspects, window).groupBy("key").agg(F.collect_list("place").alias("places"))
    both = suspects.drop("lo", "hi", "sha256").join(places, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in (c for batch in batches for c in chunks(batch, "text")):
            n_removed, sha, left = [], [], []
            for text, lo, hi, places in zip(*(given.column(c).to_pylist() for c in ("text", "whole_lo", "whole_hi", "places"))):
                words = split_words(text)
                gone = _covered(len(words), window, lo, hi, places or [])
                joined = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(joined).hexdigest())
                left.append(joined.decode() if gone.any() else None)
            own = [pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*(given.column(c) for c in ("row", "doc_id", "n_words")), *own], ["row", "doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    types = ", ".join(f"{c} {index.schema[c].dataType.simpleString()}" for c in ("row", "doc_id", "n_words"))
    changed = both.select("row", "doc_id", "n_words", "text", "whole_lo", "whole_hi", "places").mapInArrow(run, f"{types}, n_removed long, kept_sha256 string, kept string")
    same = heads.join(lists.select("key"), "key", "left_anti").select(
        "row", "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept")
    )
    return changed.unionByName(same)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with the kept words joined by a space as text where a repeated window was cut out."""
    rows, row = numbered(docs)
    cut = repeated_words(rows, row, window).filter("kept is not null").select(F.col("row").alias(row), F.col("kept").alias(f"{row}_kept"))
    text = F.coalesce(F.col(f"{row}_kept"), F.col("text")).alias("text")
    return rows.join(cut, row, "left").select(*(text if c == "text" else F.col(c) for c in docs.columns))


def op13_recompression(spark: SparkSession, folder: str) -> DataFrame:
    docs, row = numbered(table(spark, folder, "documents"))
    return repeated_words(docs, row).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
w AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
bad AS (SELECT r, i FROM w JOIN firsts USING (s) WHERE doc_id > first OR (doc_id IS NULL AND first IS NOT NULL)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM bad),
each AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
