"""Nearest vectors by centroid lists: an index for any number of items, exact where asked to be."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.ordered import top_n
from touchline.session import written

#: Vectors the centroids are fitted to, and most centroids; both bound what the driver and every task hold.
SAMPLE, LISTS = 16384, 1024
#: Items and queries of a list, and of lists bundled for queries that look into most of them, that one group holds.
BLOCK, WIDE = 4096, 65536
#: Rows whose products are in memory at once, on either side.
TILE = 2048


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centroids(items: DataFrame, id_col: str, vec: str, lists: int | None = None, rounds: int = 8) -> np.ndarray:
    """Directions that about as many vectors each are close to, fitted to SAMPLE vectors at most, picked by a hash of
    their id; by default the square root of the number of items, LISTS at most."""
    hashed = F.xxhash64(id_col)
    known = items.filter(F.col(vec).isNotNull())
    picked = lambda df: df.orderBy(hashed, id_col).limit(SAMPLE).select(F.col(vec).cast("array<double>").alias("v")).toPandas()
    # every partition sends what it would pick to the driver, so only the lowest hashes are looked at first
    share = SAMPLE * 1.25 / max(known.count(), 1)
    rows = picked(known.filter(hashed <= int(share * 2**64) - 2**63) if share < 0.5 else known)
    if share < 0.5 and len(rows) < SAMPLE:  # ids that repeat
        rows = picked(known)
    if not len(rows):
        return np.zeros((0, 0))
    x = unit(np.stack(rows["v"].to_list()))
    n = lists or round(math.sqrt(items.count()))
    c = x[np.linspace(0, len(x) - 1, max(1, min(n, LISTS, len(x)))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + TILE] @ c.T, axis=1) for i in range(0, len(x), TILE)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), c)
    return c


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ c.T, -1, 1))


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), TILE):
            yield pdf.iloc[at : at + TILE]


def listed(items: DataFrame, id_col: str, vec: str, c: np.ndarray, extra: Sequence[str] = ()) -> DataFrame:
    """Items with the list of the centroid nearest to them and the angle to it; those without a vector are left out."""
    sent = items.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _tiles(batches):
            angles = _angles(np.stack(pdf["v"].to_list()), sent.value)
            own = np.argmin(angles, axis=1)
            yield pdf.assign(list=own.astype(np.int32), angle=angles[np.arange(len(own)), own])

    slim = items.filter(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"), *extra)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return slim.mapInPandas(run, f"{types}, list int, angle double")


def _first(row: np.ndarray, sim: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` most similar of every row, of equals the one that stands first."""
    order = np.lexsort((place, -sim, row))
    row, sim, place = row[order], sim[order], place[order]
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
    keep = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row)))) < k
    return row[keep], sim[keep], place[keep]


def _product(a: pd.DataFrame, b: pd.DataFrame, k: int, apart: str | None) -> pd.DataFrame:
    """The best ``k`` of ``b`` for every row of ``a``, tile by tile; ``kth``, if ``a`` has it, is a similarity that answers
    reach at least, and ``lists`` are the lists of ``b`` that a row looks into."""
    b = b.sort_values("id", kind="stable")  # equal similarities then come in the order of the ids
    x, y = unit(np.stack(a["v"].to_list())), unit(np.stack(b["v"].to_list()))
    reach = a["kth"].fillna(-2).to_numpy(float) if "kth" in a else np.full(len(a), -2.0)
    if "lists" in a:
        names, code = np.unique(b["list"].to_numpy(), return_inverse=True)
    out = []
    for r in range(0, len(a), TILE):
        least = reach[r : r + TILE].copy()
        want = None
        if "lists" in a:
            lists = a["lists"].iloc[r : r + TILE].to_list()
            rows, flat = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(int)
            at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            own = names[at] == flat
            want = np.zeros((len(lists), len(names)), bool)
            want[rows[own], at[own]] = True
        best = (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        for c in range(0, len(b), TILE):
            sims = x[r : r + TILE] @ y[c : c + TILE].T
            if apart:
                sims[a[apart].to_numpy()[r : r + TILE, None] == b[apart].to_numpy()[None, c : c + TILE]] = -2
            if want is not None:
                sims[~want[:, code[c : c + TILE]]] = -2
            if (least < -1).any() and sims.shape[1] > k:
                least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
            row, place = np.nonzero((sims >= least[:, None] - 2e-6) & (sims >= -1.5))
            sim = np.round(sims[row, place], 6)
            best = _first(*(np.concatenate(pair) for pair in zip(best, (row, sim, place + c))), k)
            if len(best[0]):
                full, last = np.unique(best[0], return_counts=True), len(best[0]) - 1 - np.unique(best[0][::-1], return_index=True)[1]
                done = full[1] == k
                least[full[0][done]] = np.maximum(least[full[0][done]], best[1][last[done]])
        out.append((best[0] + r, *best[1:]))
    row, sim, place = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"query_id": a["id"].to_numpy()[row], "item_id": b["id"].to_numpy()[place], "similarity": sim})


def _products(asked: DataFrame, index: DataFrame, k: int, within: Sequence[str], apart: str | None, by: str = "list", block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, similarity): the best ``k`` items of every (query, ``by``) of ``asked``. Long lists and lists
    that many queries ask for are cut into blocks by hash, so no group is larger than about ``block`` on either side."""
    keys = [by, *within]
    i_blocks = index.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("ib"))
    q_blocks = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("qb"))
    sizes = i_blocks.join(q_blocks, keys)
    # a row per list goes to the vectors: Spark would send these instead, as it sizes a query as one row, not one per list
    sizes = sizes.hint("merge") if within else F.broadcast(sizes)
    cut = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = [apart] if apart and apart not in within else []
    more = [c for c in ("kth", "lists") if c in asked.columns]
    q = asked.join(sizes, keys).select("id", "v", *keys, *own, *more, cut(F.col("qb")).alias("q"), every(F.col("ib")).alias("i"))
    i = index.join(sizes, keys).select("id", "v", *dict.fromkeys([*keys, "list"]), *own, cut(F.col("ib")).alias("i"), every(F.col("qb")).alias("q"))
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "item_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _product(a, b, k, apart) if len(a) and len(b) else none

    groups = [*keys, "q", "i"]
    return q.groupBy(*groups).cogroup(i.groupBy(*groups)).applyInPandas(product, "query_id long, item_id long, similarity double")


def nearest(
    queries: DataFrame, items: DataFrame, id_col: str, vec: str, k: int, within: Sequence[str] = (), apart: str | None = None,
    probes: int = 8, exact: bool = True, lists: int | None = None,
) -> DataFrame:
    """The ``k`` items of the largest cosine for every query: (query_id, item_id, similarity, rank_no).

    ``within``: columns both sides agree in; ``apart``: a column they differ in (the id or a name). Items are
    dealt to the list of their nearest centroid. A query first looks into the lists of its ``probes`` nearest
    centroids. With ``exact`` it then looks into every other list that could hold a better item than its k-th:
    no item of a list is nearer than the centroid less the list's widest angle. Without, that step is left out
    and the answer is an approximation. ``apart`` has no nulls; a vector of zeros is similar to none (0); rows
    without a vector neither ask nor answer. Ids are integers, unique on either side.
    """
    extra = list(dict.fromkeys([*within, *([apart] if apart else [])]))
    c = centroids(items, id_col, vec, lists)
    spark = queries.sparkSession
    if not len(c):
        return spark.createDataFrame([], "query_id long, item_id long, similarity double, rank_no int")
    if apart == id_col:  # the id goes by another name inside
        queries, items, apart = queries.withColumn("own_id", F.col(id_col)), items.withColumn("own_id", F.col(id_col)), "own_id"
        extra = [x if x != id_col else apart for x in extra]
    index = written(listed(items, id_col, vec, c, extra), "lists")
    wide, sizes = np.full(len(c), -1.0), np.zeros(len(c), np.int64)  # a row per list
    for r in index.groupBy("list").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        wide[r["list"]], sizes[r["list"]] = r["r"], r["n"]
    # neighbouring lists with about WIDE items together are one bundle
    bundle = np.unique((np.cumsum(sizes) - sizes) // WIDE, return_inverse=True)[1].astype(np.int32)
    sent = spark.sparkContext.broadcast((c, wide, bundle))
    slim = queries.filter(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"), *extra)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)

    def first_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, wide, _ = sent.value
        full = np.flatnonzero(wide >= 0)
        for pdf in _tiles(batches):
            near = full[np.argsort(_angles(np.stack(pdf["v"].to_list()), c[full]), axis=1, kind="stable")[:, :probes]]
            yield pdf.assign(list=near.tolist())

    def other_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, wide, bundle = sent.value
        heads = np.flatnonzero(np.concatenate([[True], bundle[1:] != bundle[:-1]]))
        for pdf in _tiles(batches):
            angles = _angles(np.stack(pdf["v"].to_list()), c)
            best = np.cos(np.maximum(angles - wide, 0))
            more = (best + 2e-6 >= pdf["kth"].fillna(-2).to_numpy()[:, None]) & (wide >= 0)
            np.put_along_axis(more, np.stack(pdf["seen"].to_list()).astype(int), False, axis=1)
            # a row per query and bundle, with the lists of the bundle that the query looks into
            row, which = np.nonzero(np.logical_or.reduceat(more, heads, axis=1))
            ends = np.append(heads[1:], len(bundle))
            lists = [(lo + np.flatnonzero(more[r, lo:hi])).astype(np.int32) for r, lo, hi in zip(row, heads[which], ends[which])]
            yield pdf.drop(columns=["seen"]).iloc[row].assign(bundle=which.astype(np.int32), lists=lists)

    probed = written(slim.mapInPandas(first_lists, f"{types}, list array<int>"), "probes")
    asked = lambda df: df.withColumn("list", F.explode("list"))
    order = [F.col("similarity").desc(), F.col("item_id")]
    found = top_n(_products(asked(probed), index, k, within, apart), ["query_id"], order, k)
    if not exact:
        return found
    found = written(found, "near")
    kth = found.filter(F.col("rank_no") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("kth"))
    rest = probed.withColumnRenamed("list", "seen").join(kth, "id", "left").select(*slim.columns, "seen", "kth")
    asks = rest.mapInPandas(other_lists, f"{types}, kth double, bundle int, lists array<int>")
    bundles = F.array(*[F.lit(int(b)) for b in bundle])
    second = _products(asks, index.withColumn("bundle", F.get(bundles, F.col("list"))), k, within, apart, "bundle", WIDE)
    return top_n(found.drop("rank_no").unionByName(second), ["query_id"], order, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(asked, hits, recall): what share of the exact neighbours, for the queries that have an exact answer, was found.
    A neighbour as similar as the exact answer's last one counts as one of its equals."""
    last = exact.groupBy("query_id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("asked"))
    good = F.coalesce(F.sum((F.col("similarity") >= F.col("least")).cast("long")), F.lit(0))
    per = last.join(found, "query_id", "left").groupBy("query_id", "asked").agg(good.alias("hits")).withColumn("hits", F.least("hits", "asked"))
    return per.agg(F.sum("asked").alias("asked"), F.sum("hits").alias("hits")).withColumn("recall", F.col("hits") / F.col("asked"))


def divisible(id_col: str, by: int = 100) -> Column:
    """The stated set of queries: rows whose id is divisible by 100."""
    return F.col(id_col) % by == 0
