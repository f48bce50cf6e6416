"""Order-dependent building blocks that stay parallel when one key holds most rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. The helpers here split a key
into ordered pieces first (time buckets, value bins, or the rows that can matter at all), work
inside the pieces, and add what the earlier pieces contribute from a small per-piece table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 7 * 86400


def time_bucket(time: str | Column, seconds: int = SLOT_SECONDS) -> Column:
    """Number of the slot a timestamp falls in; grows with the timestamp. Choose shorter slots
    for denser data: a slot of one key is what a single task sorts."""
    col = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_timestamp(col.cast("timestamp")) / F.lit(seconds))


def value_bin(value: str | Column, per_fold: int = 64) -> Column:
    """Coarse bin that never decreases with the value: linear near 0, logarithmic far out."""
    col = (F.col(value) if isinstance(value, str) else value).cast("double")
    return (F.signum(col) * F.floor(F.log1p(F.abs(col)) * F.lit(float(per_fold)))).cast("long")


#: Ranges a group's values are cut into, a power of two, and how finely the sketch that cuts them looks.
RANGES, SKETCH = 256, 2000
#: Parts that a group's values are dealt to where they meet its edges.
PARTS = 16


def value_ranges(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the number of the range of its group that a value falls in: ranges rise with the value and hold about as
    many rows each, whatever the values look like. Each group's edges come from a quantile sketch that the map
    tasks build and the reducers merge; a group of few values has as many ranges as values. Values meet the edges in
    PARTS parts by hash, so that a few groups of very many values are not a few tasks."""
    edges = df.groupBy(*group).agg(F.percentile_approx(F.col(value).cast("double"), [i / RANGES for i in range(1, RANGES)], SKETCH).alias("__edges"))
    # how many edges lie below, by halving
    steps = F.array(*[F.lit(RANGES >> k) for k in range(1, RANGES.bit_length())])
    below = F.aggregate(steps, F.lit(0), lambda at, n: at + F.when(F.get(F.col("__edges"), at + n - 1) < F.col(value).cast("double"), n).otherwise(0))
    parts = edges.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("int"))
    return match_keys(dealt, parts, [*group, "__part"]).withColumn(out, below).drop("__edges", "__part")


def task_spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys over the configured number of shuffle partitions. Naming the number keeps
    small but compute-heavy Python stages from being merged into a few tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null matches null; the key columns of the left side are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """First ``n`` rows of every group. Spark trims each map task to ``n`` rows per group
    before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def row_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    pieces: Sequence[tuple[Column, bool]],
    out: str = "position_no",
) -> DataFrame:
    """1-based position of each row in its group under ``order``.

    ``pieces`` are (expression, ascending) pairs that must rise (or fall) with the leading order
    columns; rows are numbered inside a piece and shifted by the size of the earlier pieces.
    """
    names = [f"__p{i}" for i in range(len(pieces))]
    cut = df.select("*", *[e.alias(n) for n, (e, _) in zip(names, pieces)])
    piece_keys = [*group, *names]
    sizes = cut.groupBy(*piece_keys).agg(F.count(F.lit(1)).alias("__n"))
    by_piece = Window.partitionBy(*group).orderBy(
        *[F.col(n).asc() if up else F.col(n).desc() for n, (_, up) in zip(names, pieces)]
    )
    shift = sizes.withColumn(
        "__shift", F.coalesce(F.sum("__n").over(by_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("__n")
    inside = cut.withColumn("__rn", F.row_number().over(Window.partitionBy(*piece_keys).orderBy(*order)))
    return (
        match_keys(inside, shift, piece_keys)
        .withColumn(out, F.col("__rn") + F.col("__shift"))
        .drop("__rn", "__shift", *names)
    )


def time_positions(
    df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], out: str = "position_no", slot: int = SLOT_SECONDS
) -> DataFrame:
    """1-based position of each row of a key in time order."""
    order = [F.col(time), *[F.col(t) for t in tie]]
    return row_positions(df, keys, order, [(time_bucket(time, slot), True)], out)


def ranked_values(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, value, lt, eq, n): per distinct value how many group rows lie below, share it and
    exist at all.

    Equal values are folded into one counted row before anything is sorted, and the distinct
    values of a group are ordered inside ranges of about as many values, so neither ties nor size make a hot task.
    """
    if not group:
        return ranked_values(df.withColumn("__all_rows", F.lit(0)), ["__all_rows"], value).drop("__all_rows")
    keep = df.filter(F.col(value).isNotNull())
    counts = keep.groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__eq"))
    binned = value_ranges(counts, group, "__v", "__bin")
    bins = binned.groupBy(*group, "__bin").agg(F.sum("__eq").alias("__m"))
    over_bins = Window.partitionBy(*group).orderBy("__bin")
    bins = bins.select(
        *group,
        "__bin",
        F.coalesce(F.sum("__m").over(over_bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__below"),
        F.sum("__m").over(Window.partitionBy(*group)).alias("__all"),
    )
    inside = Window.partitionBy(*group, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    return match_keys(
        binned.withColumn("__in", F.coalesce(F.sum("__eq").over(inside), F.lit(0))), bins, [*group, "__bin"], "inner"
    ).select(
        *group, F.col("__v").alias(value), (F.col("__in") + F.col("__below")).alias("lt"), F.col("__eq").alias("eq"), F.col("__all").alias("n")
    )


def value_ranks(df: DataFrame, group: Sequence[str], value: str, prefix: str = "r") -> DataFrame:
    """Add how many group rows lie below (``_lt``), equal (``_eq``) and exist at all (``_n``);
    rows without a value get null."""
    ranked = ranked_values(df, group, value).withColumnsRenamed({c: f"{prefix}_{c}" for c in ("lt", "eq", "n")})
    return match_keys(df, ranked, [*group, value])


def value_positions(
    df: DataFrame, group: Sequence[str], value: str, ascending: bool, tie: Sequence[str], tie_piece: Column, out: str
) -> DataFrame:
    """1-based position of each row by value, then by ``tie``. Rows with the same value are numbered
    in pieces of the tie order (``tie_piece`` must rise with ``tie``), so a value that most rows
    share does not end in one task."""
    r = value_ranks(df, group, value, "__vp")
    r = row_positions(r, [*group, value], [F.col(t) for t in tie], [(tie_piece, True)], "__within")
    ahead = F.col("__vp_lt") if ascending else F.col("__vp_n") - F.col("__vp_lt") - F.col("__vp_eq")
    return r.withColumn(out, ahead + F.col("__within")).drop("__vp_lt", "__vp_eq", "__vp_n", "__within")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """(group, q, value): exact quantiles with linear interpolation, from the counts of distinct values."""
    r = ranked_values(df, group, value)
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    t = r.withColumn("q", F.explode(qs)).withColumn("__t", (F.col("n") - 1) * F.col("q"))
    lo, hi = F.floor("__t"), F.ceil("__t")
    holds = lambda i: (F.col("lt") <= i) & (i < F.col("lt") + F.col("eq"))
    near = t.filter(holds(lo) | holds(hi))
    return near.groupBy(*group, "q").agg(
        F.max(F.when(holds(lo), F.col(value))).alias("__a"), F.max(F.when(holds(hi), F.col(value))).alias("__b"), F.max("__t").alias("__t")
    ).select(*group, "q", (F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__t") - F.floor("__t"))).alias(value))


def percent_rank_average(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie rank divided by the number of non-null values in the group."""
    r = value_ranks(df, group, value, "__pr")
    pct = (F.col("__pr_lt") + (F.col("__pr_eq") + 1) / F.lit(2.0)) / F.col("__pr_n")
    return r.withColumn(out, pct).drop("__pr_lt", "__pr_eq", "__pr_n")


def rolling_before_period(
    df: DataFrame,
    key: Sequence[str],
    period: Sequence[str],
    time: str,
    tie: Sequence[str],
    stats: Sequence[str],
    windows: Sequence[int],
    how: str = "avg",
    name: str = "{stat}_{w}",
) -> DataFrame:
    """One row per (key, period): mean or sum of each stat over the last ``w`` rows of the key
    that come before the first row of the period. Nulls are skipped.

    Only the last ``max(windows)`` rows a key has on one day of a period can ever lie in a later
    window, so just those enter the per-key window; a key with very many rows shrinks in the
    map tasks already. Two periods of one key may not interleave within a day.
    """
    widest = max(windows)
    day = F.to_date(F.col(time)).alias("__day")
    slim = df.select(*key, *period, time, *tie, *stats, day)
    newest = [F.col(time).desc(), *[F.col(t).desc() for t in tie]]
    tails = top_n(slim, [*key, *period, "__day"], newest, widest, "__back").drop("__back")
    ordered = Window.partitionBy(*key).orderBy(F.col(time), *[F.col(t) for t in tie])
    fn = {"avg": F.avg, "sum": F.sum}[how]
    made = [
        fn(s).over(ordered.rowsBetween(-w, -1)).alias(name.format(stat=s, w=w)) for s in stats for w in windows
    ]
    rolled = tails.select(*key, *period, time, *tie, F.row_number().over(ordered).alias("__i"), *made)
    names = [name.format(stat=s, w=w) for s in stats for w in windows]
    return rolled.groupBy(*key, *period).agg(*[F.min_by(F.col(n), F.col("__i")).alias(n) for n in names])


def totals_before_period(
    df: DataFrame, key: Sequence[str], period: Sequence[str], time: str, sums: dict[str, Column], within: Sequence[str] = ()
) -> DataFrame:
    """One row per (key, period): running sums over the key's earlier periods.

    Rows are summed per period in the map tasks, so the running window only sees one row per
    period. ``within`` restarts the running sums (for example per season).
    """
    per = df.groupBy(*key, *period).agg(
        F.min(time).alias("__start"), *[F.sum(e).alias(n) for n, e in sums.items()]
    )
    w = (
        Window.partitionBy(*key, *within)
        .orderBy("__start", *[p for p in period if p not in within])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return per.select(*key, *period, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    values: Sequence[str],
    direction: str = "backward",
    strict: bool = True,
    tie: Sequence[str] = (),
    right_on: str | None = None,
    slot: int = SLOT_SECONDS,
) -> DataFrame:
    """For each left row the nearest right row of the same key before (or after) its time.

    Both sides are laid into (key, time slot) pieces; inside a piece the answer is the last right
    row seen, and a piece without one takes the newest right row of the earlier pieces, which is
    kept as one row per piece. ``tie`` orders right rows of equal time. Unmatched rows get nulls.
    """
    right_on = right_on or on
    back = direction == "backward"
    packed = F.struct(F.col(right_on).alias("__rt"), *[F.col(t).alias(f"__tie_{t}") for t in tie], *[F.col(v) for v in values])
    ident = "__left"
    lcols = left.columns
    lside = left.select(
        *by, F.col(on).cast("timestamp").alias("__t"), F.struct(*lcols).alias(ident), F.lit(None).alias("__r")
    )
    rside = right.select(
        *by, F.col(right_on).cast("timestamp").alias("__t"), F.lit(None).alias(ident), packed.alias("__r")
    )
    # at equal time a right row counts when it is not strict, so it must be met first
    right_first = not strict
    flag = F.when(F.col("__r").isNotNull(), F.lit(0 if right_first else 1)).otherwise(F.lit(1 if right_first else 0))
    both = lside.unionByName(rside).withColumn("__slot", time_bucket("__t", slot)).withColumn("__flag", flag)
    t_order = F.col("__t").asc() if back else F.col("__t").desc()
    r_order = F.col("__r").asc_nulls_first() if back else F.col("__r").desc_nulls_last()
    inside = Window.partitionBy(*by, "__slot").orderBy(t_order, "__flag", r_order).rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("__near", F.last("__r", ignorenulls=True).over(inside)).filter(F.col(ident).isNotNull())
    pick = F.max if back else F.min
    slots = both.groupBy(*by, "__slot").agg(pick("__r").alias("__edge"))
    s_order = F.col("__slot").asc() if back else F.col("__slot").desc()
    earlier = Window.partitionBy(*by).orderBy(s_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select(*by, "__slot", F.last("__edge", ignorenulls=True).over(earlier).alias("__carry"))
    joined = match_keys(local.select(*by, "__slot", ident, "__near"), carry, [*by, "__slot"])
    found = F.coalesce("__near", "__carry")
    return joined.select(f"{ident}.*", found.alias("__hit")).select(
        *lcols, *[F.col(f"__hit.{v}").alias(v) for v in values]
    )


def sums_before(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    sums: dict[str, Column],
    strict: bool = True,
    right_on: str | None = None,
    slot: int = SLOT_SECONDS,
) -> DataFrame:
    """For each left row the sums over right rows of the same key before its time (0 if none)."""
    right_on = right_on or on
    lcols = left.columns
    zero = [F.lit(0).cast("double").alias(f"__s_{n}") for n in sums]
    lside = left.select(*by, F.col(on).cast("timestamp").alias("__t"), F.struct(*lcols).alias("__left"), *zero)
    rside = right.select(
        *by,
        F.col(right_on).cast("timestamp").alias("__t"),
        F.lit(None).alias("__left"),
        *[F.coalesce(e.cast("double"), F.lit(0.0)).alias(f"__s_{n}") for n, e in sums.items()],
    )
    right_first = not strict
    flag = F.when(F.col("__left").isNull(), F.lit(0 if right_first else 1)).otherwise(F.lit(1 if right_first else 0))
    both = lside.unionByName(rside).withColumn("__slot", time_bucket("__t", slot)).withColumn("__flag", flag)
    inside = Window.partitionBy(*by, "__slot").orderBy("__t", "__flag").rowsBetween(Window.unboundedPreceding, 0)
    local = both.select(
        *by, "__slot", "__left", *[F.sum(f"__s_{n}").over(inside).alias(f"__in_{n}") for n in sums]
    ).filter(F.col("__left").isNotNull())
    earlier = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = both.groupBy(*by, "__slot").agg(*[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums])
    carry = slots.select(
        *by, "__slot", *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0.0)).alias(f"__c_{n}") for n in sums]
    )
    joined = match_keys(local, carry, [*by, "__slot"])
    return joined.select(
        "__left.*", *[(F.col(f"__in_{n}") + F.coalesce(F.col(f"__c_{n}"), F.lit(0.0))).alias(n) for n in sums]
    ).select(*lcols, *sums)


def trailing_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    """Per key and test, how many of its latest rows pass the test without a break: the last failing row
    of every test in one aggregation, the rows after it in a second one."""
    place = F.struct(*order)
    failed = df.groupBy(*keys).agg(*[F.max(F.when(~F.coalesce(t, F.lit(False)), place)).alias(f"__{n}") for n, t in tests.items()])
    rows = match_keys(df.select(*dict.fromkeys([*keys, *order])), failed, keys)
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(f"__{n}").isNull() | (place > F.col(f"__{n}"))).alias(n) for n in tests])


def trailing_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], test: Column, out: str) -> DataFrame:
    """Per key, how many of its latest rows pass ``test`` without a break."""
    return trailing_runs(df, keys, order, {out: test})


def latest_lists(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], cols: Sequence[str], n: int, out: str) -> DataFrame:
    """One row per (key, time): the newest ``n`` rows of the key up to that time, oldest first.

    Each time of a key is cut to its newest ``n`` rows before anything is collected, so the lists
    stay short whatever the key holds.
    """
    newest = [F.col(t).desc() for t in tie]
    cut = top_n(df.select(*keys, time, *tie, *[c for c in cols if c not in (time, *tie, *keys)]), [*keys, time], newest, n)
    entry = F.struct(time, *tie, *[F.col(c) for c in cols if c not in (time, *tie)])
    per_time = cut.groupBy(*keys, time).agg(F.array_sort(F.collect_list(entry)).alias("__l"))
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - n, 0)
    joined = per_time.select(*keys, time, F.flatten(F.collect_list("__l").over(w)).alias("__a"))
    return joined.select(*keys, time, F.expr(f"slice(__a, greatest(1, size(__a) - {n - 1}), {n})").alias(out))


def previous_row(
    df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], values: dict[str, str], slot: int = SLOT_SECONDS
) -> DataFrame:
    """Values of the row just before each row of its key: ``lag`` inside a time slot, and the
    newest row of the earlier slots for the first row of a slot."""
    order = [F.col(time), *[F.col(t) for t in tie]]
    packed = F.struct(time, *tie, *[F.col(v).alias(f"v_{o}") for o, v in values.items()])
    cut = df.withColumn("__slot", time_bucket(time, slot)).withColumn("__me", packed)
    local = cut.withColumn("__lag", F.lag("__me").over(Window.partitionBy(*keys, "__slot").orderBy(*order)))
    edges = cut.groupBy(*keys, "__slot").agg(F.max("__me").alias("__edge"))
    before = Window.partitionBy(*keys).orderBy("__slot")
    edges = edges.select(*keys, "__slot", F.lag("__edge").over(before).alias("__carry"))
    joined = match_keys(local, edges, [*keys, "__slot"]).withColumn("__hit", F.coalesce("__lag", "__carry"))
    return joined.select(*df.columns, *[F.col(f"__hit.v_{o}").alias(o) for o in values])


def rolling_rows(
    df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], made: dict[str, tuple[str, str, int]],
    slot: int = SLOT_SECONDS, chunk: int = 100_000,
) -> DataFrame:
    """Add ``{out: (function, column, w)}``: a function over the last ``w`` rows before each row.

    Rows are numbered within their key, cut into chunks of that numbering, and the last rows of a
    chunk are handed to the next one as well, so a long key is spread over many tasks.
    """
    widest = max(w for _, _, w in made.values())
    if widest > chunk:
        raise ValueError("a chunk must hold the widest window")
    fns = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    at = F.col("__g") - 1
    own = F.floor(at / chunk)
    numbered = time_positions(df, keys, time, tie, "__g", slot)
    spread = numbered.withColumn("__own", own).withColumn(
        "__chunk", F.explode(F.when(F.pmod(at, F.lit(chunk)) >= chunk - widest, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*keys, "__chunk").orderBy("__g")
    rolled = spread.select("*", *[fns[f](c).over(w.rowsBetween(-n, -1)).alias(o) for o, (f, c, n) in made.items()])
    return rolled.filter(F.col("__own") == F.col("__chunk")).drop("__g", "__own", "__chunk")


def last_known(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], cols: dict[str, str], slot: int = SLOT_SECONDS) -> DataFrame:
    """Add ``{out: column}``: the last value a column had up to and including each row of its key."""
    order = [F.col(time), *[F.col(t) for t in tie]]
    cut = df.withColumn("__slot", time_bucket(time, slot))
    inside = Window.partitionBy(*keys, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"__in_{o}") for o, c in cols.items()])
    newest = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(time, *tie, F.col(c).alias("v")))).alias(f"__m_{o}") for o, c in cols.items()
    ]
    slots = cut.groupBy(*keys, "__slot").agg(*newest)
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select(*keys, "__slot", *[F.last(f"__m_{o}.v", ignorenulls=True).over(before).alias(f"__c_{o}") for o in cols])
    joined = match_keys(local, carry, [*keys, "__slot"])
    return joined.select(*df.columns, *[F.coalesce(f"__in_{o}", f"__c_{o}").alias(o) for o in cols])
