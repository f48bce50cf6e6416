"""Evaluation of predictions: errors, picks per gameweek, bootstrap, calibration, drift, audits.

Rows carry ``season``, ``GW``, ``name``, ``pred`` and ``y``; a double gameweek is summed per player
before picks are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.ordered import PARTS, exact_quantiles, match_keys, row_positions, top_n, value_bin, value_positions, value_ranks
from touchline.session import written

KS = (1, 10, 20, 50)
GWK = ["season", "GW"]
BINS = ((0.0, 2.0, "0-2"), (2.0, 4.0, "2-4"), (4.0, 6.0, "4-6"), (6.0, None, "6+"))
CAPTAIN_HIT = 6


# ------------------------------------------------------------------ errors

def error_metrics() -> list[Column]:
    """Rows, MAE, RMSE, R2, bias, correlation and means of ``pred`` against ``y``."""
    e = F.col("pred") - F.col("y")
    sst = F.var_pop("y") * F.count("y")
    return [
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"), F.avg(e).alias("bias"), F.corr("pred", "y").alias("pearson_r"),
        F.avg("pred").alias("mean_pred"), F.avg("y").alias("mean_actual"),
    ]


def row_metrics(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*group).agg(*error_metrics())


def metrics_by_scope(rows: DataFrame) -> DataFrame:
    """Each season and all of them together, over all rows and over played rows."""
    played = F.explode(F.when(F.col("minutes") > 0, F.array(F.lit("all"), F.lit("played"))).otherwise(F.array(F.lit("all"))))
    r = rows.select("season", "pred", "y", played.alias("subset"))
    scope = F.explode(F.array(F.col("season"), F.lit("all seasons")))
    return r.withColumn("scope", scope).groupBy("scope", "subset").agg(*error_metrics())


# ------------------------------------------------------------------ picks

def player_gameweeks(rows: DataFrame, extra: Sequence[Column] = (), group: Sequence[str] = ()) -> DataFrame:
    """One row per player and gameweek with summed prediction and outcome."""
    return rows.groupBy(*group, *GWK, "name").agg(
        F.round(F.sum("pred"), 9).alias("pred"), F.sum("y").alias("actual"), F.sum("minutes").alias("minutes"), *extra
    )


def rank_correlation(pg: DataFrame, group: Sequence[str]) -> DataFrame:
    """Spearman correlation per group: correlation of average-tie ranks."""
    r = value_ranks(value_ranks(pg, group, "pred", "p"), group, "actual", "a")
    avg = lambda x: F.col(f"{x}_lt") + (F.col(f"{x}_eq") + 1) / F.lit(2.0)
    return r.groupBy(*group).agg(F.corr(avg("p"), avg("a")).alias("spearman"))


def pick_metrics(rows: DataFrame, min_players: int = 30, spearman: bool = True, group: Sequence[str] = ()) -> DataFrame:
    """Per gameweek the mean outcome of the top predictions, hits among the best twenty, rank
    correlation and mean error; small gameweeks are left out."""
    g = [*group, *GWK]
    off = F.abs(F.col("pred") - F.col("y"))
    pg = written(player_gameweeks(rows, [F.sum(off).alias("off"), F.count(off).alias("known"), F.count(F.lit(1)).alias("rows")], group), "player-gameweeks")
    size = pg.groupBy(*g).agg(F.count(F.lit(1)).alias("players"))
    top = top_n(pg, g, [F.col("pred").desc(), F.col("name")], max(KS), "__p")
    best = top_n(pg.select(*g, "name", "actual"), g, [F.col("actual").desc(), F.col("name")], 20, "__a")
    line = best.filter(F.col("__a") == 20).select(*g, F.col("actual").alias("__line"))
    t = match_keys(match_keys(top, size, g), line, g)
    cut = lambda k: F.sum(F.when(F.col("__p") <= k, F.col("actual"))) / F.least(F.lit(k), F.max("players"))
    hit = F.sum(F.when((F.col("__p") <= 20) & (F.col("__line").isNull() | (F.col("actual") >= F.col("__line"))), 1).otherwise(0)) / F.least(F.lit(20), F.max("players"))
    out = t.groupBy(*g).agg(F.max("players").alias("players"), *[cut(k).alias(f"top{k}") for k in KS], hit.alias("hit20"))
    err = pg.groupBy(*g).agg((F.sum("off") / F.nullif(F.sum("known"), F.lit(0))).alias("mae"), F.sum("rows").alias("rows"))
    out = match_keys(out, err, g)
    if spearman:
        out = match_keys(out, rank_correlation(pg, g), g)
    return out.filter(F.col("players") >= min_players)


def ranked_player_gameweeks(rows: DataFrame) -> DataFrame:
    """Every player-gameweek with its rank by prediction."""
    return value_positions(player_gameweeks(rows), GWK, "pred", False, ["name"], F.substring("name", 1, 2), "place")


def scope_means(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Means over gameweeks per season and overall."""
    scope = F.explode(F.array(F.col("season"), F.lit("all seasons")))
    return table.withColumn("scope", scope).groupBy("scope").agg(F.count(F.lit(1)).alias("gameweeks"), *[F.avg(c).alias(c) for c in cols])


def baselines(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Simple forecasts: position mean, last 3, last 6, season average with fallbacks."""
    means = train.groupBy("position").agg(F.avg("y").alias("b_pos_mean"))
    r = rows.join(means, "position", "left")
    return r.withColumns({
        "b_last3": F.coalesce("total_points_r3", F.lit(0.0)), "b_last6": F.coalesce("total_points_r6", F.lit(0.0)),
        "b_ppg": F.coalesce("season_ppg", "total_points_r6", F.lit(0.0)),
    })


def breakdown(rows: DataFrame, group: str, k: int = 10) -> DataFrame:
    """Errors and picks inside each level of a group."""
    err = row_metrics(rows, [group]).join(rows.groupBy(group).agg(F.avg((F.col("minutes") > 0).cast("double")).alias("played_share")), group)
    picks = pick_metrics(rows, 10, True, [group]).groupBy(group).agg(F.avg(f"top{k}").alias(f"within_top{k}"), F.avg("spearman").alias("within_spearman"))
    return err.join(picks, group, "left")


# ------------------------------------------------------------------ calibration

def decile_calibration(rows: DataFrame, tie: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean prediction and outcome in equal-sized bins of the prediction."""
    one = rows.select("pred", "y", *tie).withColumn("__g", F.lit(1))
    r = value_positions(one, ["__g"], "pred", True, tie, value_bin(tie[0]), "__r")
    n = rows.agg(F.count(F.lit(1)).alias("__n")).withColumn("__g", F.lit(1))
    r = r.join(n, "__g")  # one row
    b = F.greatest(F.lit(0), F.ceil((F.col("__r") - 1) * bins / (F.col("__n") - 1)) - 1).cast("int")
    return r.withColumn("bin", b).groupBy("bin").agg(
        F.avg("pred").alias("mean_pred"), F.avg("y").alias("mean_actual"), F.count(F.lit(1)).alias("rows"), (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("se")
    )


def calibration_line(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of the outcome on the prediction."""
    return rows.groupBy(*group).agg(F.regr_slope("y", "pred").alias("slope"), F.regr_intercept("y", "pred").alias("intercept"))


def point_bin(col: str = "pred") -> Column:
    out = None
    for _, high, label in BINS[:-1]:
        out = F.when(F.col(col) < high, label) if out is None else out.when(F.col(col) < high, label)
    return out.otherwise(BINS[-1][2])


def binned_calibration(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean prediction and outcome in fixed bands of the prediction."""
    return rows.withColumn("label", point_bin()).groupBy(*group, "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("predicted"), F.avg("y").alias("actual")
    )


# ------------------------------------------------------------------ uncertainty

def mixed_index(b: Column, slot: Column, n: Column, seed: int = 0) -> Column:
    """A well-spread index below ``n`` from two counters, in plain integer arithmetic."""
    m = F.lit(2147483647).cast("long")
    x = F.pmod(b.cast("long") * 48271 + slot.cast("long") * 69621 + F.lit(seed * 31 + 12345), m)
    x = F.pmod(x * 48271, m)
    x = x.bitwiseXOR(F.shiftright(x, 13))
    x = F.pmod(x * 69621, m)
    x = x.bitwiseXOR(F.shiftright(x, 11))
    x = F.pmod(x * 16807, m)
    return F.pmod(F.shiftright(x, 7), n)


def bootstrap_means(table: DataFrame, col: str, draws: int, weight: str | None = None, seed: int = 0, strata: str = "season", order: Sequence[str] = ("GW",)) -> DataFrame:
    """(draw, estimate): weighted means over gameweeks drawn with replacement within each season.
    The table has one row per gameweek, so numbering it is cheap."""
    w = F.col(weight) if weight else F.lit(1.0)
    by = Window.partitionBy(strata).orderBy(*order)
    t = table.filter(F.col(col).isNotNull()).select(
        strata, (F.row_number().over(by) - 1).alias("slot"), F.count(F.lit(1)).over(Window.partitionBy(strata)).alias("n"),
        (F.col(col) * w).alias("num"), w.cast("double").alias("den"),
    )
    draw = t.select(strata, "n", F.col("slot").alias("from"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    draw = draw.withColumn("slot", mixed_index(F.col("draw"), F.col("from"), F.col("n"), seed))
    got = draw.select(strata, "draw", "slot").join(t.select(strata, "slot", "num", "den"), [strata, "slot"])
    return got.groupBy("draw").agg((F.sum("num") / F.sum("den")).alias("estimate"))


def confidence_interval(table: DataFrame, col: str, draws: int = 2000, weight: str | None = None, seed: int = 0, order: Sequence[str] = ("GW",)) -> DataFrame:
    """Estimate, 95 % interval and two-sided p of a mean over gameweeks."""
    w = F.col(weight) if weight else F.lit(1.0)
    est = table.filter(F.col(col).isNotNull()).agg((F.sum(F.col(col) * w) / F.sum(w)).alias("estimate"))
    d = bootstrap_means(table, col, draws, weight, seed, order=order).withColumn("e", F.round("estimate", 10))
    ci = d.agg(  # ``draws`` values
        F.percentile("e", F.lit(0.025)).alias("lo"), F.percentile("e", F.lit(0.975)).alias("hi"),
        F.avg((F.col("e") <= 0).cast("double")).alias("__a"), F.avg((F.col("e") >= 0).cast("double")).alias("__b"),
    )
    p = F.least(F.lit(1.0), 2 * F.least("__a", "__b"))
    one = F.lit(1).alias("__k")
    return est.withColumn("__k", one).join(ci.withColumn("__k", one), "__k").select("estimate", "lo", "hi", p.alias("p_two_sided"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test: twice the smaller binomial tail at one half."""
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(upto, start, step, lambda a: a["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def paired_summary(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Wins, losses, ties and sign test of two methods over the same gameweeks, per season and overall."""
    d = a.select(*GWK, F.col(col).alias("__a")).join(b.select(*GWK, F.col(col).alias("__b")), GWK).withColumn("d", F.round(F.col("__a") - F.col("__b"), 9))
    d = d.withColumn("scope", F.explode(F.array(F.col("season"), F.lit("all seasons"))))
    t = d.groupBy("scope").agg(
        F.avg("d").alias("mean_difference"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties")
    )
    return t.withColumn("sign_test_p", sign_test(F.col("wins"), F.col("losses")))


def paired_differences(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    x = a.select(*GWK, "rows", *[F.col(c).alias(f"__a_{c}") for c in cols])
    y = b.select(*GWK, *[F.col(c).alias(f"__b_{c}") for c in cols])
    return x.join(y, GWK).select(*GWK, "rows", *[(F.col(f"__a_{c}") - F.col(f"__b_{c}")).alias(c) for c in cols])


# ------------------------------------------------------------------ importance and audits

def shuffled(df: DataFrame, cols: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """``df`` with the listed columns jointly permuted over its rows.

    Rows are numbered in the orders of two digests of key and seed; a row takes the values of the row with its
    number in the other order. Beginnings of the digest keep the numbering parallel."""
    one = df.withColumn("__g", F.lit(1))

    def numbered(frame: DataFrame, s: int, out: str) -> DataFrame:
        h = frame.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(s)), *[F.col(k).cast("string") for k in key])))
        return row_positions(h, ["__g"], [F.col("__h"), *[F.col(k) for k in key]], [(F.substring("__h", 1, 3), True)], out).drop("__h")

    rest = [c for c in df.columns if c not in cols]
    left = numbered(one.select("__g", *rest), seed, "__n")
    right = numbered(one.select("__g", *key, *cols), seed + 7919, "__n").select("__n", *cols)
    return left.join(right, "__n").select(*df.columns)


def permutation_importance(predict: Callable[[DataFrame], DataFrame], rows: DataFrame, groups: dict[str, Sequence[str]], key: Sequence[str], repeats: int = 3, seed: int = 1) -> DataFrame:
    """How much the error grows and the top twenty drop when a group of inputs is permuted."""
    def score(frame: DataFrame) -> DataFrame:
        p = predict(frame)
        m = p.agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae")).withColumn("__k", F.lit(1))
        t = pick_metrics(p, spearman=False).agg(F.avg("top20").alias("top20")).withColumn("__k", F.lit(1))
        return m.join(t, "__k")

    base = score(rows).select("__k", F.col("mae").alias("__m"), F.col("top20").alias("__t"))
    parts = []
    for name, cols in groups.items():
        for r in range(repeats):
            parts.append(score(shuffled(rows, list(cols), key, seed + 101 * r)).withColumn("feature_group", F.lit(name)))
    out = reduce(lambda a, b: a.unionByName(b), parts).join(base, "__k")
    return out.groupBy("feature_group").agg(
        F.avg(F.col("mae") - F.col("__m")).alias("mae_increase"), F.avg(F.col("__t") - F.col("top20")).alias("top20_drop"), F.count(F.lit(1)).alias("repeats")
    )


def lookahead_audit(app: DataFrame, features: Callable[[DataFrame], DataFrame], outcomes: Sequence[str], season: str, gw: int, key: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """Scramble every outcome from a gameweek on, rebuild the features, and count earlier rows
    that changed (must be none) and rows of the next gameweek that changed (must be many)."""
    late = (F.col("season") == season) & (F.col("GW") >= gw)
    mixed = shuffled(app.filter(late), outcomes, row_key, 5)
    a = features(app)
    b = features(app.filter(~late).unionByName(mixed.select(app.columns)))
    cols = [c for c in a.columns if c not in key]
    near = lambda c: F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= 1e-9, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
    j = a.select(*key, *[F.col(c).cast("double").alias(f"a_{c}") for c in cols]).join(b.select(*key, *[F.col(c).cast("double").alias(f"b_{c}") for c in cols]), list(key))
    j = j.withColumn("same", reduce(lambda x, y: x & y, [near(c) for c in cols]))
    s = F.col("season")
    upto = (s < season) | ((s == season) & (F.col("GW") <= gw))
    nxt = (s == season) & (F.col("GW") == gw + 1)
    return j.agg(
        F.count_if(upto).alias("rows_up_to_gw"), F.count_if(upto & ~F.col("same")).alias("changed_up_to_gw"),
        F.count_if(nxt).alias("rows_next_gw"), F.count_if(nxt & ~F.col("same")).alias("changed_next_gw"),
    )


def single_feature_ranking(rows: DataFrame, features: Sequence[str], train: Column) -> DataFrame:
    """Top-twenty score of ranking by one feature alone, its sign chosen on training rows."""
    base = rows.select(*GWK, "name", "y", "minutes", train.alias("__tr"), *[F.col(f).cast("double").alias(f) for f in features])
    signs = base.filter("__tr").agg(*[F.when(F.coalesce(F.corr(f, "y"), F.lit(0.0)) >= 0, 1.0).otherwise(-1.0).alias(f) for f in features])
    signs = signs.unpivot([], list(features), "feature", "sign")
    test = base.filter(~F.col("__tr"))
    low = test.agg(*[F.min(f).alias(f"{f}_lo") for f in features], *[F.max(f).alias(f"{f}_hi") for f in features])
    lows = low.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_lo").alias("lo"), F.col(f"{f}_hi").alias("hi")) for f in features])).alias("x")).select("x.*")
    long = test.drop("__tr").unpivot([*GWK, "name", "y", "minutes"], list(features), "feature", "v").join(signs, "feature").join(lows, "feature")
    worst = F.when(F.col("sign") > 0, F.col("lo")).otherwise(-F.col("hi")) - 1
    scored = long.withColumn("pred", F.coalesce(F.col("sign") * F.col("v"), worst))
    return pick_metrics(scored, spearman=False, group=["feature"]).groupBy("feature", "season").agg(F.avg("top20").alias("top20"))


def row_inflation(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a feature build makes of its input."""
    k = F.lit(1).alias("__k")
    b = before.agg(F.count(F.lit(1)).alias("input_rows")).withColumn("__k", k)
    a = after.agg(F.count(F.lit(1)).alias("output_rows")).withColumn("__k", k)
    return b.join(a, "__k").select("input_rows", "output_rows", (F.col("output_rows") / F.col("input_rows")).alias("inflation_factor"))


def repeat_share(app: DataFrame, floor: int = 5) -> DataFrame:
    """Share of good matches whose next match brings the same points."""
    from touchline.functions.ordered import previous_row

    p = previous_row(app, ["element"], "kickoff_time", ["fixture", "line"], {"before": "total_points"})
    p = p.filter(F.col("before") >= floor)
    return p.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("before") == F.col("total_points")).cast("double")).alias("same_share"))


def between_group_share(rows: DataFrame, group: Sequence[str], value: str, min_rows: int = 5) -> DataFrame:
    """Share of variance between groups (one-way ANOVA), from grouped sums."""
    v = F.col(value).cast("double")
    g = rows.groupBy(*group).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).filter(F.col("n") >= min_rows)
    t = g.agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"), F.sum("s").alias("S"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"),
        F.sum("q").alias("Q"), F.sum(F.col("n") * F.col("n")).alias("N2"),
    )
    N, K = F.col("N"), F.col("K")
    msb = (F.col("B") - F.col("S") * F.col("S") / N) / (K - 1)
    msw = (F.col("Q") - F.col("B")) / (N - K)
    n0 = (N - F.col("N2") / N) / (K - 1)
    vb = F.greatest((msb - msw) / n0, F.lit(0.0))
    return t.select(N.alias("rows"), K.alias("groups"), (vb / (vb + msw)).alias("between_share"))


# ------------------------------------------------------------------ error analysis

def largest_errors(rows: DataFrame, key: Sequence[str], n: int = 15) -> DataFrame:
    r = rows.withColumn("residual", F.round(F.col("y") - F.col("pred"), 9)).select(*key, "pred", "y", "residual")
    under = r.orderBy(F.col("residual").desc(), *key).limit(n).withColumn("kind", F.lit("under"))
    over = r.orderBy(F.col("residual"), *key).limit(n).withColumn("kind", F.lit("over"))
    return under.unionByName(over)


def haul_summary(rows: DataFrame, haul: int = 10) -> DataFrame:
    """How many big scores the model had in its top twenty and fifty, per position."""
    pg = player_gameweeks(rows, [F.min("position").alias("position")])
    top = top_n(pg, GWK, [F.col("pred").desc(), F.col("name")], 50, "place").select(*GWK, "name", "place")
    big = pg.filter(F.col("actual") >= haul).join(top, [*GWK, "name"], "left")
    return big.groupBy("position").agg(
        F.count(F.lit(1)).alias("hauls"), F.avg(F.coalesce((F.col("place") <= 20).cast("double"), F.lit(0.0))).alias("in_top20"),
        F.avg(F.col("place").isNotNull().cast("double")).alias("in_top50"), F.avg("pred").alias("mean_pred"),
    )


def availability_error(rows: DataFrame) -> DataFrame:
    """Share of the error made on players who did not play, and on regulars who missed out."""
    e = F.abs(F.col("pred") - F.col("y"))
    zero = F.col("minutes") == 0
    reg = zero & F.coalesce(F.col("minutes_r3") >= 60, F.lit(False))
    return rows.agg(
        F.avg(zero.cast("double")).alias("zero_share"), F.avg(F.when(zero, F.col("pred"))).alias("zero_mean_pred"),
        (F.sum(F.when(zero, e)) / F.sum(e)).alias("zero_error_share"), F.count_if(reg).alias("regulars_out"),
        (F.sum(F.when(reg, e)) / F.sum(e)).alias("regulars_error_share"),
    )


def history_bucket(col: str = "career_matches_before") -> Column:
    c = F.col(col)
    return F.when(c == 0, "0 (debut)").when(c < 10, "1-9").when(c < 38, "10-37").otherwise("38+")


def minutes_bucket(col: str = "minutes_r3") -> Column:
    c = F.col(col)
    return F.when(c.isNull(), "no history").when(c == 0, "0").when(c <= 30, "1-30").when(c <= 60, "31-60").otherwise("61-90")


def name_collisions(app: DataFrame) -> DataFrame:
    a = app.groupBy(*GWK, "name").agg(F.count_distinct("team").alias("t")).agg(F.count_if(F.col("t") > 1).alias("player_gameweeks_with_two_teams"))
    b = app.groupBy("season", "fixture", "name").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_in_match"))
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")


def double_gameweeks(rows: DataFrame) -> DataFrame:
    """Share of players with two matches among all, the model's picks and the best scores, over
    gameweeks in which at least two teams play twice."""
    rows = written(rows.select(*GWK, "team", "fixture", "name", "pred", "y", "minutes"), "rows")
    tf = written(rows.groupBy(*GWK, "team").agg(F.count_distinct("fixture").alias("n")), "team-gameweeks")
    gws = tf.filter(F.col("n") > 1).groupBy(*GWK).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= 2).select(*GWK)
    r = match_keys(rows.join(gws, GWK, "left_semi"), tf, [*GWK, "team"])
    pg = written(player_gameweeks(r, [F.max("n").alias("n")]).withColumn("dbl", (F.col("n") > 1).cast("double")), "player-gameweeks")
    a = pg.agg(F.avg("dbl").alias("share_all")).withColumn("__k", F.lit(1))
    p = top_n(pg, GWK, [F.col("pred").desc(), F.col("name")], 20).agg(F.avg("dbl").alias("share_picks")).withColumn("__k", F.lit(1))
    b = top_n(pg, GWK, [F.col("actual").desc(), F.col("name")], 20).agg(F.avg("dbl").alias("share_best")).withColumn("__k", F.lit(1))
    g = gws.agg(F.count(F.lit(1)).alias("gameweeks")).withColumn("__k", F.lit(1))
    return a.join(p, "__k").join(b, "__k").join(g, "__k").drop("__k")


def by_phase(table: DataFrame, early: int = 5) -> DataFrame:
    """Pick metrics early and later in the season, per season and overall."""
    t = table.withColumn("phase", F.when(F.col("GW") <= early, f"GW1-{early}").otherwise(f"GW{early + 1}+"))
    t = t.withColumn("scope", F.explode(F.array(F.col("season"), F.lit("all seasons"))))
    return t.groupBy("scope", "phase").agg(F.count(F.lit(1)).alias("gameweeks"), F.avg("top20").alias("top20"), F.avg("spearman").alias("spearman"))


# ------------------------------------------------------------------ back-tests

def gameweek_table(rows: DataFrame, subsets: dict[str, Column] | None = None) -> DataFrame:
    """Per gameweek: error sums overall, per subset and position; top picks, the captain (vice
    when the captain did not play), share of picks who did not play, picks per position."""
    e = F.col("pred") - F.col("y")
    cols = [F.sum(e * e).alias("se"), F.sum(F.abs(e)).alias("ae"), F.count(F.lit(1)).alias("rows")]
    for n, c in (subsets or {}).items():
        cols += [F.sum(F.when(c, e * e).otherwise(0.0)).alias(f"se_{n}"), F.sum(F.when(c, e).otherwise(0.0)).alias(f"err_{n}"), F.count_if(c).alias(f"n_{n}")]
    for p in ("GK", "DEF", "MID", "FWD"):
        on = F.col("position") == p
        cols += [F.sum(F.when(on, e).otherwise(0.0)).alias(f"perr_{p}"), F.count_if(on).alias(f"pn_{p}")]
    err = rows.groupBy(*GWK).agg(*cols)
    pg = written(player_gameweeks(rows, [F.min("position").alias("position")]), "player-gameweeks")
    size = pg.groupBy(*GWK).agg(F.count(F.lit(1)).alias("players"))
    top = top_n(pg, GWK, [F.col("pred").desc(), F.col("name")], 50, "r")
    one = lambda c, k: F.max(F.when(F.col("r") == k, F.col(c)))
    cut = lambda c, k: F.avg(F.when(F.col("r") <= k, F.col(c)))
    picks = top.groupBy(*GWK).agg(
        cut("actual", 20).alias("top20"), cut("actual", 50).alias("top50"), one("actual", 1).alias("capt"),
        F.when((one("minutes", 1) > 0) | one("actual", 2).isNull(), one("actual", 1)).otherwise(one("actual", 2)).alias("capt_fpl"),
        cut("pred", 20).alias("pred20"), one("pred", 1).alias("pred_capt"), F.avg(F.when(F.col("r") <= 20, (F.col("minutes") == 0).cast("double"))).alias("dnp20"),
    )
    per = top_n(pg, [*GWK, "position"], [F.col("pred").desc(), F.col("name")], 10, "q")
    depth = {"GK": 3, "DEF": 10, "MID": 10, "FWD": 5}
    pos = per.groupBy(*GWK).agg(*[
        F.when(F.count_if((F.col("position") == p) & (F.col("q") <= k)) == k, F.avg(F.when((F.col("position") == p) & (F.col("q") <= k), F.col("actual")))).alias(f"top_{p}")
        for p, k in depth.items()
    ])
    out = err.join(size, GWK).join(picks, GWK).join(pos, GWK)
    return out.join(rank_correlation(pg, GWK), GWK)


def table_summary(t: DataFrame) -> DataFrame:
    """Pooled errors and mean pick metrics of a gameweek table."""
    return t.agg(
        F.sqrt(F.sum("se") / F.sum("rows")).alias("rmse"), (F.sum("ae") / F.sum("rows")).alias("mae"), *[F.avg(c).alias(c) for c in ("top20", "top50", "capt", "capt_fpl", "spearman", "dnp20")],
        *[(F.sum(f"perr_{p}") / F.sum(f"pn_{p}")).alias(f"bias_{p}") for p in ("GK", "DEF", "MID", "FWD")], F.count(F.lit(1)).alias("gameweeks"),
    )


def track_record(rows: DataFrame, group: Sequence[str] = GWK, n: int = 10) -> DataFrame:
    """A gameweek's record: error on players both forecasts cover, top ten of both and the best
    possible, captain's hit. Rows: element, pred, rival (nullable), y, minutes, has_fixture."""
    g = list(group)
    on, both = F.col("minutes") > 0, F.col("rival").isNotNull()
    err = rows.groupBy(*g).agg(
        F.count_if(on & both).alias("__both"), F.count_if(on).alias("__on"),
        F.avg(F.when(on & both, F.abs(F.col("pred") - F.col("y")))).alias("__mb"), F.avg(F.when(on, F.abs(F.col("pred") - F.col("y")))).alias("__mo"),
        F.avg(F.when(on & both, F.abs(F.col("rival") - F.col("y")))).alias("mae_rival"), F.count_if(F.col("has_fixture")).alias("players"),
    )
    shared = F.col("__both") > 0
    err = err.select(*g, "players", F.when(shared, F.col("__mb")).otherwise(F.col("__mo")).alias("mae_model"), "mae_rival", F.when(shared, F.col("__both")).otherwise(F.col("__on")).alias("n"))
    cand = rows.filter("has_fixture")
    mine = top_n(cand, g, [F.col("pred").desc(), F.col("element")], n, "r").groupBy(*g).agg(
        F.sum("y").alias("top_model"), F.count(F.lit(1)).alias("__n"), F.max(F.when(F.col("r") == 1, F.col("element"))).alias("captain"), F.max(F.when(F.col("r") == 1, F.col("y"))).alias("captain_points"))
    rival = top_n(cand.filter(both), g, [F.col("rival").desc(), F.col("element")], n, "r").groupBy(*g).agg(F.sum("y").alias("__rv"), F.count(F.lit(1)).alias("__rn"))
    best = top_n(rows, g, [F.col("y").desc(), F.col("element")], n, "r").groupBy(*g).agg(F.sum("y").alias("top_best"))
    out = match_keys(match_keys(match_keys(err, mine, g), rival, g), best, g)
    return out.select(*g, "players", "mae_model", "mae_rival", "n", "top_model", F.when(F.col("__n") == F.col("__rn"), F.col("__rv")).alias("top_rival"), "top_best",
                      "captain", "captain_points", (F.col("captain_points") >= CAPTAIN_HIT).alias("captain_hit"))


def record_totals(t: DataFrame) -> DataFrame:
    """Season totals of track records; comparisons pool only gameweeks with both forecasts."""
    p, q = F.col("mae_rival").isNotNull(), F.col("top_rival").isNotNull()
    return t.groupBy("season").agg(
        F.count(F.lit(1)).alias("gameweeks"), (F.sum(F.when(p, F.col("mae_model") * F.col("n"))) / F.sum(F.when(p, F.col("n")))).alias("mae_model"),
        (F.sum(F.when(p, F.col("mae_rival") * F.col("n"))) / F.sum(F.when(p, F.col("n")))).alias("mae_rival"),
        F.avg(F.when(q, F.col("top_model"))).alias("top_model"), F.avg(F.when(q, F.col("top_rival"))).alias("top_rival"), F.avg(F.when(q, F.col("top_best"))).alias("top_best"),
        F.count_if("captain_hit").alias("captain_hits"), F.avg("captain_points").alias("captain_mean"),
        F.count_if(p & (F.col("mae_model") < F.col("mae_rival"))).alias("mae_wins"), F.count_if(q & (F.col("top_model") > F.col("top_rival"))).alias("top_wins"),
    )


def last_capture(captures: DataFrame, deadlines: DataFrame, value: str) -> DataFrame:
    """Every player's forecast in the latest capture at or before the deadline of a gameweek."""
    c = captures.join(deadlines, GWK).filter(F.col("captured_at") <= F.col("deadline"))
    last = c.groupBy(*GWK).agg(F.max("captured_at").alias("__at"))
    return c.join(last, GWK).filter(F.col("captured_at") == F.col("__at")).select(*GWK, "element", value)


def projection_quality(proj: DataFrame, actual: DataFrame, top: int = 20) -> DataFrame:
    """Errors, correlation and top picks by how many gameweeks ahead a projection looked."""
    d = proj.join(actual.select("season", F.col("GW").alias("gameweek"), "element", F.col("points").cast("double").alias("points")), ["season", "gameweek", "element"], "left")
    d = d.withColumns({"points": F.coalesce("points", F.lit(0.0)), "step": F.col("gameweek") - F.col("deadline_gw") + 1})
    e = F.col("predicted_points") - F.col("points")
    base = d.groupBy("step").agg(F.count(F.lit(1)).alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("predicted_points", "points").alias("corr"))
    t = top_n(d, ["step", "season", "deadline_gw"], [F.col("predicted_points").desc(), F.col("element")], top)
    per = t.groupBy("step", "season", "deadline_gw").agg(F.avg("points").alias("m"))
    return base.join(per.groupBy("step").agg(F.avg("m").alias("top_actual")), "step").join(t.groupBy("step").agg(F.avg(e).alias("top_bias")), "step")


def flag_factors(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Outcome of flagged players relative to unflagged ones of the same stratum."""
    base = rows.filter(F.col("flag") == "a").groupBy("stratum").agg(*[F.avg(m).alias(f"__{m}") for m in measures])
    j = rows.join(base, "stratum")
    return j.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), *[
        F.when(F.sum(f"__{m}") > 0, F.sum(m) / F.sum(f"__{m}")).alias(m) for m in measures
    ])


def coverage(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Per season: gameweeks with a capture or a stale one, and the share of rows with features."""
    w = windows.groupBy("season").agg(F.count(F.lit(1)).alias("gws"), F.count("sha").alias("with_snapshot"), F.count_if("stale").alias("stale"))
    r = rows.groupBy("season").agg(F.avg(F.col("snap_age_days").isNotNull().cast("double")).alias("rows"))
    return w.join(r, "season")


def input_share(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of rows that have each input."""
    one = rows.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    return one.unpivot([], list(cols), "input", "share")


def drift(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature, with the reference's percentile bins.

    Values outside the reference range are in no bin but stay in the denominator."""
    long = lambda df: df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "v").filter(F.col("v").isNotNull())
    ref, cur = long(reference), long(current)
    edges = exact_quantiles(ref, ["feature"], "v", [i / bins for i in range(bins + 1)])
    # distinct edges of a feature: at most ``bins`` + 1
    per = edges.groupBy("feature").agg(F.array_sort(F.collect_set("v")).alias("e"))

    def share(df: DataFrame, out: str) -> DataFrame:
        n = F.size("e")
        at = F.size(F.filter("e", lambda x: x <= F.col("v")))
        b = F.when((F.col("v") < F.element_at("e", 1)) | (F.col("v") > F.element_at("e", -1)), F.lit(None)).otherwise(F.least(at, n - 1))
        # equal values are counted once, and a feature's values meet its edges in parts
        values = df.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("m")).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
        parts = per.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        c = values.join(parts, ["feature", "part"]).withColumn("bin", b).groupBy("feature", "bin").agg(F.sum("m").alias("m"))
        tot = c.groupBy("feature").agg(F.sum("m").alias("t"))
        return c.filter(F.col("bin").isNotNull()).join(tot, "feature").select("feature", "bin", (F.col("m") / F.col("t")).alias(out))

    grid = per.select("feature", F.explode(F.sequence(F.lit(1), F.size("e") - 1)).alias("bin")).filter(F.col("bin") >= 1)
    j = grid.join(share(ref, "r"), ["feature", "bin"], "left").join(share(cur, "c"), ["feature", "bin"], "left")
    a, x = F.coalesce("c", F.lit(0.0)) + 1e-10, F.coalesce("r", F.lit(0.0)) + 1e-10
    psi = j.groupBy("feature").agg(F.sum((a - x) * F.log(a / x)).alias("psi"))
    return psi.withColumn("state", F.when(F.col("psi") >= 0.2, "significant").when(F.col("psi") >= 0.1, "moderate").otherwise("stable"))


def retrain_needed(d: DataFrame, at_least: int = 3) -> DataFrame:
    return d.agg(F.count_if(F.col("psi") >= 0.2).alias("drifted"), F.max("psi").alias("max_psi"), F.avg("psi").alias("avg_psi")).withColumn("retrain", F.col("drifted") >= at_least)


def top_k_quality(rows: DataFrame, k: int = 10) -> DataFrame:
    """Per gameweek hit rate, discounted gain and share of the best points of the top ``k``.
    Rows: one per player and gameweek with ``element``."""
    p = top_n(rows, GWK, [F.col("pred").desc(), F.col("element")], k, "r").select(*GWK, "element", "r", F.col("y").alias("got"))
    a = top_n(rows, GWK, [F.col("y").desc(), F.col("element")], k, "q").select(*GWK, "element", "q", F.col("y").alias("best"))
    j = p.join(a, [*GWK, "element"], "full")
    hit = F.col("r").isNotNull() & F.col("q").isNotNull()
    ideal = sum(1.0 / __import__("math").log2(i + 1) for i in range(1, k + 1))
    t = j.groupBy(*GWK).agg(
        (F.count_if(hit) / k).alias("hit_rate"), (F.sum(F.when(hit, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)) / ideal).alias("ndcg"),
        F.sum("best").alias("optimal_points"), F.sum("got").alias("captured_points"),
    )
    t = t.withColumn("capture_rate", F.when(F.col("optimal_points") > 0, F.col("captured_points") / F.col("optimal_points")).otherwise(0.0))
    pg = rows.select(*GWK, F.round("pred", 9).alias("pred"), F.col("y").alias("actual"))
    return t.join(rank_correlation(pg, GWK), GWK)


def earlier_mean_baseline(rows: DataFrame, value: str) -> DataFrame:
    """Mean error per season and position of predicting the mean of all earlier seasons."""
    per = rows.groupBy("season", "position").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    up = Window.partitionBy("position").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    mean = per.select("season", "position", (F.sum("s").over(up) / F.sum("n").over(up)).alias("m")).filter(F.col("m").isNotNull())
    return rows.join(mean, ["season", "position"]).groupBy("season", "position").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(value) - F.col("m"))).alias("mae"))


def ensemble_gain(ens: DataFrame, singles: DataFrame, col: str, draws: int = 2000) -> DataFrame:
    """Gain of averaged predictions over the mean single seed per gameweek, with an interval."""
    one = singles.groupBy(*GWK).agg(F.avg(col).alias("__s"))
    d = ens.join(one, GWK).select(*GWK, (F.col(col) - F.col("__s")).alias("gain"))
    d = d.withColumn("__s", F.col("season")).withColumn("season", F.lit("all"))
    return confidence_interval(d, "gain", draws, order=["__s", "GW"])
