"""Queries for models (M) and the evaluations that train one (E11, E31 to E34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import derived as D
from touchline.operators import evaluation as E
from touchline.operators import models as M
from touchline.operators import players as P
from touchline.operators import temporal as X
from touchline.plans import roles
from touchline.plans.assess import CTES, er, form_rows
from touchline.plans.features import KEY, ROW, app, fx, pl, six, snap_rows, match_events, tm
from touchline.plans.registry import add
from touchline.plans.roles import CURRENT, ctes
from touchline.session import written

COLS = ["total_points_r3", "total_points_r6", "minutes_r3", "season_ppg", "value", "selected"]
SEASONS = ["1995-96", "1996-97", "1997-98", "1998-99", "1999-00", "2000-01", "2001-02"]
TREES = 4


def rows(s, d, *more):
    """Prediction rows with the columns asked for, made once: every fold, label and pass of a fit reads them again."""
    own = [c for c in more if c not in (*KEY, *ROW, "minutes", "starts")]
    r = form_rows(s, d, ("value", "selected", *own))
    return written(r.select("season", "GW", *more, "y", *COLS), "points-rows")


def split(r):
    return r.filter("season < '1999-00'"), r.filter("season = '1999-00'"), r.filter("season > '1999-00'")


def trained(s, d, *more, seeds=(0,)):
    tr, va, te = split(rows(s, d, *more))
    return M.fit_points(tr, va, COLS, "y", TREES, 3, seeds), te


def _m1(s, d):
    tr, va, te = split(rows(s, d))
    m = M.fit_stopped(tr, va, COLS, "y")
    return six(E.row_metrics(m.predict(te), ["season"]))


add("M1_points_model", _m1)


def _m2(s, d):
    tr, va, te = split(rows(s, d))
    return six(E.row_metrics(M.fit_ensemble(tr, va, COLS, "y", TREES, (0, 1)).predict(te), ["season"]))


add("M2_seed_ensemble", _m2)


def _m3(s, d):
    m, te = trained(s, d, "element")
    return six(M.score_rows(te, m.predict))


add("M3_score_rows", _m3)


def _m4(s, d):
    m, te = trained(s, d, "element")
    r = te.withColumn("step", F.col("GW") % 4 + 1).join(pl(s, d).select("element", "status", "chance_next"), "element")
    return M.project(r, m.predict, lambda step: X.horizon_availability(step), 4)


add("M4_project", _m4)


def _m5(s, d):
    tr, _, te = split(rows(s, d, "position", "minutes", "starts").withColumn("started", F.coalesce("starts", (F.col("minutes") >= 60).cast("int"))))
    out = M.start_and_minutes(tr, te, COLS, 2)
    return six(out.groupBy("position").agg(F.count("*").alias("n"), F.avg("start_probability").alias("start_probability"), F.avg("minutes_if_started").alias("minutes_if_started")))


add("M5_start_and_minutes", _m5)
_CELL = {
    "tr": "SELECT * FROM er WHERE season < '1999-00'", "te": "SELECT * FROM er WHERE season >= '1999-00'",
    "ed": "SELECT position, [" + ", ".join(f"quantile_cont(pred, {i / 10})" for i in range(1, 10)) + "] AS e FROM tr GROUP BY position",
    "qc": "SELECT position, cell, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90 FROM (SELECT tr.position, len(list_filter(e, lambda x: x < pred)) AS cell, y FROM tr JOIN ed USING (position)) GROUP BY position, cell",
    "tq": "SELECT te.position, te.element, te.fixture, te.line, y, len(list_filter(e, lambda x: x < pred)) AS cell FROM te JOIN ed USING (position)",
    "qq": "SELECT tq.*, p10, p50, p90 FROM tq LEFT JOIN qc USING (position, cell)",
}


def _quant(s, d):
    r = er(s, d)
    return M.conditional_quantiles(r.filter("season < '1999-00'"), r.filter("season >= '1999-00'"))


add("M6_conditional_quantiles", lambda s, d: six(_quant(s, d).select(*ROW, "p10", "p50", "p90")), ctes("er", extra=_CELL) + "SELECT element, fixture, line, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM qq")
add("M6_pinball_loss", lambda s, d: six(M.pinball_loss(_quant(s, d))), ctes("er", extra=_CELL) + "SELECT position, count(*) AS n, " + ", ".join(f"round(avg(greatest((y - p{q}) * {q / 100}, (y - p{q}) * ({q / 100} - 1))), 6) AS loss_p{q}" for q in (10, 50, 90)) + " FROM qq GROUP BY position")
STATS = ("goals_scored", "assists", "clean_sheets", "goals_conceded", "saves", "bonus", "bps", "influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists", "total_points")


def _vectors(s, d):
    a = app(s, d).groupBy("season", "name").agg(F.sum("minutes").alias("minutes"), *[F.sum(c).cast("double").alias(c) for c in STATS])
    return M.per_90_vectors(a.filter("minutes >= 90"), STATS)


def _m7(s, d):
    out, score = M.cluster(_vectors(s, d).select("season", "name", *[f"v_{c}" for c in STATS]).na.fill(0.0), STATS)
    return six(out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("v_bps").alias("bps")).withColumn("silhouette", F.lit(score)))


add("M7_cluster", _m7)


def _m8(s, d):
    t = D.team_season_estimates(app(s, d)).select("team", "season", F.col("goals_per_game").alias("a"), F.col("clean_sheets").cast("double").alias("b"), F.col("points_per_game").alias("y"))
    return six(M.leave_one_out(t, ["a", "b"], "y").select("team", "season", "y", "predicted"))


_RIDGE = {
    "g": "SELECT season, team, GW, sum(goals_scored) AS g, max(clean_sheets) FILTER (WHERE position = 'DEF') AS cs FROM app GROUP BY season, team, GW",
    "u": "SELECT season, team, count(*) AS m, sum(g) AS goals, coalesce(sum(cs), 0) AS cs, count(cs) AS nd FROM g GROUP BY season, team",
    "t": "SELECT season, team, CAST(goals AS DOUBLE) / m AS a, CAST(cs AS DOUBLE) AS b, CAST(cs * 3 + m - cs - greatest(0, m - cs - (m - cs) // 3) AS DOUBLE) / m AS y FROM u",
    "p": "SELECT team, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM t GROUP BY team",
    "r": "SELECT p.team, " + ", ".join(f"w.{c} - p.{c} AS {c}" for c in ("n", "a", "b", "y", "aa", "ab", "bb", "ay", "by_")) + " FROM p, (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in ("n", "a", "b", "y", "aa", "ab", "bb", "ay", "by_")) + " FROM p) w",
    "c": "SELECT team, a / n AS ma, b / n AS mb, y / n AS my, aa - a * a / n AS saa, ab - a * b / n AS sab, bb - b * b / n AS sbb, ay - a * y / n AS say, by_ - b * y / n AS sby, sqrt((aa - a * a / n) / n) AS da, sqrt((bb - b * b / n) / n) AS db FROM r WHERE n > 0",
    "z": "SELECT *, saa / (da * da) + 1 AS k1, sbb / (db * db) + 1 AS k2, sab / (da * db) AS k3, say / da AS t1, sby / db AS t2 FROM c",
    "w": "SELECT *, (k2 * t1 - k3 * t2) / (k1 * k2 - k3 * k3) / da AS wa, (k1 * t2 - k3 * t1) / (k1 * k2 - k3 * k3) / db AS wb FROM z",
}
add("M8_leave_one_out", _m8, ctes("app", extra=_RIDGE) + "SELECT t.team, season, round(y, 6) AS y, round(my + wa * (a - ma) + wb * (b - mb), 6) AS predicted FROM t LEFT JOIN w USING (team)")


def _translation(s, d):
    """Promoted clubs' sums: the first half of a season stands for the lower tier, the second for the upper one."""
    lower = F.col("GW") <= 6
    part = lambda c, half: F.sum(F.when(half, F.col(c))).cast("double")
    t = app(s, d).groupBy("team", "season").agg(
        part("goals_scored", lower).alias("g"), part("assists", lower).alias("a"), part("minutes", lower).alias("lower_minutes"), F.count_if(lower).alias("player_count"),
        part("goals_scored", ~lower).alias("tg"), part("assists", ~lower).alias("ta"), part("total_points", ~lower).alias("tp"))
    n = F.when(F.col("player_count") > 0, F.col("player_count"))
    return t.select("team", "season", "lower_minutes", F.col("player_count").cast("double").alias("player_count"),
                    *[(F.col(c) / n).alias(o) for c, o in (("g", "lower_goals_per_match"), ("a", "lower_assists_per_match"), ("tg", "top_goals_per_match"), ("ta", "top_assists_per_match"), ("tp", "top_points_per_player"))])


add("M8_team_translation", lambda s, d: six(M.team_translation(
    _translation(s, d), ["lower_goals_per_match", "lower_assists_per_match", "lower_minutes", "player_count"], ["top_goals_per_match", "top_assists_per_match", "top_points_per_player"])))


def _m9(s, d):
    return six(M.expected_goals(M.poisson_ratings(fx(s, d)), fx(s, d).filter("status = 'scheduled'")))


sided = roles.sided_appearances
add("M9_poisson_ratings", _m9)


def _lams(s, d):
    return fx(s, d).select("id", (0.4 + F.pmod(F.floor("total_price"), F.lit(250)) / 100.0).alias("lam_h"), (0.3 + F.pmod(F.floor(F.col("total_price") / 7), F.lit(200)) / 100.0).alias("lam_a"))


add("M10_match_probabilities", lambda s, d: six(M.match_probabilities(_lams(s, d))),
    ctes("fx", extra={
        "l": "SELECT id, 0.4 + (CAST(floor(total_price) AS BIGINT) % 250) / 100 AS lh, 0.3 + (CAST(floor(total_price / 7) AS BIGINT) % 200) / 100 AS la FROM fx",
        "g": "SELECT id, lh, la, h, a, exp(-lh - la) * pow(lh, h) * pow(la, a) / (gamma(h + 1) * gamma(a + 1)) AS p FROM l, (SELECT unnest(range(12)) AS h), (SELECT unnest(range(12)) AS a)",
        "r": "SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, h, a) AS k FROM g"})
    + "SELECT id, round(any_value(lh), 6) AS lam_h, round(any_value(la), 6) AS lam_a, round(sum(p) FILTER (WHERE h > a) / sum(p), 6) AS home_win, round(sum(p) FILTER (WHERE h = a) / sum(p), 6) AS draw, round(sum(p) FILTER (WHERE h < a) / sum(p), 6) AS away_win, string_agg(CAST(h AS STRING) || '-' || CAST(a AS STRING), ',' ORDER BY k) FILTER (WHERE k <= 3) AS likeliest, round(exp(-any_value(la)), 6) AS clean_sheet_home, round(exp(-any_value(lh)), 6) AS clean_sheet_away FROM r GROUP BY id")
add("M11_expected_points", lambda s, d: six(M.expected_points(app(s, d)).select(*ROW, "xpts")))


def _flagged(s, d):
    """Predictions with a chance of playing from the fixture number."""
    return er(s, d).withColumn("chance", F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.75, 0.5, 0.25, 0.0, 1.0, 1.0)]), (F.col("fixture") % 7 + 1).cast("int")))


_FC = {"x": "SELECT *, [1.0, 0.75, 0.5, 0.25, 0.0, 1.0, 1.0][fixture % 7 + 1]::DOUBLE AS chance FROM er",
       "b": "SELECT sum(y) / sum(greatest(pred, 0)) AS base FROM x WHERE chance = 1",
       "f": "SELECT flag, literal, count(*) AS n, sum(y) / any_value(base) AS a, sum(greatest(pred, 0)) AS p FROM x JOIN (VALUES ('d75', 0.75::DOUBLE), ('d50', 0.5), ('d25', 0.25), ('out', 0)) v(flag, literal) ON chance = literal, b GROUP BY flag, literal",
       "ff": "SELECT flag, literal, n, least(greatest((a + 50 * literal) / (p + 50), 0), 1.5) AS factor, CASE WHEN p > 0 THEN a / p END AS raw FROM f"}
add("M12_flag_multipliers", lambda s, d: six(M.flag_multipliers(_flagged(s, d))), ctes("er", extra=_FC) + "SELECT flag, literal, n AS \"rows\", round(factor, 6) AS factor, round(raw, 6) AS raw FROM ff")
add("M12_apply_multipliers", lambda s, d: six(M.apply_multipliers(_flagged(s, d), M.flag_multipliers(_flagged(s, d))).select(*ROW, "adjusted")), ctes("er", extra=_FC) + "SELECT element, fixture, line, round(pred * coalesce(factor, 1), 6) AS adjusted FROM x LEFT JOIN ff ON ff.literal = x.chance")
_TP = {"k": "SELECT position, quantile_cont(pred, 0.9) AS kappa FROM er WHERE season < '1999-00' GROUP BY position",
       "h": "SELECT er.*, kappa, greatest(pred - kappa, 0) AS h FROM er JOIN k USING (position) WHERE season < '1999-00'",
       "p": "SELECT position, max(kappa) AS kappa, CASE WHEN sum(h * h) > 0 THEN least(greatest(sum(h * (pred - y)) / sum(h * h), 0), 0.6) ELSE 0 END AS lam, count(*) AS n FROM h GROUP BY position"}


def _tail(s, d):
    return M.tail_parameters(er(s, d).filter("season < '1999-00'"), ["position"])


add("M13_tail_parameters", lambda s, d: six(_tail(s, d)), ctes("er", extra=_TP) + "SELECT position, round(kappa, 6) AS kappa, round(lam, 6) AS lam, n AS \"rows\" FROM p")
add("M13_tail_shrink", lambda s, d: six(M.tail_shrink(er(s, d).filter("season >= '1999-00'"), _tail(s, d), ["position"]).select(*ROW, "shrunk")), ctes("er", extra=_TP) + "SELECT element, fixture, line, round(pred - lam * greatest(pred - kappa, 0), 6) AS shrunk FROM er JOIN p USING (position) WHERE season >= '1999-00'")
add("M14_defensive_scale", lambda s, d: six(M.defensive_scale(app(s, d).select("season", (F.col("threat") / 10).alias("dc_hat"), F.coalesce(X.dc_points(), F.lit(0.0)).alias("dc_pts")), "1998-99")),
    ctes("app", extra={"x": "SELECT threat / 10 AS h, CASE WHEN defensive_contribution IS NULL OR position = 'GK' THEN 0 WHEN defensive_contribution >= CASE position WHEN 'DEF' THEN 10 ELSE 12 END THEN 2 ELSE 0 END AS p FROM app WHERE season >= '1998-99' AND threat > 0"}) + "SELECT count(*) AS \"rows\", round(CASE WHEN count(*) >= 1000 THEN least(greatest(sum(h * p) / sum(h * h), 0), 2) ELSE 1 END, 6) AS alpha FROM x")
add("M15_season_weights", lambda s, d: six(M.season_weights(app(s, d), 2.0)),
    ctes("app", extra={"x": "SELECT season, count(*) AS n, pow(0.5, (max(CAST(substr(season, 1, 4) AS INT)) OVER () - CAST(substr(season, 1, 4) AS INT)) / 2.0) AS w FROM app GROUP BY season"}) + "SELECT season, n, round(w / (sum(w * n) OVER () / sum(n) OVER ()), 6) AS weight FROM x")


def _methods(s, d):
    """Top-twenty means of three ways to rank: the prediction, the bonus score and the price."""
    a = written(app(s, d).select("season", "GW", "name", "minutes", "predicted_points", "bps", "value", "total_points"), "gate-rows")
    out = []
    for m, e in (("v4", F.col("predicted_points")), ("bps", F.col("bps") / 10.0), ("price", F.col("value") / 10.0)):
        r = a.withColumns({"pred": e, "y": F.col("total_points").cast("double")})
        out.append(E.pick_metrics(r, spearman=False).agg(F.round(F.avg("top20"), 9).alias("top20")).withColumn("method", F.lit(m)))
    return written(out[0].unionByName(out[1]).unionByName(out[2]), "methods")


_MT = {}
for _m, _e in (("v4", "predicted_points"), ("bps", "bps / 10"), ("price", "value / 10")):
    _MT[f"g_{_m}"] = f"SELECT season, GW, name, round(sum({_e}), 9) AS pred, sum(total_points) AS actual FROM app GROUP BY ALL"
    _MT[f"r_{_m}"] = f"SELECT *, row_number() OVER (PARTITION BY season, GW ORDER BY pred DESC, name) AS r, count(*) OVER (PARTITION BY season, GW) AS n FROM g_{_m}"
    _MT[f"t_{_m}"] = f"SELECT avg(t) AS t FROM (SELECT sum(actual) FILTER (WHERE r <= 20) / least(20, any_value(n)) AS t FROM r_{_m} GROUP BY season, GW HAVING any_value(n) >= 30)"
def _m16(s, d):
    m = _methods(s, d)
    return six(M.passes_gate(m, m.filter("method = 'v4'").withColumn("top20", F.col("top20") + 0.5), "v4"))


add("M16_passes_gate", _m16,
    ctes("app", extra=_MT) + "SELECT round(v.t, 6) AS top20, round(greatest(b.t, p.t), 6) AS best_baseline, round(v.t + 0.5, 6) AS active, v.t > greatest(b.t, p.t) AND v.t >= (v.t + 0.5) * 0.9 AS passes FROM t_v4 v, t_bps b, t_price p")


def _m17(s, d):
    tr, _, te = split(rows(s, d, "minutes"))
    return six(E.row_metrics(M.hurdle(tr, te, COLS, 2), ["season"]))


add("M17_hurdle", _m17)


def _probs(s, d):
    """Quality labels against a score from the text's length."""
    docs = roles.table(s, d, "documents").join(roles.table(s, d, "labels"), "doc_id")
    return docs.select("doc_id", F.col("quality").cast("double").alias("label"), (1 / (1 + F.exp(-(F.log("n_chars") - 6)))).alias("prob"))


def _m18(s, d):
    """Fitted on documents with an even number, judged on the others."""
    p = _probs(s, d)
    return six(M.calibration_gap(M.platt(p.filter("doc_id % 2 = 0"), p.filter("doc_id % 2 = 1")), "calibrated"))


add("M18_platt", _m18)
add("M18_calibration_gap", lambda s, d: six(M.calibration_gap(_probs(s, d), "prob")),
    "WITH x AS (SELECT CAST(quality AS DOUBLE) AS y, 1 / (1 + exp(-(ln(n_chars) - 6))) AS p FROM documents JOIN labels USING (doc_id)) SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_prob, round(avg(y), 6) AS frequency, round(abs(avg(p) - avg(y)), 6) AS gap FROM x GROUP BY 1")


def _neigh(s, d):
    """Vectors of the first label find their five most similar vectors of the others."""
    from touchline.operators.neighbours import nearest

    e = roles.table(s, d, "embeddings")
    new, old = e.filter("label = 0"), e.filter("label <> 0")
    n = nearest(new, old, "vec_id", "embedding", 5)
    return n.select(F.col("query_id").alias("item"), "similarity", (F.col("item_id") % 9).cast("double").alias("outcome")), new.select(F.col("vec_id").alias("item"), F.lit("MID").alias("position"))


_DOT = "list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding)))"
add("M19_archetype_prediction", lambda s, d: six(M.archetype_prediction(*_neigh(s, d))),
    f"WITH n AS (SELECT a.vec_id AS item, b.vec_id AS o, round(({_DOT})::DOUBLE, 6) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(({_DOT})::DOUBLE, 6) DESC, b.vec_id) AS k FROM (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings) b ON a.label = 0 AND b.label <> 0), w AS (SELECT *, CASE WHEN s > 0.85 THEN 1.0 WHEN s > 0.70 THEN 0.6 ELSE 0.3 END AS w FROM n WHERE k <= 5) SELECT item, 'MID' AS position, round(sum(o % 9 * w) / sum(w), 6) AS prediction FROM w GROUP BY item")


def _scaled(s, d):
    a = app(s, d).select(*ROW, "position", "GW", F.col("goals_scored").cast("double").alias("goals_scored"), F.col("bonus").cast("double").alias("bonus"), (F.col("total_points") / 2.0).alias("form"), F.col("predicted_points").alias("current_form"), (F.col("fixture") % 2 == 0).alias("from_lower"))
    return a


add("M19_scale_league", lambda s, d: six(M.scale_league(_scaled(s, d)).select(*ROW, "goals_scored", "bonus", "form", "league_origin")), ctes("app") + "SELECT element, fixture, line, round(goals_scored * 0.70, 6) AS goals_scored, round(bonus * 0.65, 6) AS bonus, round(total_points / 2.0 * 0.70, 6) AS form, 0.70::DOUBLE AS league_origin FROM app")
_BASE = "CASE position WHEN 'GK' THEN 3.2 WHEN 'DEF' THEN 3.8 WHEN 'MID' THEN 4.1 ELSE 4.5 END"
_LOW = "total_points / 2.0 * CASE WHEN fixture % 2 = 0 THEN 1 ELSE 0.7 END"
add("M20_blended", lambda s, d: six(M.blended(_scaled(s, d)).select(*ROW, "blended")),
    ctes("app") + f"SELECT element, fixture, line, round(CASE WHEN GW <= 6 THEN 0.7 * {_BASE} + 0.3 * {_LOW} WHEN GW <= 12 THEN (0.70 - (GW - 7) / 6 * 0.50) * {_BASE} + (0.30 - (GW - 7) / 6 * 0.10) * {_LOW} + (GW - 7) / 6 * 0.60 * predicted_points ELSE 0.1 * {_BASE} + 0.1 * {_LOW} + 0.8 * predicted_points END, 6) AS blended FROM app")


# ---------------------------------------------------------------- evaluations with a model
def _e11(s, d):
    m, te = trained(s, d, "name", "minutes", *ROW)
    return six(E.permutation_importance(m.predict, te, {"form": COLS[:3], "season_to_date": COLS[3:4], "price_ownership": COLS[4:]}, ROW))


add("E11_permutation_importance", _e11)


def _e31(s, d):
    """Share of the model's total gain per input group."""
    m, _ = trained(s, d)
    weights = m.members[0].stages[-1].featureImportances.toArray()
    names = [f"x_{c}" for c in COLS] + [f"x_{c}_missing" for c in COLS]
    group = lambda n: "form" if "_r3" in n or "_r6" in n else "season_to_date" if "ppg" in n else "price_ownership"
    imp = s.createDataFrame([(n, group(n), float(w)) for n, w in zip(names, weights)], "input string, feature_group string, importance double")
    return six(imp.groupBy("feature_group").agg(F.sum("importance").alias("importance"), F.count("*").alias("inputs")))


add("E31_importance_by_group", _e31)


def _e32(s, d):
    """One gameweek replayed with the history before it, against the mean of the last matches."""
    r = rows(s, d, "name", "minutes")
    hist = X.history_cut(r.withColumn("kickoff_time", F.make_date(F.substring("season", 1, 4).cast("int"), "GW", F.lit(1)).cast("timestamp")), CURRENT, 5, 2).drop("kickoff_time")
    m = M.fit_points(hist, None, COLS, "y", TREES, 3)
    now = m.predict(r.filter((F.col("season") == CURRENT) & (F.col("GW") == 5)))
    naive = now.withColumn("pred", F.coalesce("total_points_r6", F.lit(0.0)))
    a, b = E.pick_metrics(now, 1).withColumn("method", F.lit("model")), E.pick_metrics(naive, 1).withColumn("method", F.lit("naive"))
    return six(a.unionByName(b))


add("E32_single_gameweek_replay", _e32)


def _fit(tr, va):
    return M.fit_points(tr, va, COLS, "y", 3, 2).predict


add("E33_rolling_origin", lambda s, d: six(E.row_metrics(M.rolling_origin(rows(s, d), SEASONS, _fit), ["season"])))
add("E34_in_season", lambda s, d: six(E.row_metrics(M.in_season(rows(s, d), "2000-01", [(1, 5), (6, 10), (11, 12)], lambda tr: M.fit_points(tr, None, COLS, "y", 3, 2).predict), ["season", "GW"])))
