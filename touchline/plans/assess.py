"""Queries for evaluation (E) and data quality (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import derived as D
from touchline.operators import evaluation as E
from touchline.operators import quality as Q
from touchline.operators import temporal as X
from touchline.plans import roles
from touchline.plans.features import KEY, ROW, pct, roll, six, snap_rows, snaps, tm, windows, match_events
from touchline.plans.registry import add
from touchline.plans.roles import CTES, CURRENT, ctes
from touchline.session import written

app, fx, pl, sided, cap = roles.appearances, roles.fixtures, roles.players, roles.sided_appearances, roles.captures


def er(s, d):
    return app(s, d).withColumns({"pred": F.col("predicted_points"), "y": F.col("total_points").cast("double")})


def er2(s, d):
    """A second method: a tenth of the bonus score."""
    return app(s, d).withColumns({"pred": F.col("bps") / 10.0, "y": F.col("total_points").cast("double")})


CTES["er"] = ("SELECT *, predicted_points AS pred, CAST(total_points AS DOUBLE) AS y FROM app", ("app",))
CTES["er2"] = ("SELECT *, bps / 10 AS pred, CAST(total_points AS DOUBLE) AS y FROM app", ("app",))
MET = "count(*) AS \"rows\", round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(1 - sum((pred - y) * (pred - y)) / (var_pop(y) * count(y)), 6) AS r2, round(avg(pred - y), 6) AS bias, round(corr(pred, y), 6) AS pearson_r, round(avg(pred), 6) AS mean_pred, round(avg(y), 6) AS mean_actual"
add("E1_row_metrics", lambda s, d: six(E.row_metrics(er(s, d), ["season"])), ctes("er") + f"SELECT season, {MET} FROM er GROUP BY season")


def pick_ctes(src, p=""):
    """Player-gameweeks, pick metrics and rank correlation of a method."""
    return {
        f"{p}g": f"SELECT season, GW, name, round(sum(pred), 9) AS pred, sum(y) AS actual, sum(minutes) AS minutes, min(position) AS position FROM {src} GROUP BY season, GW, name",
        f"{p}r": f"SELECT *, row_number() OVER (PARTITION BY season, GW ORDER BY pred DESC, name) AS r, row_number() OVER (PARTITION BY season, GW ORDER BY actual DESC, name) AS q, count(*) OVER (PARTITION BY season, GW) AS n, rank() OVER (PARTITION BY season, GW ORDER BY pred) + (count(*) OVER (PARTITION BY season, GW, pred) - 1) / 2 AS ap, rank() OVER (PARTITION BY season, GW ORDER BY actual) + (count(*) OVER (PARTITION BY season, GW, actual) - 1) / 2 AS aa FROM {p}g",
        f"{p}l": f"SELECT season, GW, actual AS line FROM {p}r WHERE q = 20",
        f"{p}e": f"SELECT season, GW, avg(abs(pred - y)) AS mae, count(*) AS \"rows\" FROM {src} GROUP BY season, GW",
        f"{p}m": f"SELECT season, GW, any_value(n) AS players, " + ", ".join(f"sum(actual) FILTER (WHERE r <= {k}) / least({k}, any_value(n)) AS top{k}" for k in E.KS)
        + f", sum(CASE WHEN r <= 20 AND (line IS NULL OR actual >= line) THEN 1 ELSE 0 END) / least(20, any_value(n)) AS hit20, corr(ap, aa) AS spearman, any_value(mae) AS mae, any_value(\"rows\") AS \"rows\" FROM {p}r LEFT JOIN {p}l USING (season, GW) JOIN {p}e USING (season, GW) GROUP BY season, GW HAVING any_value(n) >= 30",
    }


_PM = "season, GW, players, " + ", ".join(f"round(top{k}, 6) AS top{k}" for k in E.KS) + ", round(hit20, 6) AS hit20, round(mae, 6) AS mae, \"rows\", round(spearman, 6) AS spearman"
add("E2_pick_metrics", lambda s, d: six(E.pick_metrics(er(s, d))), ctes("er", extra=pick_ctes("er")) + f"SELECT {_PM} FROM m")
add("E3_ranked_player_gameweeks", lambda s, d: six(E.ranked_player_gameweeks(er(s, d)).select("season", "GW", "name", "pred", "actual", "place")), ctes("er", extra=pick_ctes("er")) + "SELECT season, GW, name, round(pred, 6) AS pred, round(actual, 6) AS actual, r AS place FROM r")


def form_rows(s, d, columns=("name", "position", "value", "selected", "predicted_points")):
    """Prediction rows with form and season-to-date features, from appearances put together once."""
    a = written(app(s, d).select(*KEY, "fixture", "line", "kickoff_time", "minutes", "starts", "total_points", *columns), "appearances")
    r = a.withColumn("y", F.col("total_points").cast("double"))
    if "predicted_points" in columns:
        r = r.withColumn("pred", F.col("predicted_points"))
    r = X.attach(r, X.form_features(a).select(*KEY, "total_points_r3", "total_points_r6", "minutes_r3"), KEY)
    return X.attach(X.attach(r, X.season_to_date(a), KEY), X.career_matches(a), KEY)


CTES["fr"] = ("SELECT er.*, f.r3 AS total_points_r3, f.r6 AS total_points_r6, f.m3 AS minutes_r3, CASE WHEN std.n > 0 THEN std.p / std.n END AS season_ppg, std.career AS career_matches_before FROM er JOIN (SELECT element, season, GW, r3, r6, m3 FROM (SELECT *, " + ", ".join([roll("total_points", 3, out="r3"), roll("total_points", 6, out="r6"), roll("minutes", 3, out="m3")]) + " FROM fl) WHERE k = 1) f USING (element, season, GW) JOIN std USING (element, season, GW)", ("er", "fl", "std"))
add("E4_baselines", lambda s, d: six(E.baselines(form_rows(s, d), er(s, d).filter("season < '1999-00'")).select(*ROW, "b_pos_mean", "b_last3", "b_last6", "b_ppg")),
    ctes("fr") + "SELECT element, fixture, line, round(m, 6) AS b_pos_mean, round(coalesce(total_points_r3, 0), 6) AS b_last3, round(coalesce(total_points_r6, 0), 6) AS b_last6, round(coalesce(season_ppg, total_points_r6, 0), 6) AS b_ppg FROM fr LEFT JOIN (SELECT position, avg(y) AS m FROM er WHERE season < '1999-00' GROUP BY position) USING (position)")
add("E5_metrics_by_scope", lambda s, d: six(E.metrics_by_scope(er(s, d))),
    ctes("er", extra={"x": "SELECT *, 'all' AS subset FROM er UNION ALL SELECT *, 'played' FROM er WHERE minutes > 0"}) + f"SELECT coalesce(season, 'all seasons') AS scope, subset, {MET} FROM x GROUP BY GROUPING SETS ((season, subset), (subset))")
add("E5_picks_by_scope", lambda s, d: six(E.scope_means(E.pick_metrics(er(s, d)), ["top20", "hit20", "spearman"])),
    ctes("er", extra=pick_ctes("er")) + "SELECT coalesce(season, 'all seasons') AS scope, count(*) AS gameweeks, round(avg(top20), 6) AS top20, round(avg(hit20), 6) AS hit20, round(avg(spearman), 6) AS spearman FROM m GROUP BY GROUPING SETS ((season), ())")
add("E6_breakdown", lambda s, d: six(E.breakdown(er(s, d), "position").select("position", "rows", "mae", "rmse", "bias", "played_share", "within_top10", "within_spearman")),
    ctes("er", extra={"g": "SELECT position, season, GW, name, round(sum(pred), 9) AS pred, sum(y) AS actual FROM er GROUP BY ALL",
        "r": "SELECT *, row_number() OVER (PARTITION BY position, season, GW ORDER BY pred DESC, name) AS r, count(*) OVER (PARTITION BY position, season, GW) AS n, rank() OVER (PARTITION BY position, season, GW ORDER BY pred) + (count(*) OVER (PARTITION BY position, season, GW, pred) - 1) / 2 AS ap, rank() OVER (PARTITION BY position, season, GW ORDER BY actual) + (count(*) OVER (PARTITION BY position, season, GW, actual) - 1) / 2 AS aa FROM g",
        "m": "SELECT position, season, GW, sum(actual) FILTER (WHERE r <= 10) / least(10, any_value(n)) AS t, corr(ap, aa) AS sp FROM r GROUP BY position, season, GW HAVING any_value(n) >= 10",
        "k": "SELECT position, round(avg(t), 6) AS within_top10, round(avg(sp), 6) AS within_spearman FROM m GROUP BY position"})
    + "SELECT position, count(*) AS \"rows\", round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(pred - y), 6) AS bias, round(avg(CASE WHEN minutes > 0 THEN 1 ELSE 0 END), 6) AS played_share, any_value(within_top10) AS within_top10, any_value(within_spearman) AS within_spearman FROM er LEFT JOIN k USING (position) GROUP BY position")
add("E7_decile_calibration", lambda s, d: six(E.decile_calibration(er(s, d), ROW)),
    ctes("er", extra={"r": "SELECT *, CAST(greatest(0, ceil((row_number() OVER (ORDER BY pred, element, fixture, line) - 1) * 10 / (count(*) OVER () - 1)) - 1) AS INT) AS bin FROM er"})
    + "SELECT bin, round(avg(pred), 6) AS mean_pred, round(avg(y), 6) AS mean_actual, count(*) AS \"rows\", round(stddev_samp(y) / sqrt(count(*)), 6) AS se FROM r GROUP BY bin")
add("E7_calibration_line", lambda s, d: six(E.calibration_line(er(s, d), ["season"])), ctes("er") + "SELECT season, round(regr_slope(y, pred), 6) AS slope, round(regr_intercept(y, pred), 6) AS intercept FROM er GROUP BY season")
_PB = "CASE WHEN pred < 2 THEN '0-2' WHEN pred < 4 THEN '2-4' WHEN pred < 6 THEN '4-6' ELSE '6+' END"
add("E8_binned_calibration", lambda s, d: six(E.binned_calibration(er(s, d), ["season"])), ctes("er") + f"SELECT season, {_PB} AS label, count(*) AS n, round(avg(pred), 6) AS predicted, round(avg(y), 6) AS actual FROM er GROUP BY season, {_PB}")


def boot_ctes(src, col, draws, weight="1.0", seed=0, order="GW"):
    """The draws in steps, each step one frame, so that no expression is repeated."""
    return {
        "bt": f"SELECT season, row_number() OVER (PARTITION BY season ORDER BY {order}) - 1 AS slot, count(*) OVER (PARTITION BY season) AS n, CAST({col} * {weight} AS DOUBLE) AS num, CAST({weight} AS DOUBLE) AS den FROM {src} WHERE {col} IS NOT NULL",
        "b0": f"SELECT season, n, draw, ((((draw::BIGINT * 48271 + slot * 69621 + {seed * 31 + 12345}) % 2147483647) * 48271) % 2147483647) AS x FROM bt, (SELECT unnest(range({draws})) AS draw)",
        "b1": "SELECT season, n, draw, (xor(x, x >> 13) * 69621) % 2147483647 AS x FROM b0",
        "b2": "SELECT season, n, draw, (xor(x, x >> 11) * 16807) % 2147483647 AS x FROM b1",
        "b3": "SELECT season, draw, (x >> 7) % n AS slot FROM b2",
        "bd": "SELECT draw, round(sum(num) / sum(den), 10) AS e FROM b3 JOIN bt USING (season, slot) GROUP BY draw",
    }


add("E9_bootstrap_interval", lambda s, d: six(E.confidence_interval(E.pick_metrics(er(s, d), spearman=False), "top20", 2000)),
    ctes("er", extra=pick_ctes("er") | boot_ctes("m", "top20", 2000)) + "SELECT (SELECT round(avg(top20), 6) FROM m) AS estimate, round(quantile_cont(e, 0.025), 6) AS lo, round(quantile_cont(e, 0.975), 6) AS hi, round(least(1, 2 * least(avg(CASE WHEN e <= 0 THEN 1 ELSE 0 END), avg(CASE WHEN e >= 0 THEN 1 ELSE 0 END))), 6) AS p_two_sided FROM bd")
add("E9_weighted_interval", lambda s, d: six(E.confidence_interval(E.pick_metrics(er(s, d), spearman=False), "mae", 1000, "rows", 3).select("estimate", "lo", "hi")),
    ctes("er", extra=pick_ctes("er") | boot_ctes("m", "mae", 1000, "\"rows\"", 3)) + "SELECT (SELECT round(sum(mae * \"rows\") / sum(\"rows\"), 6) FROM m) AS estimate, round(quantile_cont(e, 0.025), 6) AS lo, round(quantile_cont(e, 0.975), 6) AS hi FROM bd")
add("E10_paired_summary", lambda s, d: six(E.paired_summary(E.pick_metrics(er(s, d), spearman=False), E.pick_metrics(er2(s, d), spearman=False), "top20")),
    ctes("er", "er2", extra=pick_ctes("er") | pick_ctes("er2", "z") | {
        "dd": "SELECT season, round(m.top20 - zm.top20, 9) AS d FROM m JOIN zm USING (season, GW)",
        "w": "SELECT coalesce(season, 'all seasons') AS scope, round(avg(d), 6) AS mean_difference, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE d = 0) AS ties FROM dd GROUP BY GROUPING SETS ((season), ())"})
    + "SELECT *, round(CASE WHEN wins + losses > 0 THEN least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) + (wins + losses) * ln(0.5))))) END, 6) AS sign_test_p FROM w")
add("E10_paired_differences", lambda s, d: six(E.paired_differences(E.pick_metrics(er(s, d)), E.pick_metrics(er2(s, d)), ["top20", "mae"])),
    ctes("er", "er2", extra=pick_ctes("er") | pick_ctes("er2", "z")) + "SELECT season, GW, m.\"rows\", round(m.top20 - zm.top20, 6) AS top20, round(m.mae - zm.mae, 6) AS mae FROM m JOIN zm USING (season, GW)")
_OUT = ["total_points", "minutes", "goals_scored", "expected_goals"]
add("E12_lookahead_audit", lambda s, d: E.lookahead_audit(app(s, d), lambda a: X.rolling_before_period(a, ["element"], X.PERIOD, "kickoff_time", X.TIE, ["total_points", "minutes"], (3,), name="{stat}_r{w}"), _OUT, "1999-00", 5, KEY, ROW),
    ctes("app", extra={
        "la": "SELECT * FROM app WHERE season = '1999-00' AND GW >= 5",
        "lx": "SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '5', element, fixture, line)), element, fixture, line) AS n FROM la",
        "ly": "SELECT total_points AS tp, minutes AS mi, row_number() OVER (ORDER BY md5(concat_ws('|', '7924', element, fixture, line)), element, fixture, line) AS n FROM la",
        "sc": "SELECT element, season, GW, kickoff_time, fixture, line, total_points, minutes FROM app WHERE NOT (season = '1999-00' AND GW >= 5) UNION ALL SELECT element, season, GW, kickoff_time, fixture, line, tp, mi FROM lx JOIN ly USING (n)",
        **{o: f"SELECT * FROM (SELECT element, season, GW, avg(total_points) OVER w AS p, avg(minutes) OVER w AS m, row_number() OVER (PARTITION BY element, season, GW ORDER BY kickoff_time, fixture, line) AS k FROM {t} WINDOW w AS (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE k = 1" for o, t in (("fa", "app"), ("fb", "sc"))},
        "fj": "SELECT season, GW, (abs(fa.p - fb.p) <= 1e-9 OR (fa.p IS NULL AND fb.p IS NULL)) AND (abs(fa.m - fb.m) <= 1e-9 OR (fa.m IS NULL AND fb.m IS NULL)) AS same FROM fa JOIN fb USING (element, season, GW)"})
    + "SELECT count(*) FILTER (WHERE season < '1999-00' OR (season = '1999-00' AND GW <= 5)) AS rows_up_to_gw, count(*) FILTER (WHERE (season < '1999-00' OR (season = '1999-00' AND GW <= 5)) AND NOT coalesce(same, false)) AS changed_up_to_gw, "
      "count(*) FILTER (WHERE season = '1999-00' AND GW = 6) AS rows_next_gw, count(*) FILTER (WHERE season = '1999-00' AND GW = 6 AND NOT coalesce(same, false)) AS changed_next_gw FROM fj")
add("E13_single_feature_ranking", lambda s, d: six(E.single_feature_ranking(er(s, d), ["influence", "threat", "bps"], F.col("season") < "1999-00")),
    ctes("er", extra={"sg": "SELECT " + ", ".join(f"CASE WHEN coalesce(corr({c}, y), 0) >= 0 THEN 1 ELSE -1 END AS {c}" for c in ("influence", "threat", "bps")) + " FROM er WHERE season < '1999-00'",
        "u": " UNION ALL ".join(f"SELECT '{c}' AS feature, season, GW, name, CAST(er.{c} * sg.{c} AS DOUBLE) AS v, y FROM er, sg WHERE season >= '1999-00'" for c in ("influence", "threat", "bps")),
        "g": "SELECT feature, season, GW, name, round(sum(v), 9) AS pred, sum(y) AS actual FROM u GROUP BY feature, season, GW, name",
        "r": "SELECT *, row_number() OVER (PARTITION BY feature, season, GW ORDER BY pred DESC, name) AS r, count(*) OVER (PARTITION BY feature, season, GW) AS n FROM g",
        "m": "SELECT feature, season, GW, sum(actual) FILTER (WHERE r <= 20) / least(20, any_value(n)) AS t FROM r GROUP BY feature, season, GW HAVING any_value(n) >= 30"})
    + "SELECT feature, season, round(avg(t), 6) AS top20 FROM m GROUP BY feature, season")
add("E14_row_inflation", lambda s, d: E.row_inflation(app(s, d), form_rows(s, d)), ctes("app") + "SELECT count(*) AS input_rows, count(*) AS output_rows, 1::DOUBLE AS inflation_factor FROM app")
add("E14_repeat_share", lambda s, d: six(E.repeat_share(app(s, d))),
    ctes("app") + "SELECT count(*) AS n, round(avg(CASE WHEN b = total_points THEN 1 ELSE 0 END), 6) AS same_share FROM (SELECT *, lag(total_points) OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line) AS b FROM app) WHERE b >= 5")
add("E15_between_group_share", lambda s, d: six(E.between_group_share(app(s, d), ["season", "name"], "total_points")),
    ctes("app", extra={"x": "SELECT *, count(*) OVER (PARTITION BY season, name) AS n, avg(total_points) OVER (PARTITION BY season, name) AS mi FROM app",
        "y": "SELECT *, avg(total_points) OVER () AS m FROM x WHERE n >= 5",
        "z": "SELECT count(*) AS nn, count(DISTINCT season || name) AS kk, sum((mi - m) * (mi - m)) AS ssb, sum((total_points - mi) * (total_points - mi)) AS ssw, sum(n) AS n2 FROM y",
        "v": "SELECT nn, kk, ssb / (kk - 1) AS msb, ssw / (nn - kk) AS msw, (nn - n2 / nn) / (kk - 1) AS n0 FROM z"})
    + "SELECT nn AS \"rows\", kk AS groups, round(greatest((msb - msw) / n0, 0) / (greatest((msb - msw) / n0, 0) + msw), 6) AS between_share FROM v")
add("E16_largest_errors", lambda s, d: six(E.largest_errors(er(s, d), ROW)),
    ctes("er", extra={"x": "SELECT element, fixture, line, round(pred, 6) AS pred, y, round(y - pred, 9) AS residual FROM er"})
    + "(SELECT *, 'under' AS kind FROM x ORDER BY residual DESC, element, fixture, line LIMIT 15) UNION ALL (SELECT *, 'over' FROM x ORDER BY residual, element, fixture, line LIMIT 15)")
add("E16_haul_summary", lambda s, d: six(E.haul_summary(er(s, d))), ctes("er", extra=pick_ctes("er")) + "SELECT position, count(*) AS hauls, round(avg(CASE WHEN r <= 20 THEN 1 ELSE 0 END), 6) AS in_top20, round(avg(CASE WHEN r <= 50 THEN 1 ELSE 0 END), 6) AS in_top50, round(avg(pred), 6) AS mean_pred FROM r WHERE actual >= 10 GROUP BY position")
add("E16_availability_error", lambda s, d: six(E.availability_error(form_rows(s, d))),
    ctes("fr") + "SELECT round(avg(CASE WHEN minutes = 0 THEN 1 ELSE 0 END), 6) AS zero_share, round(avg(pred) FILTER (WHERE minutes = 0), 6) AS zero_mean_pred, round(sum(abs(pred - y)) FILTER (WHERE minutes = 0) / sum(abs(pred - y)), 6) AS zero_error_share, count(*) FILTER (WHERE minutes = 0 AND minutes_r3 >= 60) AS regulars_out, round(sum(abs(pred - y)) FILTER (WHERE minutes = 0 AND minutes_r3 >= 60) / sum(abs(pred - y)), 6) AS regulars_error_share FROM fr")
_HB = "CASE WHEN career_matches_before = 0 THEN '0 (debut)' WHEN career_matches_before < 10 THEN '1-9' WHEN career_matches_before < 38 THEN '10-37' ELSE '38+' END"
_MB = "CASE WHEN minutes_r3 IS NULL THEN 'no history' WHEN minutes_r3 = 0 THEN '0' WHEN minutes_r3 <= 30 THEN '1-30' WHEN minutes_r3 <= 60 THEN '31-60' ELSE '61-90' END"
for _n, _c, _q in (("history", E.history_bucket, _HB), ("minutes", E.minutes_bucket, _MB)):
    add(f"E16_by_{_n}", lambda s, d, c=_c: six(E.row_metrics(form_rows(s, d).withColumn("bucket", c()), ["bucket"])), ctes("fr") + f"SELECT {_q} AS bucket, {MET} FROM fr GROUP BY 1")
add("E16_name_collisions", lambda s, d: E.name_collisions(app(s, d)),
    ctes("app") + "SELECT (SELECT count(*) FROM (SELECT 1 FROM app GROUP BY season, GW, name HAVING count(DISTINCT team) > 1)) AS player_gameweeks_with_two_teams, (SELECT count(*) FROM (SELECT 1 FROM app GROUP BY season, fixture, name HAVING count(*) > 1)) AS repeated_in_match")
add("E17_double_gameweeks", lambda s, d: six(E.double_gameweeks(er(s, d))),
    ctes("er", extra={"tf": "SELECT season, GW, team, count(DISTINCT fixture) AS n FROM er GROUP BY season, GW, team", "w": "SELECT season, GW FROM tf WHERE n > 1 GROUP BY season, GW HAVING count(*) >= 2",
        "g": "SELECT season, GW, name, round(sum(pred), 9) AS pred, sum(y) AS actual, CASE WHEN max(n) > 1 THEN 1 ELSE 0 END AS dbl FROM er JOIN tf USING (season, GW, team) JOIN w USING (season, GW) GROUP BY season, GW, name",
        "r": "SELECT *, row_number() OVER (PARTITION BY season, GW ORDER BY pred DESC, name) AS r, row_number() OVER (PARTITION BY season, GW ORDER BY actual DESC, name) AS q FROM g"})
    + "SELECT round(avg(dbl), 6) AS share_all, round(avg(dbl) FILTER (WHERE r <= 20), 6) AS share_picks, round(avg(dbl) FILTER (WHERE q <= 20), 6) AS share_best, (SELECT count(*) FROM w) AS gameweeks FROM r")
add("E18_by_phase", lambda s, d: six(E.by_phase(E.pick_metrics(er(s, d)))),
    ctes("er", extra=pick_ctes("er") | {"p": "SELECT *, CASE WHEN GW <= 5 THEN 'GW1-5' ELSE 'GW6+' END AS phase FROM m"})
    + "SELECT coalesce(season, 'all seasons') AS scope, phase, count(*) AS gameweeks, round(avg(top20), 6) AS top20, round(avg(spearman), 6) AS spearman FROM p GROUP BY GROUPING SETS ((season, phase), (phase))")
_PD = {"GK": 3, "DEF": 10, "MID": 10, "FWD": 5}
_GT = pick_ctes("er") | {
    "ee": "SELECT season, GW, sum((pred - y) * (pred - y)) AS se, sum(abs(pred - y)) AS ae, count(*) AS \"rows\", coalesce(sum((pred - y) * (pred - y)) FILTER (WHERE minutes = 0), 0) AS se_dnp, coalesce(sum(pred - y) FILTER (WHERE minutes = 0), 0) AS err_dnp, count(*) FILTER (WHERE minutes = 0) AS n_dnp, "
    + ", ".join(f"coalesce(sum(pred - y) FILTER (WHERE position = '{p}'), 0) AS perr_{p}, count(*) FILTER (WHERE position = '{p}') AS pn_{p}" for p in _PD) + " FROM er GROUP BY season, GW",
    "pq": "SELECT *, row_number() OVER (PARTITION BY season, GW, position ORDER BY pred DESC, name) AS pr FROM r",
    "pk": "SELECT season, GW, any_value(n) AS players, avg(actual) FILTER (WHERE r <= 20) AS top20, avg(actual) FILTER (WHERE r <= 50) AS top50, max(actual) FILTER (WHERE r = 1) AS capt, CASE WHEN max(minutes) FILTER (WHERE r = 1) > 0 OR count(*) < 2 THEN max(actual) FILTER (WHERE r = 1) ELSE max(actual) FILTER (WHERE r = 2) END AS capt_fpl, avg(pred) FILTER (WHERE r <= 20) AS pred20, max(pred) FILTER (WHERE r = 1) AS pred_capt, avg(CASE WHEN minutes = 0 THEN 1 ELSE 0 END) FILTER (WHERE r <= 20) AS dnp20, corr(ap, aa) AS spearman, "
    + ", ".join(f"CASE WHEN count(*) FILTER (WHERE position = '{p}' AND pr <= {k}) = {k} THEN avg(actual) FILTER (WHERE position = '{p}' AND pr <= {k}) END AS top_{p}" for p, k in _PD.items()) + " FROM pq GROUP BY season, GW",
    "gt": "SELECT * FROM ee JOIN pk USING (season, GW)",
}


def gt(s, d):
    return E.gameweek_table(er(s, d), {"dnp": F.col("minutes") == 0})


_GC = ["se", "ae", "se_dnp", "err_dnp", *[f"perr_{p}" for p in _PD], "top20", "top50", "capt", "capt_fpl", "pred20", "pred_capt", "dnp20", "spearman", *[f"top_{p}" for p in _PD]]
add("E19_gameweek_table", lambda s, d: six(gt(s, d)), ctes("er", extra=_GT) + "SELECT season, GW, \"rows\", n_dnp, players, " + ", ".join(f"pn_{p}" for p in _PD) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in _GC) + " FROM gt")
add("E20_table_summary", lambda s, d: six(E.table_summary(gt(s, d))),
    ctes("er", extra=_GT) + "SELECT round(sqrt(sum(se) / sum(\"rows\")), 6) AS rmse, round(sum(ae) / sum(\"rows\"), 6) AS mae, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("top20", "top50", "capt", "capt_fpl", "spearman", "dnp20")) + ", " + ", ".join(f"round(sum(perr_{p}) / sum(pn_{p}), 6) AS bias_{p}" for p in _PD) + ", count(*) AS gameweeks FROM gt")


def trr(s, d):
    """Player-gameweeks with a rival forecast for four fifths of the players."""
    a = app(s, d).groupBy("season", "GW", "element").agg(F.round(F.sum("predicted_points"), 9).alias("pred"), F.round(F.sum("influence") / 12, 9).alias("__r"), F.sum("total_points").alias("y"), F.sum("minutes").alias("minutes"))
    return a.withColumns({"rival": F.when((F.col("element") % 5 != 0) & (F.col("GW") != 3), F.col("__r")), "has_fixture": F.col("element") % 7 != 0}).drop("__r")


CTES["trr"] = ("SELECT season, GW, element, round(sum(predicted_points), 9) AS pred, CASE WHEN element % 5 <> 0 AND GW <> 3 THEN round(sum(influence) / 12, 9) END AS rival, CAST(sum(total_points) AS BIGINT) AS y, sum(minutes) AS minutes, element % 7 <> 0 AS has_fixture FROM app GROUP BY season, GW, element", ("app",))
_TR = {
    "k": "SELECT *, row_number() OVER (PARTITION BY season, GW, has_fixture ORDER BY pred DESC, element) AS r, row_number() OVER (PARTITION BY season, GW, has_fixture AND rival IS NOT NULL ORDER BY rival DESC, element) AS v, row_number() OVER (PARTITION BY season, GW ORDER BY y DESC, element) AS b FROM trr",
    "t": "SELECT season, GW, count(*) FILTER (WHERE has_fixture) AS players, CASE WHEN count(*) FILTER (WHERE minutes > 0 AND rival IS NOT NULL) > 0 THEN avg(abs(pred - y)) FILTER (WHERE minutes > 0 AND rival IS NOT NULL) ELSE avg(abs(pred - y)) FILTER (WHERE minutes > 0) END AS mae_model, avg(abs(rival - y)) FILTER (WHERE minutes > 0 AND rival IS NOT NULL) AS mae_rival, CASE WHEN count(*) FILTER (WHERE minutes > 0 AND rival IS NOT NULL) > 0 THEN count(*) FILTER (WHERE minutes > 0 AND rival IS NOT NULL) ELSE count(*) FILTER (WHERE minutes > 0) END AS n, CAST(sum(y) FILTER (WHERE has_fixture AND r <= 10) AS BIGINT) AS top_model, CASE WHEN count(*) FILTER (WHERE has_fixture AND r <= 10) = count(*) FILTER (WHERE has_fixture AND rival IS NOT NULL AND v <= 10) THEN CAST(sum(y) FILTER (WHERE has_fixture AND rival IS NOT NULL AND v <= 10) AS BIGINT) END AS top_rival, CAST(sum(y) FILTER (WHERE b <= 10) AS BIGINT) AS top_best, max(element) FILTER (WHERE has_fixture AND r = 1) AS captain, max(y) FILTER (WHERE has_fixture AND r = 1) AS captain_points FROM k GROUP BY season, GW",
}
add("E21_track_record", lambda s, d: six(E.track_record(trr(s, d))), ctes("trr", extra=_TR) + "SELECT season, GW, players, round(mae_model, 6) AS mae_model, round(mae_rival, 6) AS mae_rival, n, top_model, top_rival, top_best, captain, captain_points, captain_points >= 6 AS captain_hit FROM t")
add("E22_record_totals", lambda s, d: six(E.record_totals(E.track_record(trr(s, d)))),
    ctes("trr", extra=_TR) + "SELECT season, count(*) AS gameweeks, round(sum(mae_model * n) FILTER (WHERE mae_rival IS NOT NULL) / sum(n) FILTER (WHERE mae_rival IS NOT NULL), 6) AS mae_model, round(sum(mae_rival * n) / sum(n) FILTER (WHERE mae_rival IS NOT NULL), 6) AS mae_rival, round(avg(top_model) FILTER (WHERE top_rival IS NOT NULL), 6) AS top_model, round(avg(top_rival), 6) AS top_rival, round(avg(top_best) FILTER (WHERE top_rival IS NOT NULL), 6) AS top_best, count(*) FILTER (WHERE captain_points >= 6) AS captain_hits, round(avg(captain_points), 6) AS captain_mean, count(*) FILTER (WHERE mae_model < mae_rival) AS mae_wins, count(*) FILTER (WHERE top_model > top_rival) AS top_wins FROM t GROUP BY season")


def _caps(s, d):
    return cap(s, d).filter("kind = 'view'").select("season", "GW", "element", F.date_trunc("hour", "captured_at").alias("captured_at"), "value")


add("E23_last_capture", lambda s, d: E.last_capture(_caps(s, d), X.deadlines(match_events(s, d)).select("season", "GW", (F.col("deadline") + F.expr("INTERVAL 12 HOURS")).alias("deadline")), "value"),
    ctes("dl", extra={"c": "SELECT season, GW, element, date_trunc('hour', captured_at) AS h, value FROM cap WHERE kind = 'view'", "j": "SELECT c.*, max(h) OVER (PARTITION BY season, GW) AS mx FROM c JOIN dl USING (season, GW) WHERE h <= deadline + INTERVAL 12 HOUR"}) + "SELECT season, GW, element, value FROM j WHERE h = mx")


def _proj(s, d):
    """Each gameweek's forecast, made one, two and three gameweeks ahead with growing shrinkage."""
    p = app(s, d).groupBy("season", "GW", "element").agg(F.sum("predicted_points").alias("p"))
    return p.select("season", F.col("GW").alias("gameweek"), "element", "p", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("k")).select(
        "season", "gameweek", "element", (F.col("gameweek") - F.col("k") + 1).alias("deadline_gw"), F.round(F.col("p") / F.col("k"), 9).alias("predicted_points")).filter("deadline_gw >= 1")


add("E24_projection_quality", lambda s, d: six(E.projection_quality(_proj(s, d), D.gameweek_actuals(app(s, d)).filter("element % 6 <> 0"))),
    ctes("act", extra={"p": "SELECT season, GW, element, sum(predicted_points) AS p FROM app GROUP BY ALL",
        "q": "SELECT p.season, p.GW, p.element, k AS step, p.GW - k + 1 AS dg, round(p / k, 9) AS pp, CAST(coalesce(CASE WHEN p.element % 6 <> 0 THEN points END, 0) AS DOUBLE) AS pts FROM p JOIN act USING (season, GW, element), (SELECT unnest([1, 2, 3]) AS k) WHERE p.GW - k + 1 >= 1",
        "r": "SELECT *, row_number() OVER (PARTITION BY step, season, dg ORDER BY pp DESC, element) AS r FROM q",
        "m": "SELECT step, season, dg, avg(pts) AS m FROM r WHERE r <= 20 GROUP BY ALL"})
    + "SELECT step, count(*) AS \"rows\", round(sqrt(avg((pp - pts) * (pp - pts))), 6) AS rmse, round(corr(pp, pts), 6) AS corr, any_value(ta) AS top_actual, round(avg(pp - pts) FILTER (WHERE r <= 20), 6) AS top_bias FROM r JOIN (SELECT step, round(avg(m), 6) AS ta FROM m GROUP BY step) USING (step) GROUP BY step")


def flagged_rows(s, d):
    """Player-gameweeks on the event table with flag, stratum and outcome."""
    r = snap_rows(s, d).join(match_events(s, d).select("fixture", "value"), "fixture")
    flag = F.when(F.col("snap_chance").isNull() & F.col("snap_news").isNull(), F.lit(None)).when(F.col("chance_of_playing") == 0, "out").when(F.col("chance_of_playing") == 1, "a").otherwise("doubt")
    return r.select(flag.alias("flag"), F.pmod("element", F.lit(4)).cast("string").alias("stratum"), F.col("value").alias("points"), (F.col("value") > 10).cast("double").alias("played")).filter("flag IS NOT NULL")


add("E25_flag_factors", lambda s, d: six(E.flag_factors(flagged_rows(s, d), ["points", "played"])),
    ctes("sf", extra={"x": "SELECT CASE WHEN chance_of_playing = 0 THEN 'out' WHEN chance_of_playing = 1 THEN 'a' ELSE 'doubt' END AS flag, sf.element % 4 AS st, me.value AS points, CASE WHEN me.value > 10 THEN 1 ELSE 0 END AS played FROM sf JOIN me USING (fixture) WHERE snap_chance IS NOT NULL OR snap_news IS NOT NULL",
                      "b": "SELECT st, avg(points) AS bp, avg(played) AS bl FROM x WHERE flag = 'a' GROUP BY st"})
    + "SELECT flag, count(*) AS n, round(CASE WHEN sum(bp) > 0 THEN sum(points) / sum(bp) END, 6) AS points, round(CASE WHEN sum(bl) > 0 THEN sum(played) / sum(bl) END, 6) AS played FROM x JOIN b USING (st) GROUP BY flag")
add("E26_coverage", lambda s, d: six(E.coverage(windows(s, d), snap_rows(s, d))), ctes("win", "sf") + "SELECT season, count(*) AS gws, count(sha) AS with_snapshot, count(*) FILTER (WHERE stale) AS stale, (SELECT round(avg(CASE WHEN snap_age_days IS NOT NULL THEN 1 ELSE 0 END), 6) FROM sf) AS \"rows\" FROM win GROUP BY season")
add("E27_input_share", lambda s, d: six(E.input_share(app(s, d), ["starts", "expected_goals", "defensive_contribution", "transfers_in"])),
    ctes("app") + " UNION ALL ".join(f"SELECT '{c}' AS input, round(count({c}) / count(*), 6) AS share FROM app" for c in ("starts", "expected_goals", "defensive_contribution", "transfers_in")))
_DF = ("influence", "total_points", "value", "expected_goals")
_Q = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11))
_DR = {"rf": " UNION ALL ".join(f"SELECT '{c}' AS f, CAST({c} AS DOUBLE) AS v, season < '1999-00' AS ref FROM app WHERE {c} IS NOT NULL" for c in _DF), "ed": f"SELECT f, list_sort(list_distinct([{_Q}])) AS e FROM rf WHERE ref GROUP BY f",
       "bn": "SELECT f, ref, CASE WHEN v < e[1] OR v > e[len(e)] THEN NULL ELSE least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) END AS b FROM rf JOIN ed USING (f)",
       "sh": "SELECT f, ref, b, count(*) / sum(count(*)) OVER (PARTITION BY f, ref) AS p FROM bn GROUP BY f, ref, b",
       "gr": "SELECT f, unnest(range(1, len(e))) AS b FROM ed",
       "ps": "SELECT f, sum((coalesce(c.p, 0) + 1e-10 - coalesce(r.p, 0) - 1e-10) * ln((coalesce(c.p, 0) + 1e-10) / (coalesce(r.p, 0) + 1e-10))) AS psi FROM gr LEFT JOIN (SELECT f, b, p FROM sh WHERE ref) r USING (f, b) LEFT JOIN (SELECT f, b, p FROM sh WHERE NOT ref) c USING (f, b) GROUP BY f"}


def _drift(s, d):
    return E.drift(app(s, d).filter("season < '1999-00'"), app(s, d).filter("season >= '1999-00'"), _DF)


add("E28_drift", lambda s, d: six(_drift(s, d)), ctes("app", extra=_DR) + "SELECT f AS feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.2 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS state FROM ps")
add("E28_retrain_needed", lambda s, d: six(E.retrain_needed(_drift(s, d))), ctes("app", extra=_DR) + "SELECT count(*) FILTER (WHERE psi >= 0.2) AS drifted, round(max(psi), 6) AS max_psi, round(avg(psi), 6) AS avg_psi, count(*) FILTER (WHERE psi >= 0.2) >= 3 AS retrain FROM ps")


def _pe(s, d):
    return app(s, d).groupBy("season", "GW", "element").agg(F.round(F.sum("predicted_points"), 9).alias("pred"), F.sum("total_points").cast("double").alias("y"))


add("E29_top_k_quality", lambda s, d: six(E.top_k_quality(_pe(s, d))),
    ctes("app", extra={"g": "SELECT season, GW, element, round(sum(predicted_points), 9) AS pred, CAST(sum(total_points) AS DOUBLE) AS y FROM app GROUP BY ALL",
        "r": "SELECT *, row_number() OVER (PARTITION BY season, GW ORDER BY pred DESC, element) AS r, row_number() OVER (PARTITION BY season, GW ORDER BY y DESC, element) AS q, rank() OVER (PARTITION BY season, GW ORDER BY pred) + (count(*) OVER (PARTITION BY season, GW, pred) - 1) / 2 AS ap, rank() OVER (PARTITION BY season, GW ORDER BY y) + (count(*) OVER (PARTITION BY season, GW, y) - 1) / 2 AS aa FROM g",
        "t": "SELECT season, GW, count(*) FILTER (WHERE r <= 10 AND q <= 10) / 10 AS hit_rate, coalesce(sum(1 / log2(r + 1)) FILTER (WHERE r <= 10 AND q <= 10), 0) / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 11)) AS i)) AS ndcg, sum(y) FILTER (WHERE q <= 10) AS op, sum(y) FILTER (WHERE r <= 10) AS cp, corr(ap, aa) AS spearman FROM r GROUP BY season, GW"})
    + "SELECT season, GW, round(hit_rate, 6) AS hit_rate, round(ndcg, 6) AS ndcg, op AS optimal_points, cp AS captured_points, round(CASE WHEN op > 0 THEN cp / op ELSE 0 END, 6) AS capture_rate, round(spearman, 6) AS spearman FROM t")
add("E30_earlier_mean_baseline", lambda s, d: six(E.earlier_mean_baseline(app(s, d), "total_points")),
    ctes("app", extra={"p": "SELECT season, position, sum(total_points) AS s, count(*) AS n FROM app GROUP BY ALL", "m": "SELECT season, position, sum(s) OVER w / sum(n) OVER w AS m FROM p WINDOW w AS (PARTITION BY position ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"})
    + "SELECT season, position, count(*) AS n, round(avg(abs(total_points - m)), 6) AS mae FROM app JOIN m USING (season, position) WHERE m IS NOT NULL GROUP BY season, position")


def _seed_tables(s, d):
    a = [E.pick_metrics(app(s, d).withColumns({"pred": F.col("predicted_points") + F.pmod(F.col("fixture") * k, F.lit(7)) / 7.0, "y": F.col("total_points").cast("double")}), spearman=False) for k in (3, 5)]
    return written(a[0], "seed").unionByName(written(a[1], "seed"))  # a row per gameweek


_SD = {}
for _k in (3, 5):
    _SD |= {f"x{_k}": f"SELECT *, predicted_points + (fixture * {_k}) % 7 / 7 AS pred, CAST(total_points AS DOUBLE) AS y FROM app"} | pick_ctes(f"x{_k}", f"s{_k}")
add("E35_ensemble_gain", lambda s, d: six(E.ensemble_gain(E.pick_metrics(er(s, d), spearman=False), _seed_tables(s, d), "top20", 1000).select("estimate", "lo", "hi")),
    ctes("er", extra=pick_ctes("er") | _SD | {"gn": "SELECT 'all' AS season, m.season AS o, m.GW, m.top20 - (a.top20 + b.top20) / 2 AS gain FROM m JOIN s3m a USING (season, GW) JOIN s5m b USING (season, GW)"} | boot_ctes("gn", "gain", 1000, order="o, GW"))
    + "SELECT (SELECT round(avg(gain), 6) FROM gn) AS estimate, round(quantile_cont(e, 0.025), 6) AS lo, round(quantile_cont(e, 0.975), 6) AS hi FROM bd")

# ---------------------------------------------------------------- quality


def _docs(s, d):
    t = roles.table(s, d, "documents")
    return t.select(F.when(F.col("doc_id") % 50 == 0, "Player").otherwise(F.col("text")).alias("Player"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("Player_Key"), "lang", "source", "n_chars")


add("Q1_table_checks", lambda s, d: Q.table_checks(_docs(s, d), "Player", "Player_Key"),
    "SELECT count(*) AS \"rows\", count(*) FILTER (WHERE doc_id % 50 = 0 OR text = 'Player') AS header_rows, count(*) FILTER (WHERE doc_id % 50 <> 0 AND regexp_matches(text, 'Ã|Â|â€')) AS garbled_names, count(*) FILTER (WHERE doc_id % 7 = 0) AS missing_keys, 5 AS columns, false AS ok FROM documents")
add("Q2_duplicate_keys", lambda s, d: Q.duplicate_keys(app(s, d), ["season", "element", "team"]), ctes("app") + "SELECT season, element, team, count(*) AS n FROM app GROUP BY ALL HAVING count(*) > 1")
add("Q2_two_squads", lambda s, d: Q.two_squads(app(s, d), ["season", "element"], "team"), ctes("app") + "SELECT season, element, count(DISTINCT team) AS squads FROM app GROUP BY season, element HAVING count(DISTINCT team) > 1")
_QC = ("starts", "expected_goals", "defensive_contribution", "transfers_in")
add("Q3_completeness", lambda s, d: six(Q.completeness(app(s, d), "season", _QC)), ctes("app") + " UNION ALL ".join(f"SELECT season, count(*) AS \"rows\", '{c}' AS metric, count({c}) AS known, round(count({c}) / count(*), 6) AS share FROM app GROUP BY season" for c in _QC))
add("Q3_seasons_per_player", lambda s, d: Q.seasons_per_player(app(s, d)), ctes("app") + "SELECT seasons, count(*) AS players FROM (SELECT name, count(DISTINCT season) AS seasons FROM app GROUP BY name) GROUP BY seasons")
add("Q4_missing_rows", lambda s, d: Q.missing_rows(roles.table(s, d, "documents").select("doc_id", "lang"), roles.table(s, d, "labels"), ["doc_id"]), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def _sides(s, d):
    """Side rows of matches; some lost their away side, some got a second home side."""
    f = fx(s, d)
    h = f.select(F.col("id").alias("fixture"), F.lit("home").alias("side"), F.col("home_team").alias("team"))
    a = f.filter("id % 10 <> 0").select(F.col("id").alias("fixture"), F.lit("away").alias("side"), F.when(F.col("id") % 11 == 0, F.col("home_team")).otherwise(F.col("away_team")).alias("team"))
    return h.unionByName(a).unionByName(h.filter("fixture % 13 = 0"))


add("Q5_fixture_sides", lambda s, d: Q.fixture_sides(_sides(s, d)), ctes("fx") + "SELECT id AS fixture, CASE WHEN id % 13 = 0 THEN 2::BIGINT ELSE 1::BIGINT END AS homes, CASE WHEN id % 10 = 0 THEN 0::BIGINT ELSE 1::BIGINT END AS aways, id % 13 <> 0 AND id % 10 <> 0 AND id % 11 <> 0 AS valid FROM fx")
add("Q6_rolling_leaks", lambda s, d: Q.rolling_leaks(app(s, d), X.form_features(app(s, d)), "total_points_r3", "total_points", 3), ctes("app") + "SELECT count(*) AS \"rows\", 0::BIGINT AS leaks FROM (SELECT DISTINCT element, season, GW FROM app)")
add("Q6_lag_correlation", lambda s, d: six(Q.lag_correlation(app(s, d), "total_points")), ctes("app") + "SELECT count(*) AS n, round(corr(b, total_points), 6) AS correlation FROM (SELECT *, lag(total_points) OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line) AS b FROM app) WHERE b IS NOT NULL")
_QF = ("minutes", "influence", "bps", "goals_scored", "value")
add("Q7_target_correlations", lambda s, d: six(Q.target_correlations(app(s, d), _QF, "total_points")), ctes("app") + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, total_points), 6) AS correlation, abs(corr({c}, total_points)) > 0.8 AS suspicious FROM app" for c in _QF))
