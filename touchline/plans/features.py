"""Queries for temporal features (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.numbers import settle
from touchline.operators import derived as D
from touchline.operators import temporal as X
from touchline.plans import roles
from touchline.plans.registry import add
from touchline.plans.roles import CTES, CURRENT, ctes
from touchline.plans.season import tr  # noqa: F401
from touchline.session import written

app, fx, pl, sided, cap = roles.appearances, roles.fixtures, roles.players, roles.sided_appearances, roles.captures
KEY = ["element", "season", "GW"]
ROW = ["element", "fixture", "line"]


def six(df, drop=()):
    return df.drop(*drop).select(*[settle(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.drop(*drop).dtypes])


CTES["fl"] = ("SELECT *, CAST(minutes > 0 AS INT) AS played, coalesce(starts, CAST(minutes >= 60 AS INT)) AS started, row_number() OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line) AS rn, row_number() OVER (PARTITION BY element, season, GW ORDER BY kickoff_time, fixture, line) AS k FROM app", ("app",))


def roll(col, w, fn="avg", out=None, part="element", order="kickoff_time, fixture, line"):
    return f"{fn}({col}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {out or f'{col}_r{w}'}"


def first_of_gw(cols, base="fl", keys="element, season, GW", exact=False):
    """Values at the first row of each (key, gameweek)."""
    inner = ", ".join(cols)
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    return f"SELECT {keys}, " + ", ".join(n if exact else f"round({n}, 6) AS {n}" for n in names) + f" FROM (SELECT *, {inner} FROM {base}) WHERE k = 1"


add("F1_rolling_before_gameweek", lambda s, d: six(X.attach(app(s, d).select(*KEY, "fixture", "line"), X.rolling_before_period(app(s, d), ["element"], X.PERIOD, "kickoff_time", X.TIE, ["total_points", "expected_goals"], (3, 6), name="{stat}_r{w}"), KEY)),
    ctes("fl", extra={"r": first_of_gw([roll(c, w) for c in ("total_points", "expected_goals") for w in (3, 6)])}) + "SELECT app.element, app.season, app.GW, app.fixture, app.line, total_points_r3, total_points_r6, expected_goals_r3, expected_goals_r6 FROM app JOIN r USING (element, season, GW)")
add("F2_rolling_sum_before_gameweek", lambda s, d: six(X.rolling_before_period(app(s, d), ["element"], X.PERIOD, "kickoff_time", X.TIE, ["total_points", "minutes"], (5,), "sum", "{stat}_s{w}")),
    ctes("fl") + first_of_gw([roll(c, 5, "sum", f"{c}_s5") for c in ("total_points", "minutes")]).replace("round(total_points_s5, 6)", "CAST(total_points_s5 AS BIGINT)").replace("round(minutes_s5, 6)", "CAST(minutes_s5 AS BIGINT)"))
_FS = [c for c in X.FORM_STATS if c not in ("expected_goal_involvements",)]
add("F3_form_features", lambda s, d: six(X.form_features(app(s, d))),
    ctes("fl") + first_of_gw([roll(c, w) for c in _FS for w in (3, 6)] + [roll(c, 1) for c in X.LAST_MATCH_STATS]))
add("F4_flags", lambda s, d: X.flags(app(s, d)).select(*ROW, "played", "started"), ctes("fl") + "SELECT element, fixture, line, CAST(played AS DOUBLE) AS played, CAST(started AS DOUBLE) AS started FROM fl")
CTES["std"] = ("SELECT element, season, GW, CAST(s_n AS BIGINT) AS n, p, m, rn - 1 AS career FROM (SELECT *, row_number() OVER w - 1 AS s_n, coalesce(sum(total_points) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p, coalesce(sum(minutes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM fl WINDOW w AS (PARTITION BY element, season ORDER BY kickoff_time, fixture, line)) WHERE k = 1", ("fl",))
add("F5_season_to_date", lambda s, d: six(X.season_to_date(app(s, d))),
    ctes("std") + "SELECT element, season, GW, n AS season_matches_before, round(CASE WHEN n > 0 THEN p / n END, 6) AS season_ppg, round(CASE WHEN n > 0 THEN m / (n * 90) END, 6) AS season_minutes_share FROM std")
add("F6_career_matches", lambda s, d: X.career_matches(app(s, d)), ctes("std") + "SELECT element, season, GW, career AS career_matches_before FROM std")
add("F7_days_rest", lambda s, d: six(X.days_rest(app(s, d)).select(*ROW, "days_rest")),
    ctes("app") + "SELECT element, fixture, line, round(least(30, epoch(kickoff_time - lag(kickoff_time) OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line)) / 86400), 6) AS days_rest FROM app")


def tm(s, d):
    return D.team_matches(sided(s, d))


CTES["tk"] = ("SELECT *, row_number() OVER (PARTITION BY team, season, GW ORDER BY kickoff_time, fixture) AS k FROM tm", ("tm",))
_TF = [roll(c, w, part="team", order="kickoff_time, fixture") for c in X.TEAM_STATS for w in (6, 20)]
CTES["tf"] = (first_of_gw(_TF, "tk", "team, season, GW", True), ("tk",))


def _side(alias, pre):
    out = []
    for c in X.TEAM_STATS:
        for w, x in ((6, ""), (20, "20")):
            col = f"{alias}.{c}_r{w}"
            out.append((f"coalesce({col}, {X.NEW_TEAM_PRIOR[c]})" if c in X.NEW_TEAM_PRIOR else col) + f" AS {pre}_{c}{x}")
    return ", ".join(out)


CTES["str"] = (f"SELECT a.season, a.GW, a.fixture, a.team, b.team AS opp, {_side('x', 'team')}, {_side('y', 'opp')} FROM tm a LEFT JOIN tm b ON a.season = b.season AND a.fixture = b.fixture AND a.team <> b.team LEFT JOIN tf x ON x.team = a.team AND x.season = a.season AND x.GW = a.GW LEFT JOIN tf y ON y.team = b.team AND y.season = a.season AND y.GW = a.GW", ("tm", "tf"))
add("F8_strength_features", lambda s, d: six(X.strength_features(tm(s, d))), ctes("str") + "SELECT season, GW, fixture, team, opp, " + ", ".join(f"round({p}_{c}{x}, 6) AS {p}_{c}{x}" for p in ("team", "opp") for c in X.TEAM_STATS for x in ("", "20")) + " FROM str")
add("F9_latest_team_form", lambda s, d: six(X.latest_team_form(tm(s, d))),
    ctes("tm") + "SELECT team, " + ", ".join(f"round(avg({c}) FILTER (WHERE r <= {w}), 6) AS {c}_r{w}" for c in X.TEAM_STATS for w in (6, 20)) + " FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff_time DESC, fixture DESC) AS r FROM tm) GROUP BY team")


def pct(col, part="season, GW"):
    return f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {col} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0) / count({col}) OVER (PARTITION BY {part}) END"


add("F10_ownership_rank", lambda s, d: six(X.ownership_rank(app(s, d)).select(*ROW, "selected_rank")), ctes("app") + f"SELECT element, fixture, line, round({pct('selected')}, 6) AS selected_rank FROM app")
add("F11_context_columns", lambda s, d: X.context_columns(sided(s, d)).select(*ROW, "price", "is_home", *[f"pos_{p}" for p in X.POSITIONS]),
    ctes("sided") + "SELECT element, fixture, line, value / 10 AS price, CAST(was_home AS DOUBLE) AS is_home, " + ", ".join(f"CAST(position = '{p}' AS DOUBLE) AS pos_{p}" for p in X.POSITIONS) + " FROM sided")


def divisions(s, d):
    return roles.table(s, d, "orders").select(F.col("o_orderkey").alias("fixture"), F.col("o_orderpriority").alias("division"))


def _rated_matches(s, d):
    return tm(s, d).join(divisions(s, d), "fixture")


# the recursion gameweek by gameweek: every team of a division before its week's matches
_RATINGS = {
    "dm": "SELECT tm.*, o_orderpriority AS division, coalesce(0.7 * xgf + 0.3 * gf, gf) AS y FROM tm JOIN orders ON o_orderkey = fixture",
    "dp": "SELECT a.division, a.season, a.GW, a.fixture, a.team, b.team AS opponent, a.was_home, a.y, a.kickoff_time FROM dm a LEFT JOIN dm b ON b.season = a.season AND b.fixture = a.fixture AND b.team <> a.team",
    "wk": "SELECT *, row_number() OVER (PARTITION BY division ORDER BY start, season, GW) AS week FROM (SELECT division, season, GW, min(kickoff_time) AS start FROM dm GROUP BY ALL)",
    "ws": "SELECT *, first_value(season) OVER w AS s1, CASE WHEN season <> lag(season) OVER w THEN 0.7 ELSE 1 END AS keep FROM wk WINDOW w AS (PARTITION BY division ORDER BY week)",
    "pw": "SELECT dp.*, ws.week FROM dp JOIN ws USING (division, season, GW)",
    "te": "SELECT e.division, e.team, e.week, CASE WHEN ws.season = s1 THEN 0 ELSE -0.15 END AS entry FROM (SELECT division, team, min(week) AS week FROM (SELECT division, team, week FROM pw UNION ALL SELECT division, opponent, week FROM pw WHERE opponent IS NOT NULL) GROUP BY ALL) e JOIN ws USING (division, week)",
    "rt": "SELECT division, team, CAST(1 AS BIGINT) AS week, CASE WHEN week = 1 THEN CAST(entry AS DOUBLE) END AS att, CASE WHEN week = 1 THEN CAST(entry AS DOUBLE) END AS dfn FROM te UNION ALL "
    "SELECT r.division, r.team, r.week + 1, CASE WHEN te.week = r.week + 1 THEN CAST(entry AS DOUBLE) ELSE (r.att + coalesce(da, 0)) * coalesce(ws.keep, 1) END, CASE WHEN te.week = r.week + 1 THEN CAST(entry AS DOUBLE) ELSE (r.dfn + coalesce(dd, 0)) * coalesce(ws.keep, 1) END "
    "FROM rt r JOIN te ON te.division = r.division AND te.team = r.team JOIN (SELECT division, max(week) AS weeks FROM wk GROUP BY 1) m ON m.division = r.division AND r.week <= m.weeks LEFT JOIN ws ON ws.division = r.division AND ws.week = r.week + 1 "
    "LEFT JOIN (SELECT p.division, p.team, sum(0.05 * (y - 1.35 * exp(a.att - b.dfn + CASE WHEN was_home THEN ln(1.08) ELSE -ln(1.08) END))) AS da FROM pw p JOIN rt a ON a.division = p.division AND a.team = p.team AND a.week = p.week JOIN rt b ON b.division = p.division AND b.team = p.opponent AND b.week = p.week GROUP BY ALL) u ON u.division = r.division AND u.team = r.team "
    "LEFT JOIN (SELECT p.division, p.opponent AS team, -sum(0.05 * (y - 1.35 * exp(a.att - b.dfn + CASE WHEN was_home THEN ln(1.08) ELSE -ln(1.08) END))) AS dd FROM pw p JOIN rt a ON a.division = p.division AND a.team = p.team AND a.week = p.week JOIN rt b ON b.division = p.division AND b.team = p.opponent AND b.week = p.week GROUP BY ALL) v ON v.division = r.division AND v.team = r.team",
    "fr": "SELECT p.season, p.fixture, p.team, a.att, a.dfn, b.att AS opp_att, b.dfn AS opp_dfn FROM pw p JOIN rt a ON a.division = p.division AND a.team = p.team AND a.week = p.week LEFT JOIN rt b ON b.division = p.division AND b.team = p.opponent AND b.week = p.week",
}
_with_ratings = lambda *names, extra=None: ctes(*names, extra={**_RATINGS, **(extra or {})}).replace("WITH ", "WITH RECURSIVE ", 1)
add("F12_team_ratings", lambda s, d: six(X.fixture_ratings(_rated_matches(s, d))),
    _with_ratings("tm") + "SELECT season, fixture, team, round(att, 6) AS att, round(dfn, 6) AS dfn, round(opp_att, 6) AS opp_att, round(opp_dfn, 6) AS opp_dfn FROM fr")
add("F12_latest_ratings", lambda s, d: six(X.latest_ratings(_rated_matches(s, d))),
    _with_ratings("tm") + "SELECT rt.division, ws.season, team, round(att, 6) AS att, round(dfn, 6) AS dfn FROM rt JOIN (SELECT division, season, week FROM ws QUALIFY row_number() OVER (PARTITION BY division ORDER BY week DESC) = 1) ws ON ws.division = rt.division AND rt.week = ws.week + 1")


def _resumed(s, d):
    """The seasons from 2000 on, from the ratings that those before end with."""
    m = written(_rated_matches(s, d), "matches")
    earlier = X.latest_ratings(m.filter("season < '2000'"))
    return X.fixture_ratings(m.filter("season >= '2000'"), state=earlier)


add("F12_resumed_ratings", lambda s, d: six(_resumed(s, d)),
    _with_ratings("tm") + "SELECT season, fixture, team, round(att, 6) AS att, round(dfn, 6) AS dfn, round(opp_att, 6) AS opp_att, round(opp_dfn, 6) AS opp_dfn FROM fr WHERE season >= '2000'")


def _model_rows(s, d):
    """:func:`model_rows` and the matches they come from; both sides of a match are put together once."""
    a = written(sided(s, d).select(*KEY, "fixture", "line", "team", "was_home", "position", "kickoff_time", "expected_goals", "team_h_score", "team_a_score"), "sides")
    m = written(D.team_matches(a), "matches")
    rows = a.select(*KEY, "fixture", "line", "team", "was_home", "position")
    rows = X.attach(rows, X.form_features(app(s, d)).select(*KEY, "started_r6", "goals_scored_r6", "assists_r6", "expected_goals_r6", "expected_assists_r6"), KEY)
    return X.attach(rows, X.strength_features(m).drop("GW"), ["season", "fixture", "team"]), m


def model_rows(s, d):
    """One row per appearance with form, strength and ratings."""
    return _model_rows(s, d)[0]


def rated_rows(s, d):
    rows, m = _model_rows(s, d)
    rows = rows.join(divisions(s, d), "fixture")
    return X.rating_features(X.attach(rows, X.fixture_ratings(m.join(divisions(s, d), "fixture")), ["season", "fixture", "team"]))


_M = lambda p, c: f"coalesce(({p}_x{c} + {p}_x{c}20) / 2, {p}_x{c}, {p}_x{c}20, ({p}_{c} + {p}_{c}20) / 2)"
CTES["mr0"] = (
    "SELECT a.element, a.fixture, a.line, a.was_home, f.*, s.* EXCLUDE (season, GW, fixture, team) FROM sided a LEFT JOIN (" + first_of_gw([roll(c, 6) for c in ("started", "goals_scored", "assists", "expected_goals", "expected_assists")], exact=True).replace("SELECT element, season, GW,", "SELECT element AS e_, season AS s_, GW AS g_,", 1)
    + ") f ON f.e_ = a.element AND f.s_ = a.season AND f.g_ = a.GW LEFT JOIN str s ON s.season = a.season AND s.fixture = a.fixture AND s.team = a.team", ("sided", "fl", "str"))
CTES["mu"] = (f"SELECT *, {_M('team', 'gf')} * {_M('opp', 'ga')} / 1.35 * CASE WHEN was_home THEN 1.08 ELSE 0.92 END AS f, {_M('opp', 'gf')} * {_M('team', 'ga')} / 1.35 * CASE WHEN was_home THEN 0.92 ELSE 1.08 END AS g, greatest(coalesce(team_xgf, team_gf), 0.3) AS t FROM mr0", ("mr0",))
add("F13_rating_features", lambda s, d: six(rated_rows(s, d).select(*ROW, "rt_xgf", "rt_xga", "rt_cs", "rt_pxg", "rt_pxa")),
    _with_ratings("tm", "mr0", extra={
        "jr": "SELECT m.*, greatest(coalesce(team_xgf, team_gf), 0.3) AS t, 1.35 * exp(att - opp_dfn + CASE WHEN m.was_home THEN ln(1.08) ELSE -ln(1.08) END) AS f, 1.35 * exp(opp_att - dfn - CASE WHEN m.was_home THEN ln(1.08) ELSE -ln(1.08) END) AS g "
        "FROM mr0 m JOIN sided s USING (element, fixture, line) LEFT JOIN fr ON fr.season = s.season AND fr.fixture = s.fixture AND fr.team = s.team"})
    + "SELECT element, fixture, line, round(f, 6) AS rt_xgf, round(g, 6) AS rt_xga, round(started_r6 * exp(-g), 6) AS rt_cs, round(coalesce(expected_goals_r6, goals_scored_r6) / t * f, 6) AS rt_pxg, round(coalesce(expected_assists_r6, assists_r6) / t * f, 6) AS rt_pxa FROM jr")
add("F14_matchup_features", lambda s, d: six(X.matchup_features(model_rows(s, d)).select(*ROW, "mu_xgf", "mu_xga", "mu_xgd", "mu_pxg", "mu_pxa", "mu_cs")),
    ctes("mu") + "SELECT element, fixture, line, round(f, 6) AS mu_xgf, round(g, 6) AS mu_xga, round(f - g, 6) AS mu_xgd, round(coalesce(expected_goals_r6, goals_scored_r6) / t * f, 6) AS mu_pxg, round(coalesce(expected_assists_r6, assists_r6) / t * f, 6) AS mu_pxa, round(started_r6 * exp(-g), 6) AS mu_cs FROM mu")
add("F15_transfer_ranks", lambda s, d: six(X.transfer_ranks(app(s, d))),
    ctes("app", extra={"o": "SELECT season, GW, element, transfers_in, transfers_out, transfers_in - transfers_out AS bal FROM (SELECT *, row_number() OVER (PARTITION BY season, GW, element ORDER BY kickoff_time, fixture, line) AS k FROM app WHERE transfers_in IS NOT NULL AND transfers_out IS NOT NULL) WHERE k = 1"})
    + f"SELECT season, GW, element, round({pct('bal')}, 6) AS tr_bal_rank, round({pct('transfers_in')}, 6) AS tr_in_rank, round({pct('transfers_out')}, 6) AS tr_out_rank FROM o")
add("F16_price_changes", lambda s, d: six(X.price_changes(app(s, d)).select(*ROW, "price_change_1", "price_change_3")),
    ctes("std", extra={"v": "SELECT element AS e, season AS s, GW AS g, v1, v3 FROM (SELECT *, " + roll("value", 1, out="v1") + ", " + roll("value", 3, out="v3") + " FROM fl) WHERE k = 1"})
    + "SELECT a.element, a.fixture, a.line, round(CASE WHEN n >= 1 THEN (value - v1) / 10 END, 6) AS price_change_1, round(CASE WHEN n >= 3 THEN (value - v3) / 10 END, 6) AS price_change_3 FROM app a JOIN std USING (element, season, GW) JOIN v ON v.e = a.element AND v.s = a.season AND v.g = a.GW")


# ------------------------------------------------------------------ deadlines and captures on the event table

def match_events(s, d):
    """Purchases as a player's matches, one gameweek per day."""
    return cap(s, d).filter("kind = 'purchase'").select("season", "GW", "element", F.col("captured_at").alias("kickoff_time"), F.col("capture_id").alias("fixture"), F.lit(1).alias("line"), "value")


def snaps(s, d):
    """Views as captures: one capture per hour holds a player once."""
    c = cap(s, d).filter("kind = 'view'").withColumns({
        "captured_at": F.date_trunc("hour", "captured_at"), "corners_order": F.when(F.col("capture_id") % 13 < 2, F.lit(1)), "freekicks_order": F.when(F.col("capture_id") % 17 < 2, F.lit(1))})
    c = c.withColumn("sha", F.concat(F.lit("view-"), F.date_format("captured_at", "yyyyMMddHH")))
    from touchline.functions.ordered import top_n

    return top_n(c, ["season", "sha", "element"], [F.col("capture_id")], 1).select("season", "sha", "captured_at", "element", "status", "chance", "news_flag", "penalties_order", "corners_order", "freekicks_order")


CTES["me"] = ("SELECT season, GW, element, captured_at AS kickoff_time, capture_id AS fixture, value FROM cap WHERE kind = 'purchase'", ("cap",))
CTES["sn"] = ("SELECT season, 'view-' || strftime(date_trunc('hour', captured_at), '%Y%m%d%H') AS sha, date_trunc('hour', captured_at) AS captured_at, element, status, chance, news_flag, penalties_order, CASE WHEN capture_id % 13 < 2 THEN 1 END AS corners_order, CASE WHEN capture_id % 17 < 2 THEN 1 END AS freekicks_order FROM (SELECT *, row_number() OVER (PARTITION BY season, date_trunc('hour', captured_at), element ORDER BY capture_id) AS k FROM cap WHERE kind = 'view') WHERE k = 1", ("cap",))
CTES["dl"] = ("SELECT *, lag(deadline) OVER (PARTITION BY season ORDER BY GW) AS prev_deadline FROM (SELECT season, GW, min(kickoff_time) - INTERVAL 90 MINUTE AS deadline FROM me GROUP BY season, GW)", ("me",))
CTES["win"] = ("SELECT season, GW, deadline, CASE WHEN NOT stale THEN sha END AS sha, CASE WHEN NOT stale THEN captured_at END AS captured_at, stale FROM (SELECT *, coalesce(captured_at <= prev_deadline, false) AS stale FROM (SELECT dl.*, c.sha, c.captured_at, row_number() OVER (PARTITION BY dl.season, dl.GW ORDER BY c.captured_at DESC, c.sha DESC) AS k FROM dl LEFT JOIN (SELECT DISTINCT season, sha, captured_at FROM sn) c ON c.season = dl.season AND c.captured_at < dl.deadline) WHERE k = 1)", ("dl", "sn"))
add("F17_deadlines", lambda s, d: X.deadlines(match_events(s, d)).select("season", "GW", F.unix_micros("deadline").alias("deadline"), F.unix_micros("prev_deadline").alias("prev_deadline")), ctes("dl") + "SELECT season, GW, epoch_us(deadline) AS deadline, epoch_us(prev_deadline) AS prev_deadline FROM dl")


def windows(s, d):
    return X.snapshot_windows(X.deadlines(match_events(s, d)), snaps(s, d))


add("F18_snapshot_windows", lambda s, d: windows(s, d).select("season", "GW", "sha", "stale", F.unix_micros("captured_at").alias("captured_at")), ctes("win") + "SELECT season, GW, sha, stale, epoch_us(captured_at) AS captured_at FROM win")


def snap_rows(s, d):
    return X.snapshot_features(match_events(s, d).select("season", "GW", "element", "fixture"), windows(s, d), snaps(s, d))


_SP = [("sp_pen1", "penalties_order = 1"), ("sp_pen", "penalties_order IN (1, 2)"), ("sp_corners1", "corners_order = 1"), ("sp_fk1", "freekicks_order = 1")]
CTES["sf"] = (
    "SELECT m.season, m.GW, m.element, m.fixture, CAST(status IN ('i', 's', 'u', 'n') AS DOUBLE) AS snap_unavailable, CAST(status = 'd' AS DOUBLE) AS snap_doubtful, coalesce(chance, CASE WHEN status = 'a' THEN 100 END) AS snap_chance, CAST(news_flag AS DOUBLE) AS snap_news, CASE WHEN status IS NOT NULL THEN round(epoch(w.deadline - w.captured_at) / 86400, 6) END AS snap_age_days, "
    + ", ".join(f"CASE WHEN status IS NOT NULL AND kn THEN CAST(coalesce({t}, false) AS DOUBLE) END AS {n}" for n, t in _SP)
    + ", CAST(CASE WHEN status IS NULL THEN 1 WHEN status IN ('u', 'n') THEN 0 WHEN chance IS NOT NULL THEN chance / 100 WHEN status IN ('i', 's') THEN 0 ELSE 1 END AS DOUBLE) AS chance_of_playing, w.captured_at IS NOT NULL AS has_window, status FROM me m LEFT JOIN win w ON w.season = m.season AND w.GW = m.GW LEFT JOIN sn ON sn.season = w.season AND sn.sha = w.sha AND sn.element = m.element LEFT JOIN (SELECT season, sha, bool_or(penalties_order IS NOT NULL OR corners_order IS NOT NULL OR freekicks_order IS NOT NULL) AS kn FROM sn GROUP BY season, sha) q ON q.season = sn.season AND q.sha = sn.sha",
    ("me", "win", "sn"))
add("F19_snapshot_features", lambda s, d: six(snap_rows(s, d)), ctes("sf") + "SELECT * EXCLUDE (has_window, status) FROM sf")
_LERP = "CASE WHEN {c} <= 0 THEN 0 WHEN {c} <= 0.25 THEN {c} * 0.61 / 0.25 WHEN {c} <= 0.5 THEN 0.61 + ({c} - 0.25) * (0.77 - 0.61) / 0.25 WHEN {c} <= 0.75 THEN 0.77 + ({c} - 0.5) * (0.91 - 0.77) / 0.25 WHEN {c} <= 1 THEN 0.91 + ({c} - 0.75) * (1 - 0.91) / 0.25 ELSE 1 END"
add("F20_points_factor", lambda s, d: six(app(s, d).select(*ROW, X.points_factor(F.col("creativity") / 30).alias("factor"))), ctes("app") + f"SELECT element, fixture, line, round({_LERP.format(c='(creativity / 30)')}, 6) AS factor FROM app")
_COPN = "(CASE WHEN status IN ('u', 'n') THEN 0 WHEN chance_next IS NOT NULL THEN chance_next / 100 WHEN status IN ('i', 's') THEN 0 ELSE 1 END)"
add("F21_horizon_availability", lambda s, d: six(pl(s, d).select("element", "status", "chance_next", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step")).withColumn("availability", X.horizon_availability(F.col("step"))).select("element", "step", "availability")),
    ctes("pl", extra={"n": f"SELECT element, status, {_LERP.format(c=_COPN)} AS f FROM pl"}) + "SELECT element, CAST(step AS INT) AS step, round(CASE WHEN step = 1 THEN f WHEN status IN ('u', 'n') THEN 0 WHEN f = 0 THEN CASE WHEN step = 2 THEN 0.5 ELSE 1 END ELSE 1 END, 6) AS availability FROM n, (SELECT unnest([1, 2, 3, 4]) AS step)")


def shifted_kickoffs(s, d):
    """Matches spread over the day and the year's clock changes."""
    return fx(s, d).withColumn("kickoff_time", F.col("kickoff_time") + F.make_interval(hours=(F.col("id") % 24).cast("int")))


_UK = "timezone('UTC', timezone('Europe/London', {t}))"
_BACK = "CASE isodow(lk) WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 0 WHEN 6 THEN 1 ELSE 2 END"
_HOUR = "CASE WHEN isodow(lk) IN (2, 3, 4) THEN 13 ELSE 17 END"
CTES["col"] = (f"SELECT *, timezone('UTC', timezone('Europe/London', CAST(CAST(lk AS DATE) - CAST({_BACK} AS INT) AS TIMESTAMP) + to_hours({_HOUR}))) AS ca FROM (SELECT *, timezone('Europe/London', timezone('UTC', kt)) AS lk FROM (SELECT *, kickoff_time + to_hours(CAST(id % 24 AS INT)) AS kt FROM fx))", ("fx",))
add("F22_collected_at", lambda s, d: shifted_kickoffs(s, d).select("id", F.unix_seconds(X.collected_at()).alias("collected_at")), ctes("col") + "SELECT id, CAST(epoch(ca) AS BIGINT) AS collected_at FROM col")


def raw_odds(s, d):
    """Price texts of each match; some cells are missing or unusable."""
    i, p = F.col("id"), F.col("total_price")
    price = lambda k, m: (1.2 + F.pmod(F.floor(p / k), F.lit(m)) / 100.0)
    return fx(s, d).select(
        "id", "season", F.date_format("kickoff_time", "dd/MM/yyyy").alias("Date"), F.lit("E0").alias("Div"), F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"), i.alias("row_no"),
        F.when(i % 7 == 0, F.lit("")).when(i % 11 == 0, F.lit("0.5")).otherwise(price(3, 400).cast("string")).alias("AvgH"), price(7, 300).cast("string").alias("AvgD"), price(11, 500).cast("string").alias("AvgA"),
        F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise(price(13, 150).cast("string")).alias("AvgOver"), price(17, 200).cast("string").alias("AvgUnder"),
        price(19, 400).cast("string").alias("B365H"), price(23, 300).cast("string").alias("B365D"), price(29, 500).cast("string").alias("B365A"), F.when(i % 10 == 0, F.lit("x")).otherwise(price(31, 150).cast("string")).alias("B365Over"), price(37, 200).cast("string").alias("B365Under"))


def _p(k, m):
    return f"1.2 + (CAST(floor(total_price / {k}) AS BIGINT) % {m}) / 100.0"


CTES["od"] = (
    "SELECT season, home_team AS home, away_team AS away, id, kickoff_time, (1/h) / (1/h + 1/d + 1/a) AS p_home, (1/d) / (1/h + 1/d + 1/a) AS p_draw, (1/a) / (1/h + 1/d + 1/a) AS p_away, (1/o) / (1/o + 1/u) AS p_over FROM ("
    f"SELECT *, CAST(CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN {_p(19, 400)} ELSE {_p(3, 400)} END AS DOUBLE) AS h, CAST({_p(7, 300)} AS DOUBLE) AS d, CAST({_p(11, 500)} AS DOUBLE) AS a, CAST(CASE WHEN id % 10 = 0 THEN NULL WHEN id % 5 = 0 THEN {_p(31, 150)} ELSE {_p(13, 150)} END AS DOUBLE) AS o, CAST({_p(17, 200)} AS DOUBLE) AS u, row_number() OVER (PARTITION BY season, home_team, away_team ORDER BY id DESC) AS k FROM fx) WHERE k = 1", ("fx",))


def odds(s, d):
    from touchline.sources.readers import parse_odds

    return parse_odds(raw_odds(s, d), F.col("season"))


def _side_rows(s, d):
    two = F.array(F.struct(F.col("home_team").alias("team"), F.lit(True).alias("was_home")), F.struct(F.col("away_team").alias("team"), F.lit(False).alias("was_home")))
    f = shifted_kickoffs(s, d).select("id", "season", F.col("gameweek").alias("GW"), "kickoff_time", "home_team", "away_team", F.explode(two).alias("x"))
    return f.select("id", "season", "GW", "kickoff_time", "home_team", "away_team", "x.*")


_CHANCE = "(exp(-({r})) * power({r}, {k}) / factorial(CAST({k} AS INTEGER)))"
_UP_TO = "list_sum([" + _CHANCE.format(r="{r}", k="j") + " FOR j IN range(0, i)])"
_H, _A = "((t + lo + w / 2) / 2)", "((t - lo - w / 2) / 2)"
_LEAD = f"list_sum([{_CHANCE.format(r=_H, k='i')} * {_UP_TO.format(r=_A)} - {_CHANCE.format(r=_A, k='i')} * {_UP_TO.format(r=_H)} FOR i IN range(1, 16)])"
_GOALS = {
    "tot": "SELECT season, home, away, p_home - p_away AS goal, p_over, CAST(0.05 AS DOUBLE) AS lo, CAST(9.95 AS DOUBLE) AS w, 0 AS k FROM od WHERE p_home IS NOT NULL AND p_away IS NOT NULL AND p_over IS NOT NULL UNION ALL "
    "SELECT season, home, away, goal, p_over, CASE WHEN 1 - exp(-(lo + w / 2)) * (1 + (lo + w / 2) + (lo + w / 2) * (lo + w / 2) / 2) < p_over THEN lo + w / 2 ELSE lo END, w / 2, k + 1 FROM tot WHERE k < 60",
    "gap": "SELECT season, home, away, goal, lo + w / 2 AS t, -0.999 * (lo + w / 2) AS lo, 1.998 * (lo + w / 2) AS w, 0 AS k FROM tot WHERE k = 60 UNION ALL "
    f"SELECT season, home, away, goal, t, CASE WHEN {_LEAD} < goal THEN lo + w / 2 ELSE lo END, w / 2, k + 1 FROM gap WHERE k < 60",
    "lam": "SELECT od.*, (t + lo + w / 2) / 2 AS lam_h, (t - lo - w / 2) / 2 AS lam_a FROM od LEFT JOIN (SELECT * FROM gap WHERE k = 60) USING (season, home, away)",
}


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


add("F23_odds_features", lambda s, d: six(X.odds_features(_side_rows(s, d), X.goal_expectations(odds(s, d))).select("id", "team", "odds_win", "odds_draw", "odds_gf", "odds_ga", "odds_cs")),
    recursive(ctes("col", "od", extra=_GOALS | {"q": "SELECT season, gameweek, min(kt) - INTERVAL 90 MINUTE AS dl FROM col GROUP BY season, gameweek"}))
    + "SELECT col.id, CASE WHEN w.w THEN home_team ELSE away_team END AS team, round(CASE WHEN ca <= dl THEN CASE WHEN w.w THEN p_home ELSE p_away END END, 6) AS odds_win, round(CASE WHEN ca <= dl THEN p_draw END, 6) AS odds_draw, round(CASE WHEN ca <= dl THEN CASE WHEN w.w THEN lam_h ELSE lam_a END END, 6) AS odds_gf, round(CASE WHEN ca <= dl THEN CASE WHEN w.w THEN lam_a ELSE lam_h END END, 6) AS odds_ga, round(CASE WHEN ca <= dl THEN exp(-CASE WHEN w.w THEN lam_a ELSE lam_h END) END, 6) AS odds_cs FROM col JOIN q USING (season, gameweek) LEFT JOIN lam AS od ON od.season = col.season AND od.home = col.home_team AND od.away = col.away_team, (SELECT unnest([true, false]) AS w) w")
add("F24_goal_expectations", lambda s, d: six(X.goal_expectations(odds(s, d)).select("season", "home", "away", "lam_h", "lam_a")),
    recursive(ctes("od", extra=_GOALS)) + "SELECT season, home, away, round(lam_h, 6) AS lam_h, round(lam_a, 6) AS lam_a FROM lam")


# ------------------------------------------------------------------ other competitions on the event table

def ev(s, d, kind):
    return cap(s, d).filter(F.col("kind") == kind).select("season", F.col("element").alias("team"), F.col("element").alias("name"), F.col("captured_at").alias("kickoff_time"), F.col("capture_id"), "value")


for _k in ("purchase", "click", "error", "signup"):
    CTES[f"e_{_k}"] = (f"SELECT season, element AS team, captured_at AS t, capture_id AS id, value FROM cap WHERE kind = '{_k}'", ("cap",))


def _rows(s, d):
    return ev(s, d, "purchase").select("season", "team", "name", "kickoff_time", F.col("capture_id").alias("id"))


for _dir, _op, _ord in (("backward", "<", "DESC"), ("forward", ">", "ASC")):
    for _strict in (True, False):
        _cmp = _op if _strict else _op + "="
        add(f"F25_asof_{_dir}_{'strict' if _strict else 'inclusive'}",
            lambda s, d, a=_dir, b=_strict: X.asof_join(_half_hours(_rows(s, d)), _half_hours(ev(s, d, "click")).select("team", "kickoff_time", "capture_id", F.col("value").alias("hit")), "kickoff_time", ["team"], ["hit"], a, b, tie=["capture_id"], slot=86400).select("id", "hit"),
            ctes("e_purchase", "e_click") + f"SELECT id, hit FROM (SELECT p.id, c.value AS hit, row_number() OVER (PARTITION BY p.id ORDER BY c.t {_ord}, c.id {_ord}) AS k FROM (SELECT *, date_trunc('hour', t) AS h FROM e_purchase) p LEFT JOIN (SELECT team, id, value, date_trunc('hour', t) AS t FROM e_click) c ON c.team = p.team AND c.t {_cmp} p.h) WHERE k = 1")


def _half_hours(df):
    """Times cut to the hour, so that equal times occur on both sides."""
    return df.withColumn("kickoff_time", F.date_trunc("hour", "kickoff_time"))


add("F26_count_in_days", lambda s, d: X.count_in_days(_rows(s, d), ev(s, d, "click"), ["team"], 14, "matches_14d").select("id", F.col("matches_14d").cast("long").alias("matches_14d")),
    ctes("e_purchase", "e_click") + "SELECT p.id, count(c.id) AS matches_14d FROM e_purchase p LEFT JOIN e_click c ON c.team = p.team AND c.t < p.t AND c.t >= p.t - INTERVAL 14 DAY GROUP BY p.id")
add("F27_sums_in_days", lambda s, d: six(X.sums_in_days(X.sums_in_days(_rows(s, d), ev(s, d, "click"), ["name"], 7, {"minutes_7d": F.col("value"), "starts_7d": F.lit(1)}), ev(s, d, "click"), ["name"], 14, {"minutes_14d": F.col("value")}).select("id", "minutes_7d", "starts_7d", "minutes_14d")),
    ctes("e_purchase", "e_click") + "SELECT p.id, round(coalesce(sum(c.value) FILTER (WHERE c.t >= p.t - INTERVAL 7 DAY), 0), 6) AS minutes_7d, CAST(count(c.id) FILTER (WHERE c.t >= p.t - INTERVAL 7 DAY) AS DOUBLE) AS starts_7d, round(coalesce(sum(c.value), 0), 6) AS minutes_14d FROM e_purchase p LEFT JOIN e_click c ON c.team = p.team AND c.t < p.t AND c.t >= p.t - INTERVAL 14 DAY GROUP BY p.id")


def ties(s, d):
    comp = F.element_at(F.array(*[F.lit(x) for x in ("UCL", "FAC", "UECL", "EFLC", "UEL")]), (F.col("capture_id") % 5 + 1).cast("int"))
    return ev(s, d, "signup").withColumns({"competition": comp, "tier": (F.col("capture_id") % 4 + 1).cast("int"), "tie_id": F.col("capture_id")})


add("F28_tie_distances", lambda s, d: six(X.tie_distances(_rows(s, d), ties(s, d)).select("id", "oc_prev_days", "oc_next_days", "oc_next_tier")),
    ctes("e_purchase", "e_signup", extra={"z": "SELECT p.id, max(c.t) FILTER (WHERE c.t < p.t) AS pv, min(c.t) FILTER (WHERE c.t > p.t) AS nx, any_value(p.t) AS t, arg_min(c.id % 4 + 1, c.t) FILTER (WHERE c.t > p.t) AS tier FROM e_purchase p LEFT JOIN e_signup c ON c.team = p.team GROUP BY p.id",
                                              "y": "SELECT id, coalesce(least(epoch_us(t) / 86400e6 - epoch_us(pv) / 86400e6, 30), 30) AS a, coalesce(least(epoch_us(nx) / 86400e6 - epoch_us(t) / 86400e6, 30), 30) AS b, tier FROM z"})
    + "SELECT id, round(a, 6) AS oc_prev_days, round(b, 6) AS oc_next_days, CAST(coalesce(CASE WHEN b <= 10 THEN tier END, 0) AS DOUBLE) AS oc_next_tier FROM y")


def club_matches(s, d):
    return ev(s, d, "click").select("season", "team", "kickoff_time", F.col("capture_id").alias("match"))


def squad_rows(s, d):
    """Three quarters of the matches have a squad; the player is in two thirds of those."""
    c = ev(s, d, "click").filter("capture_id % 4 <> 0 AND capture_id % 3 <> 0")
    return c.select("name", F.col("capture_id").alias("match"), F.floor("value").alias("minutes"), (F.col("capture_id") % 2).alias("started"))


for _kth in (0, 1):
    add(f"F29_kth_last_match_{_kth}", lambda s, d, k=_kth: X.kth_last_match(_rows(s, d), club_matches(s, d), squad_rows(s, d), club_matches(s, d).filter("match % 4 <> 0"), k).select("id", "minutes_last", "started_last", "squad_last"),
        ctes("e_purchase", "e_click", extra={"z": "SELECT p.id, c.id AS m, c.value, row_number() OVER (PARTITION BY p.id ORDER BY c.t DESC, c.id DESC) AS k FROM e_purchase p LEFT JOIN e_click c ON c.team = p.team AND c.t < p.t",
                                                   "y": f"SELECT p.id, z.m, z.value FROM e_purchase p LEFT JOIN z ON z.id = p.id AND z.k = {_kth + 1}"})
        + "SELECT id, CASE WHEN m % 4 <> 0 THEN CAST(CASE WHEN m % 3 <> 0 THEN floor(value) ELSE 0 END AS DOUBLE) END AS minutes_last, CASE WHEN m % 4 <> 0 THEN CAST(CASE WHEN m % 3 <> 0 THEN m % 2 ELSE 0 END AS DOUBLE) END AS started_last, CASE WHEN m % 4 <> 0 THEN CAST(CASE WHEN m % 3 <> 0 THEN 1 ELSE 0 END AS DOUBLE) END AS squad_last FROM y")


def _played(s, d):
    return ev(s, d, "click").filter("value >= 1").select("name", "kickoff_time", F.col("capture_id").alias("match"), (F.col("capture_id") % 3).alias("ga"), F.floor("value").alias("minutes"))


add("F30_contribution_rate", lambda s, d: six(X.contribution_rate(_rows(s, d), _played(s, d)).select("id", "ac_ga_p90_r8")),
    ctes("e_purchase", "e_click", extra={"z": "SELECT p.id, c.id % 3 AS ga, floor(c.value) AS m, row_number() OVER (PARTITION BY p.id ORDER BY c.t DESC, c.id DESC) AS k FROM e_purchase p LEFT JOIN e_click c ON c.team = p.team AND c.t < p.t AND c.value >= 1"})
    + "SELECT id, round(CASE WHEN sum(m) >= 90 THEN sum(ga) / sum(m) * 90 END, 6) AS ac_ga_p90_r8 FROM z WHERE k <= 8 GROUP BY id")
_TIER = "CASE c.id % 5 WHEN 0 THEN 3 WHEN 2 THEN 1 WHEN 4 THEN 2 END"
add("F31_still_in", lambda s, d: X.still_in(_rows(s, d), _undated(ties(s, d))).select("id", "oc_euro_tier", "oc_cups_alive"),
    ctes("e_purchase", "e_signup", extra={"g": "SELECT *, CASE WHEN id % 9 = 0 THEN NULL ELSE t END AS tt FROM e_signup",
        "z": f"SELECT p.id, arg_min({_TIER}, (coalesce(c.tt, TIMESTAMP '9999-01-01'), c.id)) FILTER (WHERE c.id % 5 IN (0, 2, 4) AND coalesce(c.tt, TIMESTAMP '9999-01-01') >= p.t) AS e, max(CASE WHEN c.id % 5 = 1 AND coalesce(c.tt, TIMESTAMP '9999-01-01') >= p.t THEN 1 ELSE 0 END) AS a, max(CASE WHEN c.id % 5 = 3 AND coalesce(c.tt, TIMESTAMP '9999-01-01') >= p.t THEN 1 ELSE 0 END) AS b FROM e_purchase p LEFT JOIN g c ON c.team = p.team GROUP BY p.id"})
    + "SELECT id, CAST(coalesce(e, 0) AS INT) AS oc_euro_tier, CAST(a + b AS INT) AS oc_cups_alive FROM z")


def _undated(t):
    return t.withColumn("kickoff_time", F.when(F.col("tie_id") % 9 != 0, F.col("kickoff_time")))


# ------------------------------------------------------------------ back-test extras
def _p90(c, w):
    n = f"sum({c}) OVER w{w}"
    m = f"sum(CASE WHEN {c} IS NOT NULL THEN minutes ELSE 0 END) OVER w{w}"
    return f"CASE WHEN {m} >= 90 THEN coalesce({n}, 0) / {m} * 90 END AS {c}_p90_w{w}"


_P90 = ("total_points", "expected_goals")
add("F32_per_90_rates", lambda s, d: six(X.per_90_rates(app(s, d), _P90)),
    ctes("fl") + "SELECT element, season, GW, " + ", ".join(f"round({c}_p90_w{w}, 6) AS {c}_p90_w{w}" for c in _P90 for w in (10, 30)) + " FROM (SELECT *, " + ", ".join(_p90(c, w) for c in _P90 for w in (10, 30)) + " FROM fl WINDOW w10 AS (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), w30 AS (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE k = 1")


def _changes(s, d):
    """A club changes its manager on the day after a heavy home defeat."""
    f = fx(s, d).filter("away_score - home_score >= 3")
    return f.select(F.col("home_team").alias("team"), F.date_add(F.to_date("kickoff_time"), 1).alias("date")).distinct()


def _tm_rows(s, d):
    return tm(s, d).select("season", "GW", "fixture", "team", "kickoff_time")


add("F33_days_since_change", lambda s, d: X.days_since_change(_tm_rows(s, d), _changes(s, d), "team", "team_mgr_days").select("fixture", "team", "team_mgr_days"),
    ctes("tm", "fx", extra={"c": "SELECT DISTINCT home_team AS team, CAST(kickoff_time AS DATE) + 1 AS dt FROM fx WHERE away_score - home_score >= 3", "g": "SELECT season, GW, CAST(min(kickoff_time) AS DATE) AS st FROM tm GROUP BY season, GW"})
    + "SELECT tm.fixture, tm.team, CAST(coalesce(least(365, g.st - max(c.dt)), 365) AS DOUBLE) AS team_mgr_days FROM tm JOIN g USING (season, GW) LEFT JOIN c ON c.team = tm.team AND c.dt < g.st GROUP BY tm.fixture, tm.team, g.st")
add("F34_rotation", lambda s, d: six(X.rotation(app(s, d))),
    ctes("fl", extra={"u": "SELECT team, season, GW, fixture, min(kickoff_time) AS kickoff_time, list(DISTINCT name) AS nm FROM fl WHERE started = 1 GROUP BY team, season, GW, fixture",
                      "v": "SELECT *, lag(nm) OVER (PARTITION BY team ORDER BY kickoff_time, fixture) AS pv FROM u",
                      "x": "SELECT *, CASE WHEN pv IS NOT NULL THEN len(list_filter(nm, lambda e: NOT list_contains(pv, e))) END AS changes, row_number() OVER (PARTITION BY team, season, GW ORDER BY kickoff_time, fixture) AS k FROM v"})
    + first_of_gw([roll("changes", 6, out="team_rotation_r6", part="team", order="kickoff_time, fixture")], "x", "team, season, GW"))
# the rule match by match: a player's last six counted matches, those waiting, his absence, matches since the last one
_ABSENCE = {
    "am": "SELECT element, season, GW, fixture, line, row_number() OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line) AS n, minutes AS m, coalesce(starts, CASE WHEN minutes >= 60 THEN 1 ELSE 0 END) AS s FROM app",
    "aw": "SELECT DISTINCT element, CAST(1 AS BIGINT) AS n, CAST([] AS STRUCT(n BIGINT, s BIGINT)[]) AS counted, CAST([] AS STRUCT(n BIGINT, s BIGINT)[]) AS waiting, false AS regular, 0 AS away, 10 AS back FROM am UNION ALL "
    "SELECT a.element, a.n + 1, "
    "CASE WHEN m > 0 THEN list_concat(list_concat(counted, waiting), [{'n': CAST(a.n AS BIGINT), 's': CAST(s AS BIGINT)}])[-6:] ELSE counted END, "
    "CASE WHEN m > 0 OR away > 0 THEN [] WHEN len(waiting) >= 2 AND regular THEN [] ELSE list_append(waiting, {'n': CAST(a.n AS BIGINT), 's': CAST(s AS BIGINT)}) END, "
    "CASE WHEN m = 0 AND away = 0 AND len(waiting) = 0 THEN coalesce(list_sum(list_transform(counted[-3:], lambda x: x.s)), 0) >= 2 ELSE regular END, "
    "CASE WHEN m > 0 THEN 0 WHEN away > 0 THEN away + 1 WHEN len(waiting) >= 2 AND regular THEN len(waiting) + 1 ELSE 0 END, "
    "CASE WHEN m > 0 AND away > 0 THEN 1 ELSE least(back + 1, 10) END "
    "FROM aw JOIN am a ON a.element = aw.element AND a.n = aw.n",
    "ag": "SELECT am.element, am.season, am.GW, aw.away, aw.back, list_concat(counted, waiting)[-6:] AS eff FROM (SELECT element, season, GW, min(n) AS n FROM am GROUP BY ALL) am JOIN aw ON aw.element = am.element AND aw.n = am.n",
    "ae": "SELECT element, season, GW, unnest(list_transform(eff, lambda x: x.n)) AS n, len(eff) - generate_subscripts(eff, 1) AS ago FROM ag",
    "av": "SELECT row_number() OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line) AS n, * EXCLUDE (season, GW), CAST(minutes > 0 AS DOUBLE) AS played, coalesce(starts, CAST(minutes >= 60 AS INT)) AS started FROM app",
}
_ABSENCE_COLS = [(c, w) for c in X.FORM_STATS if c in ("played", "started") or c in roles.APPEARANCE for w in (1, *X.FORM_WINDOWS) if w > 1 or c in X.LAST_MATCH_STATS]
_ABSENCE["aa"] = "SELECT ae.element, ae.season, ae.GW, " + ", ".join(f"avg(av.{c}) FILTER (ago < {w}) AS {c}_r{w}_a" for c, w in _ABSENCE_COLS) + " FROM ae JOIN av ON av.element = ae.element AND av.n = ae.n GROUP BY ALL"
add("F35_absence_form", lambda s, d: six(X.absence_form(app(s, d))),
    ctes("app", extra=_ABSENCE).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT ag.element, ag.season, ag.GW, " + ", ".join(f"round({c}_r{w}_a, 6) AS {c}_r{w}_a" for c, w in _ABSENCE_COLS)
    + ", CAST(away AS DOUBLE) AS absent_run, CAST(back AS DOUBLE) AS since_return FROM ag LEFT JOIN aa USING (element, season, GW)")
_DCP = "CASE WHEN defensive_contribution IS NULL THEN NULL WHEN position = 'GK' THEN 0 WHEN defensive_contribution >= CASE position WHEN 'DEF' THEN 10 ELSE 12 END THEN 2 ELSE 0 END"
add("F36_dc_points", lambda s, d: app(s, d).select(*ROW, X.dc_points().alias("dc_points")), ctes("app") + f"SELECT element, fixture, line, CAST({_DCP} AS DOUBLE) AS dc_points FROM app")
add("F37_dc_expectation", lambda s, d: six(X.dc_expectation(app(s, d), "1998-99").select(*ROW, "dc_pts", "dc_hat")),
    ctes("fl", extra={
        "x": f"SELECT *, {_DCP} AS pts FROM fl",
        "y": "SELECT *, coalesce(sum(coalesce(pts, 0)) OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS s, coalesce(sum(CASE WHEN pts IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS n, avg(played) OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS p6 FROM x",
        "f": "SELECT element AS e, season AS ss_, GW AS gg, s, n, p6 FROM y WHERE k = 1",
        "g": "SELECT position AS po, season AS ss_, GW AS gg, sum(ss) OVER w AS ps, sum(nn) OVER w AS pn FROM (SELECT position, season, GW, sum(CASE WHEN pts IS NOT NULL AND minutes > 0 THEN pts ELSE 0 END) AS ss, sum(CASE WHEN pts IS NOT NULL AND minutes > 0 THEN 1 ELSE 0 END) AS nn FROM x GROUP BY position, season, GW) WINDOW w AS (PARTITION BY position ORDER BY season, GW ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"})
    + "SELECT x.element, x.fixture, x.line, CAST(coalesce(pts, 0) AS DOUBLE) AS dc_pts, round(CASE WHEN season >= '1998-99' AND position <> 'GK' THEN (f.s + 3 * coalesce(CASE WHEN pn > 0 THEN ps / pn END, 0) * coalesce(p6, 0)) / (f.n + 3) ELSE 0 END, 6) AS dc_hat FROM x JOIN f ON f.e = x.element AND f.ss_ = x.season AND f.gg = x.GW JOIN g ON g.po = x.position AND g.ss_ = x.season AND g.gg = x.GW")


def _prev_tier(s, d):
    t = D.team_season_estimates(app(s, d)).select((F.substring("season", 1, 4).cast("int") + 1).alias("y"), "team", F.col("goals_per_game").alias("efl_gf_pg"))
    t = t.select(F.concat_ws("-", F.col("y").cast("string"), F.lpad(((F.col("y") + 1) % 100).cast("string"), 2, "0")).alias("season"), "team", "efl_gf_pg")
    p = app(s, d).groupBy("season", F.lower("name").alias("name_key")).agg(F.avg("goals_scored").alias("efl_g90"))
    rows = sided(s, d).select("season", "GW", *ROW, "team", F.when(F.col("was_home"), F.col("away_team")).otherwise(F.col("home_team")).alias("opponent"), F.lower("name").alias("name_key"))
    return X.previous_tier(rows, t, p, ["efl_gf_pg"])


CTES["pt"] = (
    "SELECT a.season, a.GW, a.element, a.fixture, a.line, round(x.g, 6) AS team_efl_gf_pg, round(y.g, 6) AS opp_efl_gf_pg, round(z.g, 6) AS efl_g90 FROM sided a LEFT JOIN tg x ON x.y = CAST(substr(a.season, 1, 4) AS INT) AND x.team = a.team LEFT JOIN tg y ON y.y = x.y AND y.team = CASE WHEN was_home THEN away_team ELSE home_team END LEFT JOIN (SELECT season, name, avg(goals_scored) AS g FROM app GROUP BY season, name) z ON z.season = a.season AND z.name = a.name", ("sided", "tg"))
CTES["tg"] = ("SELECT CAST(substr(season, 1, 4) AS INT) + 1 AS y, team, sum(goals_scored) / count(DISTINCT GW) AS g FROM app GROUP BY season, team", ("app",))
add("F38_previous_tier", lambda s, d: six(_prev_tier(s, d).select(*ROW, "team_efl_gf_pg", "opp_efl_gf_pg", "efl_g90")), ctes("pt") + "SELECT element, fixture, line, team_efl_gf_pg, opp_efl_gf_pg, efl_g90 FROM pt")
add("F39_subset_flags", lambda s, d: X.subset_flags(_prev_tier(s, d).withColumns({"md": F.col("fixture") % 100, "sr": F.col("fixture") % 11}), "team_efl_gf_pg", "md", "sr").select(*ROW, "sub_promoted_early", "sub_new_manager", "sub_after_absence"),
    ctes("pt") + "SELECT element, fixture, line, CAST(team_efl_gf_pg IS NOT NULL AND GW <= 6 AS DOUBLE) AS sub_promoted_early, CAST(fixture % 100 < 60 AS DOUBLE) AS sub_new_manager, CAST(fixture % 11 <= 3 AS DOUBLE) AS sub_after_absence FROM pt")

# ------------------------------------------------------------------ older features, next gameweek
CTES["lg"] = (
    "SELECT *, avg(total_points) OVER w4 AS form, avg(minutes) OVER w5 AS m5, lag(CASE WHEN minutes > 0 THEN total_points / minutes * 90 ELSE 0 END) OVER w AS p90, avg(CASE WHEN was_home THEN total_points END) OVER w4 AS hf, avg(CASE WHEN NOT was_home THEN total_points END) OVER w4 AS af FROM sided WINDOW w AS (PARTITION BY element ORDER BY kickoff_time, fixture, line), w4 AS (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", ("sided",))
add("F40_legacy_form", lambda s, d: six(X.legacy_form(sided(s, d)).select(*ROW, "form", "minutes_rolling5", "points_per_90", "home_form", "away_form", "gw_in_season")),
    ctes("lg") + "SELECT element, fixture, line, round(coalesce(form, 0), 6) AS form, round(coalesce(m5, 0), 6) AS minutes_rolling5, round(coalesce(p90, 0), 6) AS points_per_90, round(coalesce(last_value(hf IGNORE NULLS) OVER w, 0), 6) AS home_form, round(coalesce(last_value(af IGNORE NULLS) OVER w, 0), 6) AS away_form, round(GW / 38.0, 6) AS gw_in_season FROM lg WINDOW w AS (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
add("F41_congestion", lambda s, d: six(X.congestion(written(app(s, d).select(*ROW, "season", "GW", "team", "kickoff_time"), "appearances")).select(*ROW, "days_since_last_match", "matches_in_next_14_days", "fixture_congestion_risk")),
    ctes("app", extra={"g": "SELECT season, GW, team, count(DISTINCT fixture) AS n FROM app GROUP BY ALL", "x": "SELECT app.*, CAST(coalesce(CAST(kickoff_time AS DATE) - CAST(lag(kickoff_time) OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line) AS DATE), 7) AS INT) AS dd, CASE WHEN n >= 2 THEN 4 ELSE 2 END AS mm FROM app JOIN g USING (season, GW, team)"})
    + "SELECT element, fixture, line, dd AS days_since_last_match, mm AS matches_in_next_14_days, round(CASE WHEN dd <= 3 THEN 0.4 ELSE 0 END + least(mm / 6, 1) * 0.35, 6) AS fixture_congestion_risk FROM x")
add("F41_matches_ahead", lambda s, d: X.matches_ahead(_tm_rows(s, d), _tm_rows(s, d).select("team", "kickoff_time")).select("fixture", "team", "matches_ahead"),
    ctes("tm") + "SELECT a.fixture, a.team, count(b.fixture) AS matches_ahead FROM tm a LEFT JOIN tm b ON b.team = a.team AND b.kickoff_time > a.kickoff_time AND b.kickoff_time <= a.kickoff_time + INTERVAL 14 DAY GROUP BY a.fixture, a.team")
add("F42_start_features", lambda s, d: six(X.start_features(app(s, d)).select(*ROW, "started_last_match", "started_2_of_last_3", "avg_minutes_last_3")),
    ctes("fl") + "SELECT element, fixture, line, CAST(coalesce(lag(started) OVER w, 0) AS INT) AS started_last_match, CAST(coalesce(sum(started) OVER w3, 0) >= 2 AS INT) AS started_2_of_last_3, round(coalesce(avg(minutes) OVER w3, 0), 6) AS avg_minutes_last_3 FROM fl WINDOW w AS (PARTITION BY element ORDER BY kickoff_time, fixture, line), w3 AS (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
add("F43_adaptation", lambda s, d: six(X.adaptation(app(s, d).withColumn("promoted", F.col("fixture") % 2 == 0), "promoted").select(*ROW, "adaptation_progress", "adaptation_velocity", "experience_weight", "adaptation_phase", "adaptation_multiplier")),
    ctes("app", extra={"x": "SELECT *, fixture % 2 = 0 AS p, exp(-0.3 * (GW - 12)) AS e FROM app"})
    + "SELECT element, fixture, line, round(CASE WHEN p THEN 1 / (1 + e) ELSE 0 END, 6) AS adaptation_progress, round(CASE WHEN p THEN 0.3 * e / ((1 + e) * (1 + e)) ELSE 0 END, 6) AS adaptation_velocity, round(CASE WHEN p THEN 0.1 + 0.8 / (1 + e) ELSE 1 END, 6) AS experience_weight, CASE WHEN NOT p THEN 'established' WHEN GW <= 6 THEN 'early' WHEN GW <= 15 THEN 'mid' ELSE 'late' END AS adaptation_phase, round(CASE WHEN p THEN 0.70 + 0.25 / (1 + e) ELSE 1 END, 6) AS adaptation_multiplier FROM x")
add("F44_price_velocity", lambda s, d: six(X.price_velocity(cap(s, d).select("element", F.col("captured_at").alias("at"), F.col("value").alias("price")), "element", "2024-01-25 12:00:00")),
    ctes("cap", extra={"x": "SELECT element, count(*) AS n, arg_min(value, (captured_at, value)) AS a, arg_max(value, (captured_at, value)) AS b, floor(epoch(max(captured_at) - min(captured_at)) / 86400) AS d FROM cap WHERE captured_at > TIMESTAMP '2024-01-18 12:00:00' AND captured_at <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY element"})
    + "SELECT c.element, round(coalesce(CASE WHEN n >= 2 AND d > 0 THEN (b - a) / d ELSE 0 END, 0), 6) AS velocity FROM (SELECT DISTINCT element FROM cap) c LEFT JOIN x USING (element)")
add("F45_upcoming_rows", lambda s, d: six(X.upcoming_rows(pl(s, d), fx(s, d), CURRENT, 7).drop("kickoff_time")),
    ctes("pl", "tr", extra={"p": f"SELECT *, {pct('selected_by_percent', '1')} AS selected_rank FROM pl"})
    + f"SELECT '{CURRENT}' AS season, 7 AS GW, p.element, p.name, p.position, p.team, tr.opponent, tr.id AS fixture, tr.is_home, p.now_cost AS value, round(selected_rank, 6) AS selected_rank, p.transfers_in_event AS transfers_in, p.transfers_out_event AS transfers_out FROM p JOIN tr ON tr.team = p.team AND tr.season = '{CURRENT}' AND tr.gameweek = 7")
_CUT = f"(season < '{CURRENT}' AND CAST(substr(season, 1, 4) AS INT) >= 1998 OR season = '{CURRENT}' AND GW < 5 AND kickoff_time < (SELECT min(kickoff_time) FROM app WHERE season = '{CURRENT}' AND GW = 5))"
add("F46_history_cut", lambda s, d: X.history_cut(app(s, d), CURRENT, 5).select(*ROW, "season", "GW", "total_points"), ctes("app") + f"SELECT element, fixture, line, season, GW, total_points FROM app WHERE {_CUT}")
add("F47_rest_days", lambda s, d: six(X.rest_days(_tm_rows(s, d), _tm_rows(s, d)).select("fixture", "team", "rest_days")),
    ctes("tm") + "SELECT fixture, team, round(epoch(kickoff_time - (SELECT max(b.kickoff_time) FROM tm b WHERE b.team = a.team AND b.kickoff_time < a.kickoff_time)) / 86400, 6) AS rest_days FROM tm a")
add("F48_last_mean", lambda s, d: six(X.last_mean(app(s, d))), ctes("app") + "SELECT element, round(avg(total_points), 6) AS naive FROM (SELECT *, row_number() OVER (PARTITION BY element ORDER BY kickoff_time DESC, fixture DESC, line DESC) AS r FROM app) WHERE r <= 5 GROUP BY element")
add("F49_players_at", lambda s, d: X.players_at(app(s, d).filter("GW <> 5 OR team < 'Club 5'"), SEASON49, 5, pl(s, d)).select("element", "name", "position", "team", "value", "status"),
    ctes("app", "pl", extra={"a": "SELECT * FROM app WHERE season = '1999-00' AND (GW <> 5 OR team < 'Club 5')",
        "t": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line) AS r FROM a WHERE GW = 5) WHERE r = 1",
        "l": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element ORDER BY GW DESC, kickoff_time DESC, fixture DESC, line DESC) AS r FROM a WHERE GW < 5) WHERE r = 1 AND element NOT IN (SELECT element FROM t) AND team NOT IN (SELECT team FROM t)"})
    + "SELECT u.element, u.name, u.position, u.team, u.value, coalesce(pl.status, 'a') AS status FROM (SELECT * FROM t UNION ALL SELECT * FROM l) u LEFT JOIN pl USING (element)")
SEASON49 = "1999-00"


def _known(s, d):
    o = raw_odds(s, d).join(shifted_kickoffs(s, d).select("id", "kickoff_time"), "id")
    a, b = X.known_at(o, snaps(s, d), F.lit("1999-05-01").cast("timestamp"))
    c, e = X.known_at(o, snaps(s, d), F.lit("2024-01-15").cast("timestamp"))
    return a.agg(F.count("*").alias("prices")).select(F.lit("prices").alias("kind"), F.col("prices").alias("n")).unionByName(e.agg(F.count("*").alias("n")).select(F.lit("captures").alias("kind"), "n"))


add("F50_known_at", _known, ctes("col", "sn") + "SELECT 'prices' AS kind, count(*) AS n FROM col WHERE ca <= TIMESTAMP '1999-05-01' UNION ALL SELECT 'captures', count(*) FROM sn WHERE captured_at < TIMESTAMP '2024-01-15'")
add("F51_start_inputs", lambda s, d: six(X.start_inputs(app(s, d)).select(*ROW, "prev_form", "start_rate")),
    ctes("fl") + "SELECT element, fixture, line, round(coalesce(avg(total_points) OVER w, 0), 6) AS prev_form, round(coalesce(avg(started) OVER w, 0), 6) AS start_rate FROM fl WINDOW w AS (PARTITION BY element ORDER BY kickoff_time, fixture, line ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
