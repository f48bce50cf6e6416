"""Queries for league tables, gameweek pages and squads (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import derived as D
from touchline.operators import league as L
from touchline.operators import readlib as R
from touchline.plans import roles
from touchline.plans.registry import add
from touchline.plans.roles import CURRENT, CTES, ctes
from touchline.session import written

app, fx, pl, sided = roles.appearances, roles.fixtures, roles.players, roles.sided_appearances

CTES["tr"] = (
    "SELECT *, CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for = goals_against THEN 'D' WHEN goals_for < goals_against THEN 'L' END AS result FROM ("
    "SELECT id, season, gameweek, kickoff_time, status, home_team AS team, away_team AS opponent, true AS is_home, home_score AS goals_for, away_score AS goals_against, home_difficulty AS difficulty FROM fx "
    "UNION ALL SELECT id, season, gameweek, kickoff_time, status, away_team, home_team, false, away_score, home_score, away_difficulty FROM fx)",
    ("fx",),
)
CTES["act"] = ("SELECT season, GW, element, CAST(sum(total_points) AS BIGINT) AS points, CAST(sum(minutes) AS BIGINT) AS minutes FROM app GROUP BY season, GW, element", ("app",))


def tr(s, d):
    return L.team_rows(fx(s, d))


_CLEAN = "SELECT id, season, gameweek, home_team, away_team, status, home_score, away_score FROM fx WHERE source <> 'csv' OR season NOT IN (SELECT season FROM fx WHERE source <> 'csv')"
add("L1_clean_fixtures", lambda s, d: L.clean_fixtures(fx(s, d)).select("id", "season", "gameweek", "home_team", "away_team", "status", "home_score", "away_score"), ctes("fx") + _CLEAN)
_TAB = "count(result) AS played, count(*) FILTER (WHERE result = 'W') AS won, count(*) FILTER (WHERE result = 'D') AS drawn, count(*) FILTER (WHERE result = 'L') AS lost, CAST(coalesce(sum(goals_for), 0) AS BIGINT) AS goals_for, CAST(coalesce(sum(goals_against), 0) AS BIGINT) AS goals_against"
_TABLE = {
    "t": f"SELECT season, team, {_TAB} FROM tr GROUP BY season, team",
    "fo": "SELECT season, team, string_agg(result, '' ORDER BY kickoff_time, id) AS form FROM (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY kickoff_time DESC, id DESC) AS rn FROM tr WHERE result IS NOT NULL) WHERE rn <= 5 GROUP BY season, team",
    "nx": "SELECT season, team, opponent, is_home FROM (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY kickoff_time, id) AS rn FROM tr WHERE status = 'scheduled') WHERE rn = 1",
}
add("L2_league_table", lambda s, d: L.league_table(fx(s, d)),
    ctes("tr", extra=_TABLE) + "SELECT season, CAST(row_number() OVER (PARTITION BY season ORDER BY won * 3 + drawn DESC, goals_for - goals_against DESC, goals_for DESC, team) AS INT) AS position, team, played, won, drawn, lost, goals_for, goals_against, goals_for - goals_against AS goal_difference, won * 3 + drawn AS points, coalesce(form, '') AS form, nx.opponent AS next_opponent, nx.is_home AS next_is_home FROM t LEFT JOIN fo USING (season, team) LEFT JOIN nx USING (season, team)")
_STATE = {
    "g": "SELECT season, gameweek, bool_or(status IN ('in_progress', 'finished')) AS st, bool_and(status = 'finished') AS fi, bool_or(status = 'scheduled') AS co FROM fx GROUP BY season, gameweek",
    "z": "SELECT season, max(gameweek) FILTER (WHERE st) AS current_gameweek, min(gameweek) FILTER (WHERE co) AS next_gameweek, coalesce(string_agg(CAST(gameweek AS STRING), ',' ORDER BY gameweek) FILTER (WHERE fi), '') AS finished_gameweeks, min(gameweek) AS a, max(gameweek) AS b FROM g GROUP BY season",
}
add("L3_season_state", lambda s, d: L.season_state(fx(s, d)).drop("__first", "__last"), ctes("fx", extra=_STATE) + "SELECT season, current_gameweek, next_gameweek, finished_gameweeks FROM z")
add("L4_default_gameweek", lambda s, d: L.default_gameweek(fx(s, d)), ctes("fx", extra=_STATE) + "SELECT season, coalesce(next_gameweek, current_gameweek, CASE WHEN next_gameweek IS NOT NULL THEN b ELSE a END) AS fixtures_page, coalesce(current_gameweek, next_gameweek, a) AS gameweek_page FROM z")
add("L5_opponents_in_gameweek", lambda s, d: L.opponents_in_gameweek(fx(s, d)), ctes("tr") + "SELECT season, gameweek, team, string_agg(opponent || CASE WHEN is_home THEN ' (H)' ELSE ' (A)' END, ', ' ORDER BY kickoff_time, id) AS opponents FROM tr GROUP BY season, gameweek, team")
_TICK = "SELECT season, team, count(*) FILTER (WHERE gameweek BETWEEN 6 AND 9) AS fixtures, CAST(coalesce(sum(difficulty) FILTER (WHERE gameweek BETWEEN 6 AND 9), 0) AS BIGINT) AS total_difficulty, round_even(avg(difficulty) FILTER (WHERE gameweek BETWEEN 6 AND 9), 2) AS average_difficulty, coalesce(string_agg(CAST(gameweek AS STRING) || ':' || opponent, ',' ORDER BY gameweek, kickoff_time, id) FILTER (WHERE gameweek BETWEEN 6 AND 9), '') AS run FROM tr GROUP BY season, team"
add("L6_fixture_ticker", lambda s, d: L.fixture_ticker(fx(s, d), 6, 4), ctes("tr", extra={"t": _TICK}) + "SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY coalesce(average_difficulty, 99), fixtures DESC, team) AS INT) AS place FROM t")
add("L7_position_history", lambda s, d: L.position_history(fx(s, d)),
    ctes("tr", extra={
        "w": "SELECT DISTINCT season, gameweek FROM tr WHERE result IS NOT NULL",
        "c": f"SELECT w.season, tr.team, w.gameweek, {_TAB} FROM w JOIN tr ON tr.season = w.season AND tr.gameweek <= w.gameweek GROUP BY w.season, tr.team, w.gameweek",
        "p": "SELECT *, row_number() OVER (PARTITION BY season, gameweek ORDER BY won * 3 + drawn DESC, goals_for - goals_against DESC, goals_for DESC, team) AS rn FROM c"})
    + "SELECT season, team, gameweek, CAST(rn AS INT) AS position, won * 3 + drawn AS points FROM p WHERE played > 0")
_XG = {"xg": "SELECT fixture, team, round(sum(expected_goals), 2) AS xg FROM app GROUP BY fixture, team HAVING count(expected_goals) > 0",
       "mr": "SELECT tr.*, a.xg AS xg_for, b.xg AS xg_against, CASE WHEN result IS NOT NULL THEN CAST(goals_for AS STRING) || '-' || CAST(goals_against AS STRING) END AS score FROM tr LEFT JOIN xg a ON a.fixture = tr.id AND a.team = tr.team LEFT JOIN xg b ON b.fixture = tr.id AND b.team = tr.opponent"}


def _mr(s, d):
    return L.team_match_rows(fx(s, d), R.expected_goals_by_fixture(app(s, d)))


add("L8_team_match_rows", lambda s, d: _mr(s, d).drop("kickoff_time"), ctes("tr", "app", extra=_XG) + "SELECT * EXCLUDE (kickoff_time) FROM mr")
add("L9_team_summary", lambda s, d: L.team_summary(_mr(s, d)),
    ctes("tr", "app", extra=_XG | {"bw": "SELECT season, team, opponent || ' ' || score AS biggest_win FROM (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY goals_for - goals_against DESC, goals_for DESC, kickoff_time, id) AS rn FROM mr WHERE result = 'W') WHERE rn = 1"})
    + "SELECT season, team, count(*) AS played, count(*) FILTER (WHERE goals_against = 0) AS clean_sheets, count(*) FILTER (WHERE goals_for = 0) AS failed_to_score, round(sum(xg_for) FILTER (WHERE xg_for IS NOT NULL AND xg_against IS NOT NULL), 6) AS xg_for, round(sum(xg_against) FILTER (WHERE xg_for IS NOT NULL AND xg_against IS NOT NULL), 6) AS xg_against, count(*) FILTER (WHERE xg_for IS NOT NULL AND xg_against IS NOT NULL) AS xg_matches, "
    + ", ".join(f"count(*) FILTER (WHERE result = '{x}' AND {'is_home' if at == 'home' else 'NOT is_home'}) AS {at}_{n}" for at in ("home", "away") for x, n in (("W", "won"), ("D", "drawn"), ("L", "lost")))
    + ", any_value(biggest_win) AS biggest_win FROM mr LEFT JOIN bw USING (season, team) WHERE result IS NOT NULL GROUP BY season, team")
_STATS = ("goals", "assists", "clean_sheets", "bonus")


def _next_points(s, d):
    """Predicted points per player for the last gameweek on file."""
    return app(s, d).filter(F.col("season") == CURRENT).groupBy("name").agg(F.round(F.sum("predicted_points"), 3).alias("predicted_points"))


add("L10_squad_leaders", lambda s, d: L.squad_leaders(D.season_stats(app(s, d)), pl(s, d), _next_points(s, d), _STATS),
    ctes("ss", "pl", extra={"pp": f"SELECT name, round(sum(predicted_points), 3) AS predicted_points FROM app WHERE season = '{CURRENT}' GROUP BY name",
        "u": " UNION ALL ".join(f"SELECT season, ss.team, ss.name, ss.position, total_points, now_cost / 10 AS price, predicted_points, '{k}' AS stat, {k} AS value FROM ss LEFT JOIN pl ON pl.name = ss.name LEFT JOIN pp ON pp.name = ss.name" for k in _STATS)})
    + "SELECT * EXCLUDE (rn), CAST(rn AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY season, team, stat ORDER BY value DESC, total_points DESC, name) AS rn FROM u WHERE value > 0) WHERE rn <= 5")
add("L11_form_before", lambda s, d: L.form_before(fx(s, d)),
    ctes("tr") + "SELECT id, team, coalesce(string_agg(result, '' ORDER BY rn DESC), '') AS form FROM (SELECT a.id, a.team, b.result, row_number() OVER (PARTITION BY a.id, a.team ORDER BY b.kickoff_time DESC, b.id DESC) AS rn FROM tr a LEFT JOIN tr b ON b.team = a.team AND b.kickoff_time < a.kickoff_time AND b.result IS NOT NULL) WHERE rn <= 5 GROUP BY id, team")


def _ev(col, side):
    return f"coalesce(string_agg(name || ':' || CAST({col} AS STRING), ',' ORDER BY {col} DESC, name, line) FILTER (WHERE {col} > 0 AND {side}), '')"


_ST = "coalesce(starts > 0, minutes >= 60)"
add("L12_match_summary", lambda s, d: L.match_summary(sided(s, d)),
    ctes("sided", extra={
        "x": "SELECT *, true AS own, CASE WHEN was_home THEN 'home' ELSE 'away' END AS side FROM sided UNION ALL SELECT *, false, CASE WHEN was_home THEN 'away' ELSE 'home' END FROM sided WHERE own_goals > 0",
        "b": "SELECT fixture, CASE WHEN total_points <> 0 THEN name END AS top_scorer FROM (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY total_points DESC, bps DESC, name DESC) AS rn FROM sided) WHERE rn = 1"})
    + f"SELECT fixture, side, {_ev('goals_scored', 'own')} AS scorers, {_ev('assists', 'own')} AS assists, {_ev('own_goals', 'NOT own')} AS own_goals_for, {_ev('yellow_cards', 'own')} AS yellow_cards, {_ev('red_cards', 'own')} AS red_cards, round(sum(expected_goals) FILTER (WHERE own), 6) AS xg, CAST(coalesce(sum(total_points) FILTER (WHERE own), 0) AS BIGINT) AS points, count(*) FILTER (WHERE own AND {_ST}) AS starters, count(*) FILTER (WHERE own AND NOT {_ST} AND minutes > 0) AS substitutes, count(*) FILTER (WHERE own AND NOT {_ST} AND minutes = 0) AS unused, any_value(top_scorer) AS top_scorer FROM x JOIN b USING (fixture) GROUP BY fixture, side")
_IR = "CASE status WHEN 'i' THEN 1 WHEN 's' THEN 2 WHEN 'd' THEN 3 WHEN 'u' THEN 4 WHEN 'n' THEN 5 ELSE 6 END"
add("L13_injuries", lambda s, d: L.injuries(pl(s, d)), ctes("pl") + f"SELECT name, team, position, status, {_IR} AS status_rank, news, news_added FROM pl WHERE status <> 'a' ORDER BY {_IR}, news_added DESC NULLS LAST, name")
_COP = "CASE WHEN status IN ('u', 'n') THEN 0 WHEN chance_next IS NOT NULL THEN chance_next / 100 WHEN status IN ('i', 's') THEN 0 ELSE 1 END"
add("L14_chance_of_playing", lambda s, d: pl(s, d).select("element", L.chance_of_playing().alias("chance")), ctes("pl") + f"SELECT element, CAST({_COP} AS DOUBLE) AS chance FROM pl")


def act(s, d):
    return D.gameweek_actuals(app(s, d))


def act_pos(s, d):
    return act(s, d).join(pl(s, d).select("element", "position"), "element")


add("L15_gameweek_top_scorers", lambda s, d: L.gameweek_top_scorers(act(s, d)), ctes("act") + "SELECT season, GW, element, points, minutes, CAST(rn AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY season, GW ORDER BY points DESC, minutes, element) AS rn FROM act) WHERE rn <= 10")
add("L15_hauls_by_position", lambda s, d: L.gameweek_top_scorers(act_pos(s, d), ("season", "GW", "position"), 3),
    ctes("act", "pl") + "SELECT season, GW, element, points, minutes, position, CAST(rn AS INT) AS rank_no FROM (SELECT act.*, pl.position, row_number() OVER (PARTITION BY season, GW, pl.position ORDER BY points DESC, minutes, element) AS rn FROM act JOIN pl USING (element)) WHERE rn <= 3")
add("L16_bonus_awards", lambda s, d: L.bonus_awards(app(s, d).select("fixture", "element", "line", "bps")),
    ctes("app") + "SELECT fixture, element, line, bps, CAST(greatest(0, 4 - rank() OVER (PARTITION BY fixture ORDER BY bps DESC)) AS INT) AS award FROM app")
add("L17_score_sums", lambda s, d: L.score_sums(app(s, d)), ctes("app") + "SELECT season, GW, element, CAST(sum(bps) AS BIGINT) AS bps FROM app GROUP BY season, GW, element")


def _live(s, d):
    """A live feed for a third of the matches: started, one goal more for the home side."""
    f = fx(s, d).filter("id % 3 = 0")
    return f.select("id", (F.col("id") % 2 == 0).alias("started"), (F.col("id") % 4 == 0).alias("finished"),
                    (F.coalesce("home_score", F.lit(0)) + 1).alias("home_score"), F.coalesce("away_score", F.lit(0)).alias("away_score"))


add("L18_overlay_live", lambda s, d: L.overlay_live(fx(s, d), _live(s, d)).select("id", "status", "home_score", "away_score"),
    ctes("fx") + "SELECT id, CASE WHEN id % 6 = 0 THEN CASE WHEN id % 4 = 0 THEN 'finished' ELSE 'in_progress' END ELSE status END AS status, CASE WHEN id % 6 = 0 THEN coalesce(home_score, 0) + 1 ELSE home_score END AS home_score, CASE WHEN id % 6 = 0 THEN coalesce(away_score, 0) ELSE away_score END AS away_score FROM fx")
add("L19_gameweek_state", lambda s, d: L.gameweek_state(fx(s, d), "2001-07-10"),
    ctes("fx") + "SELECT season, gameweek, CASE WHEN bool_and(status = 'finished') THEN 'finished' WHEN TIMESTAMP '2001-07-10' >= min(kickoff_time) - INTERVAL 90 MINUTE OR bool_or(status IN ('in_progress', 'finished')) THEN 'live' ELSE 'upcoming' END AS state FROM fx GROUP BY season, gameweek")
CTES["pa"] = ("SELECT season, GW, element, round(sum(predicted_points), 3) AS predicted, CAST(sum(total_points) AS BIGINT) AS actual FROM app GROUP BY season, GW, element", ("app",))


def pa(s, d):
    return app(s, d).groupBy("season", "GW", "element").agg(F.round(F.sum("predicted_points"), 3).alias("predicted"), F.sum("total_points").alias("actual"))


add("L20_model_calls", lambda s, d: L.model_calls(pa(s, d), ["season", "GW"], 5),
    ctes("pa", extra={
        "k": "SELECT *, actual - predicted AS gap, row_number() OVER (PARTITION BY season, GW ORDER BY predicted DESC, element) AS p FROM pa",
        "b": "SELECT *, 'best' AS call, row_number() OVER (PARTITION BY season, GW ORDER BY actual DESC, predicted DESC, element) AS rn FROM k WHERE p <= 20",
        "w": "SELECT *, 'worst' AS call, row_number() OVER (PARTITION BY season, GW ORDER BY gap, element) AS rn FROM k WHERE p <= 20",
        "m": "SELECT *, 'missed' AS call, row_number() OVER (PARTITION BY season, GW ORDER BY gap DESC, element) AS rn FROM k WHERE p > 20"})
    + "SELECT season, GW, call, CAST(rn AS INT) AS rank_no, element, predicted, actual, round(gap, 6) AS gap FROM (SELECT * FROM b UNION ALL SELECT * FROM w WHERE gap < 0 UNION ALL SELECT * FROM m WHERE gap > 0) WHERE rn <= 5")
add("L21_merge_live", lambda s, d: L.merge_live(act(s, d).filter("element % 5 <> 0"), act(s, d).filter("element % 3 = 0").withColumn("points", F.col("points") + 1), ["season", "GW", "element"]),
    ctes("act") + "SELECT season, GW, element, CASE WHEN element % 3 = 0 THEN points + 1 ELSE points END AS points, minutes FROM act WHERE element % 5 <> 0 OR element % 3 = 0")


def pool(s, d, points="predicted_points"):
    """Candidates per gameweek: points summed, club and opponents, chance of playing."""
    a = sided(s, d)
    opp = F.when(F.col("was_home"), F.col("away_team")).otherwise(F.col("home_team"))
    a = a.groupBy("season", "GW", "element", "position").agg(
        F.round(F.sum(points), 3).alias("points"), F.min("team").alias("team"), F.array_sort(F.collect_set(opp)).alias("opponents"))
    return a.join(pl(s, d).select("element", F.when(F.col("element") % 4 == 0, 0.75).otherwise(1.0).alias("p_play"), F.col("selected_by_percent").alias("ownership")), "element")


CTES["pool"] = ("SELECT season, GW, element, sided.position, round(sum(predicted_points), 3) AS points, min(team) AS team, list_sort(list(DISTINCT CASE WHEN was_home THEN away_team ELSE home_team END)) AS opponents, CASE WHEN element % 4 = 0 THEN 0.75::DOUBLE ELSE 1::DOUBLE END AS p_play FROM sided GROUP BY season, GW, element, sided.position", ("sided",))
CTES["xi"] = (
    "SELECT * EXCLUDE (r, must, f, n, m) FROM (SELECT *, count(*) OVER (PARTITION BY season, GW) AS n, sum(CAST(must AS INT)) OVER (PARTITION BY season, GW) AS m FROM ("
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, GW, must ORDER BY points DESC, list_position(['GK', 'DEF', 'MID', 'FWD'], position), element) AS f FROM ("
    "SELECT *, r <= CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 3 WHEN 'MID' THEN 2 ELSE 1 END AS must FROM ("
    "SELECT *, row_number() OVER (PARTITION BY season, GW, position ORDER BY points DESC, element) AS r FROM pool) WHERE r <= CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 5 WHEN 'MID' THEN 5 ELSE 3 END)) WHERE must OR f <= 4)) WHERE n = 11 AND m = 7", ("pool",))
add("L22_best_eleven", lambda s, d: L.best_eleven(pool(s, d)).select("season", "GW", "element", "position", "points", "team"), ctes("xi") + "SELECT season, GW, element, position, points, team FROM xi")
CTES["cv"] = (
    "SELECT season, GW, captain, vice, extra FROM (SELECT c.season, c.GW, c.element AS captain, v.element AS vice, round(c.points + (1 - c.p_play) * v.points, 9) AS extra, row_number() OVER (PARTITION BY c.season, c.GW ORDER BY round(c.points + (1 - c.p_play) * v.points, 9) DESC, CAST(c.p_play < 1 AND (c.team = v.team OR list_contains(c.opponents, v.team) OR list_contains(v.opponents, c.team)) AS INT), c.points DESC, c.element, v.points DESC, v.element) AS rn "
    "FROM xi c JOIN xi v ON c.season = v.season AND c.GW = v.GW AND c.element <> v.element) WHERE rn = 1", ("xi",))
add("L23_captain_pairs", lambda s, d: L.captain_pairs(L.best_eleven(pool(s, d))), ctes("cv") + "SELECT season, GW, captain, vice, extra AS expected_extra_points FROM cv")


def squads(s, d):
    return L.squad_from_predictions(pool(s, d))


def shadow_squads(s, d):
    """The second model predicts the bonus score instead."""
    return L.squad_from_predictions(pool(s, d, "bps"))


GW = ["season", "GW"]


def _scored(s, d, which=squads):
    return L.score_squads(which(s, d), act(s, d), GW)


add("L24_score_squads", lambda s, d: _scored(s, d))


def _l25(s, d):
    live, shadow, actual = written(squads(s, d), "live"), written(shadow_squads(s, d), "shadow"), written(act(s, d), "actual")
    return L.compare_squads(live, shadow, L.score_squads(live, actual, GW), L.score_squads(shadow, actual, GW), GW)


add("L25_compare_squads", _l25)


def _compared(s, d):
    """Two models' points per gameweek: sums over goals and over bonus."""
    a = app(s, d).groupBy("season", "GW").agg(F.sum("goals_scored").alias("g"), F.sum("bonus").alias("b"))
    return a.select("season", "GW", F.when(F.col("GW") == 12, "live").otherwise("finished").alias("status"), F.lit("a").alias("live_model"),
                    F.when(F.col("GW") == 4, "a").otherwise("b").alias("shadow_model"), F.when(F.col("GW") == 7, False).when(F.col("GW") != 8, True).alias("same_run"),
                    (F.col("g") - F.col("b")).alias("difference"))


CTES["cmp"] = ("SELECT season, GW, GW NOT IN (4, 7, 12) AS counted, CAST(sum(goals_scored) - sum(bonus) AS BIGINT) AS difference FROM app GROUP BY season, GW", ("app",))
add("L26_shadow_ledger", lambda s, d: L.shadow_ledger(_compared(s, d)).select("season", "GW", "difference", "counted", "running"),
    ctes("cmp") + "SELECT season, GW, difference, counted, CASE WHEN counted THEN CAST(sum(CASE WHEN counted THEN difference END) OVER (PARTITION BY season ORDER BY GW) AS BIGINT) END AS running FROM cmp")
add("L26_unpaired_gameweeks", lambda s, d: L.unpaired_gameweeks(app(s, d).filter("GW % 4 <> 0"), app(s, d).filter("GW >= 3 AND GW % 3 = 0")),
    ctes("app") + "SELECT DISTINCT season, GW FROM app WHERE GW >= 3 AND (GW % 4 <> 0) <> (GW % 3 = 0) AND season IN (SELECT season FROM app WHERE GW >= 3)")


def _entries(s, d):
    return squads(s, d).withColumns({
        "chip": F.when(F.col("GW") == 3, "3xc").when(F.col("GW") == 5, "bboost").otherwise(""), "hit_cost": F.when(F.col("GW") % 4 == 0, 4).otherwise(0)})


def _averages(s, d):
    return act(s, d).groupBy("season", "GW").agg(F.avg("points").alias("gw_average"))


add("L27_entry_totals", lambda s, d: L.entry_totals(L.score_squads(_entries(s, d), act(s, d), GW), _averages(s, d), ["season"]))


def _moves(s, d):
    """A customer is a manager: order lines of a month are the transfers of a gameweek."""
    li, o = roles.table(s, d, "lineitem"), roles.table(s, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("manager"), F.expr("(year(o_orderdate) - 1995) * 12 + month(o_orderdate)").cast("int").alias("GW"),
        F.col("l_partkey").alias("element"), F.expr("CAST(floor(l_extendedprice / 1000) AS INT)").alias("cost"),
        F.col("o_orderdate").cast("timestamp").alias("time"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("tie"))


CTES["mv"] = ("SELECT o_custkey AS manager, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS GW, l_partkey AS element, CAST(floor(l_extendedprice / 1000) AS INT) AS cost, CAST(o_orderdate AS TIMESTAMP) AS time, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey", ())


def _history(s, d):
    h = _moves(s, d).groupBy("manager", "GW").agg(F.count(F.lit(1)).cast("int").alias("made"))
    return h.withColumns({"cost": F.when(F.col("made") > 4, (F.col("made") - 3) * 4).otherwise(0), "chip": F.when(F.col("GW") % 10 == 0, "wildcard").when(F.col("GW") % 17 == 0, "freehit")})


# the fold as a recursive query: one step per gameweek and manager
_FOLD = {
    "h": "SELECT manager, GW, count(*) AS made, CASE WHEN count(*) > 4 THEN (count(*) - 3) * 4 ELSE 0 END AS cost, GW % 10 = 0 OR GW % 17 = 0 AS keeps FROM mv GROUP BY manager, GW",
    "e": "SELECT manager, min(GW) AS a, max(GW) AS b FROM h GROUP BY manager",
    "f": "SELECT manager, a AS g, b, 1::BIGINT AS ft FROM e UNION ALL SELECT f.manager, f.g + 1, f.b, greatest(1, least(5, 1 + CASE WHEN h.keeps THEN f.ft WHEN h.made IS NULL THEN f.ft WHEN h.cost // 4 > 0 THEN 0 ELSE greatest(f.ft, h.made) - h.made END)) FROM f LEFT JOIN h ON h.manager = f.manager AND h.GW = f.g + 1 WHERE f.g < f.b",
}
add("L28_free_transfers", lambda s, d: L.free_transfers(_history(s, d), ["manager"]),
    ctes("mv", extra=_FOLD).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT manager, CAST(ft AS INT) AS free_transfers FROM f WHERE g = b")


def _purchase(s, d):
    m = _moves(s, d)
    squad = m.select("manager", "element").distinct()
    first = m.groupBy("manager").agg(F.min("GW").alias("g0"))
    start = m.join(first, "manager").filter("GW = g0").groupBy("manager", "element").agg(F.min("cost").alias("price"))
    hits = m.filter("GW % 17 = 0 OR GW % 4 = 1").select("manager", "GW").distinct()
    return L.purchase_prices(squad, m.filter("GW % 3 <> 0"), start, pl(s, d), "manager", hits)


add("L29_purchase_prices", _purchase,
    ctes("mv", "pl", extra={
        "sq": "SELECT DISTINCT manager, element FROM mv",
        "st": "SELECT manager, element, min(cost) AS price FROM mv JOIN (SELECT manager, min(GW) AS g0 FROM mv GROUP BY manager) USING (manager) WHERE GW = g0 GROUP BY ALL",
        "lt": "SELECT manager, element, cost FROM (SELECT *, row_number() OVER (PARTITION BY manager, element ORDER BY time DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM mv WHERE GW % 3 <> 0 AND NOT (GW % 17 = 0 OR GW % 4 = 1)) WHERE rn = 1"})
    + "SELECT manager, element, coalesce(lt.cost, st.price, pl.now_cost, 0) AS price, CASE WHEN lt.cost IS NOT NULL THEN 'transfer' WHEN st.price IS NOT NULL THEN 'first squad' ELSE 'estimate' END AS source FROM sq LEFT JOIN lt USING (manager, element) LEFT JOIN st USING (manager, element) LEFT JOIN pl USING (element)")
add("L30_prices_at", lambda s, d: L.prices_at(app(s, d), 6), ctes("app") + "SELECT season, element, value AS price FROM (SELECT *, row_number() OVER (PARTITION BY season, element ORDER BY GW DESC, kickoff_time DESC, fixture DESC, line DESC) AS rn FROM app WHERE GW <= 6) WHERE rn = 1")
add("L31_projected_by_element", lambda s, d: L.projected_by_element(app(s, d), 1, 4),
    ctes("app") + "SELECT e.season, e.element, g.GW, coalesce(p, 0) AS points FROM (SELECT DISTINCT season, element FROM app) e JOIN (SELECT season, GW FROM (SELECT DISTINCT season, GW, dense_rank() OVER (PARTITION BY season ORDER BY GW) AS r FROM app) WHERE r <= 4 AND season IN (SELECT season FROM app GROUP BY season HAVING min(GW) = 1)) g ON g.season = e.season LEFT JOIN (SELECT season, element, GW, round(sum(predicted_points), 2) AS p FROM app GROUP BY ALL) p ON p.season = e.season AND p.element = e.element AND p.GW = g.GW")
_GREEDY = {
    "po": "SELECT pool.*, pl.selected_by_percent AS ownership FROM pool JOIN pl USING (element) WHERE selected_by_percent IS NOT NULL",
    "ls": "SELECT *, row_number() OVER (PARTITION BY season, GW ORDER BY list_position(['GK', 'DEF', 'MID', 'FWD'], position), ownership DESC, points DESC, element) AS i FROM (SELECT *, row_number() OVER (PARTITION BY season, GW, position, team ORDER BY ownership DESC, points DESC, element) AS c FROM po) WHERE c <= 3",
    "gr": "SELECT DISTINCT season, GW, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS els, CAST([] AS VARCHAR[]) AS clubs, CAST([] AS VARCHAR[]) AS poss FROM ls UNION ALL "
    "SELECT season, GW, i, CASE WHEN ok THEN list_append(els, element) ELSE els END, CASE WHEN ok THEN list_append(clubs, team) ELSE clubs END, CASE WHEN ok THEN list_append(poss, position) ELSE poss END FROM ("
    "SELECT gr.season, gr.GW, ls.i, els, clubs, poss, element, team, position, len(list_filter(clubs, lambda c: c = team)) < 3 AND len(list_filter(poss, lambda p: p = position)) < CASE position WHEN 'GK' THEN 2 WHEN 'FWD' THEN 3 ELSE 5 END AS ok FROM gr JOIN ls ON ls.season = gr.season AND ls.GW = gr.GW AND ls.i = gr.i + 1)",
    "fi": "SELECT season, GW, unnest(els) AS element FROM (SELECT *, row_number() OVER (PARTITION BY season, GW ORDER BY i DESC) AS k FROM gr) WHERE k = 1 AND len(els) = 15",
}
add("L32_template_squad", lambda s, d: L.template_squad(pool(s, d), GW),
    ctes("pool", "pl", extra=_GREEDY).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT season, GW, position, element, team, ownership FROM ls JOIN fi USING (season, GW, element)")
_RUN = "SELECT season, team, count(*) AS {n} FROM (SELECT *, max(CASE WHEN NOT ({t}) THEN kickoff_time END) OVER (PARTITION BY season, team) AS bk, max(CASE WHEN NOT ({t}) THEN rn END) OVER (PARTITION BY season, team) AS bad FROM r) WHERE bad IS NULL OR rn > bad GROUP BY season, team"
