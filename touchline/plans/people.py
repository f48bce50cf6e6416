"""Queries for player pages (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.numbers import settle
from touchline.operators import derived as D
from touchline.operators import league as L
from touchline.operators import players as P
from touchline.plans import roles
from touchline.plans.registry import add
from touchline.plans.roles import CTES, CURRENT, ctes
from touchline.plans.season import GW, _RUN, pa  # noqa: F401

app, fx, pl, sided = roles.appearances, roles.fixtures, roles.players, roles.sided_appearances

_GP = "CASE position WHEN 'GK' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END"
_CP = "CASE position WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END"
_DC = "CASE position WHEN 'DEF' THEN 10 WHEN 'MID' THEN 12 WHEN 'FWD' THEN 12 END"
_PARTS = {
    "appearance": "CASE WHEN minutes >= 60 THEN 2 ELSE 1 END", "goals": f"goals_scored * {_GP}", "assists": "assists * 3",
    "clean_sheets": f"CASE WHEN minutes >= 60 THEN clean_sheets * {_CP} ELSE 0 END", "saves": "CASE WHEN position = 'GK' THEN saves // 3 ELSE 0 END",
    "defensive": f"CASE WHEN defensive_contribution >= {_DC} THEN 2 ELSE 0 END", "bonus": "bonus",
    "conceded": "CASE WHEN position IN ('GK', 'DEF') THEN -(goals_conceded // 2) ELSE 0 END", "cards": "-yellow_cards - red_cards * 3",
}
CTES["bd"] = ("SELECT *, total_points - (" + " + ".join(f"p_{k}" for k in _PARTS) + ") AS p_other FROM (SELECT *, "
              + ", ".join(f"CASE WHEN minutes > 0 THEN CAST({v} AS BIGINT) ELSE 0::BIGINT END AS p_{k}" for k, v in _PARTS.items()) + " FROM app)", ("app",))
_PC = [f"p_{k}" for k in (*P.PARTS, "other")]
add("P1_points_breakdown", lambda s, d: P.points_breakdown(app(s, d)).select("fixture", "element", "line", *_PC), ctes("bd") + "SELECT fixture, element, line, " + ", ".join(_PC) + " FROM bd")
_TOT = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("total_points", "minutes", "goals_scored", "assists", "bps", "saves"))
_RATE = ", ".join(f"CASE WHEN minutes >= 90 THEN round({c} / minutes * 90, 6) END AS {c}_per_90" for c in ("total_points", "goals_scored", "expected_goals", "assists", "bps"))
add("P2_profile_totals", lambda s, d: _six(P.profile_totals(app(s, d), ["element"])),
    ctes("app", extra={"t": f"SELECT element, {_TOT}, CAST(sum(starts) AS BIGINT) AS starts, round(sum(expected_goals), 6) AS expected_goals, round(sum(expected_assists), 6) AS expected_assists, round(sum(defensive_contribution), 6) AS defensive_contribution, count(*) FILTER (WHERE minutes > 0) AS appearances FROM app GROUP BY element"}) + f"SELECT *, {_RATE} FROM t")


def _six(df):
    return df.select(*[settle(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


add("P2_profile_timeline", lambda s, d: app(s, d).groupBy("season", "GW", "element").agg(*[F.sum(c).alias(c) for c in ("total_points", "minutes", "goals_scored", "assists")]),
    ctes("app") + "SELECT season, GW, element, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("total_points", "minutes", "goals_scored", "assists")) + " FROM app GROUP BY season, GW, element")
add("P3_match_view", lambda s, d: P.match_view(sided(s, d)).select("fixture", "line", "element", "opponent", "team_score", "opponent_score", "result"),
    ctes("sided") + "SELECT fixture, line, element, CASE WHEN was_home THEN away_team ELSE home_team END AS opponent, CASE WHEN was_home THEN team_h_score ELSE team_a_score END AS team_score, CASE WHEN was_home THEN team_a_score ELSE team_h_score END AS opponent_score, CASE WHEN team_h_score IS NULL THEN NULL WHEN team_h_score = team_a_score THEN 'D' WHEN (team_h_score > team_a_score) = was_home THEN 'W' ELSE 'L' END AS result FROM sided")
add("P4_price_trend", lambda s, d: P.price_trend(app(s, d)),
    ctes("app", extra={"g": "SELECT season, element, GW, arg_max(value, (kickoff_time, fixture, line)) AS v, arg_max(selected, (kickoff_time, fixture, line)) AS sel FROM app GROUP BY season, element, GW"})
    + "SELECT season, element, count(*) AS gameweeks, arg_min(v, GW) / 10 AS first_price, arg_max(v, GW) / 10 AS last_price, round((arg_max(v, GW) - arg_min(v, GW)) / 10, 1) AS price_change, arg_max(sel, GW) - arg_min(sel, GW) AS selected_change FROM g GROUP BY season, element HAVING count(*) >= 2")
add("P5_underlying", lambda s, d: P.underlying(app(s, d)),
    ctes("app", extra={"t": "SELECT season, element, CAST(sum(minutes) AS BIGINT) AS minutes, sum(coalesce(expected_goals, 0)) AS xg, sum(coalesce(expected_assists, 0)) AS xa, sum(coalesce(expected_goals, 0) + coalesce(expected_assists, 0)) AS xgi, CAST(sum(goals_scored) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, coalesce(sum(expected_goals_conceded) FILTER (WHERE minutes > 0), 0) AS xgc, CAST(coalesce(sum(goals_conceded) FILTER (WHERE minutes > 0), 0) AS BIGINT) AS goals_conceded FROM app GROUP BY season, element HAVING count(coalesce(expected_goals, expected_assists)) > 0"})
    + "SELECT season, element, minutes, round(xg, 2) AS xg, round(xa, 2) AS xa, round(xgi, 2) AS xgi, round(xgc, 2) AS xgc, goals, assists, goals_conceded, " + ", ".join(f"CASE WHEN minutes >= 90 THEN round({c} * 90 / minutes, 2) END AS {c}_per_90" for c in ("xg", "xa", "xgi")) + " FROM t")
CTES["pos"] = ("SELECT *, row_number() OVER (PARTITION BY element ORDER BY kickoff_time, fixture, line) AS rn FROM app WHERE minutes > 0", ("app",))


def _streak_sql(test):
    return f"SELECT element, count(*) FILTER (WHERE bad IS NULL OR rn > bad) AS run FROM (SELECT *, max(CASE WHEN NOT ({test}) THEN rn END) OVER (PARTITION BY element) AS bad FROM pos) GROUP BY element"


def _run(s, d, test):
    from touchline.functions.ordered import trailing_run

    return trailing_run(app(s, d).filter("minutes > 0"), ["element"], ["kickoff_time", "fixture", "line"], F.expr(test), "run")


add("P6_trailing_run", lambda s, d: _run(s, d, "total_points > 2"), ctes("pos") + _streak_sql("total_points > 2"))
add("P7_competition_ranks", lambda s, d: P.competition_ranks(D.gameweek_actuals(app(s, d)), ["season", "GW"], "points"),
    ctes("act") + "SELECT *, rank() OVER (PARTITION BY season, GW ORDER BY points DESC) AS place FROM act")
add("P8_position_rank", lambda s, d: P.position_rank(D.season_stats(app(s, d))),
    ctes("ss", extra={"r": "SELECT season, position, name, total_points, rank() OVER w AS place, count(*) OVER (PARTITION BY season, position) AS pool, row_number() OVER (PARTITION BY season, position ORDER BY total_points DESC, name) AS rn FROM ss WINDOW w AS (PARTITION BY season, position ORDER BY total_points DESC)"})
    + "SELECT season, position, name, total_points, place, pool, CASE WHEN rn = 1 THEN (SELECT b.name FROM r b WHERE b.season = r.season AND b.position = r.position AND b.rn = 2) ELSE (SELECT b.name FROM r b WHERE b.season = r.season AND b.position = r.position AND b.rn = 1) END AS rival FROM r")
add("P9_head_to_head_records", lambda s, d: P.head_to_head_records(fx(s, d)),
    ctes("tr", extra={"r": "SELECT *, row_number() OVER (PARTITION BY team, opponent ORDER BY kickoff_time, id) AS rn FROM tr WHERE result IS NOT NULL",
                      "q": "SELECT *, max(CASE WHEN result = 'L' THEN rn END) OVER w AS b1, max(CASE WHEN result = 'W' THEN rn END) OVER w AS b2, row_number() OVER (PARTITION BY team, opponent ORDER BY result = 'W' DESC, goals_for - goals_against DESC, kickoff_time DESC, id DESC) AS wn FROM r WINDOW w AS (PARTITION BY team, opponent)"})
    + "SELECT team, opponent, count(*) AS played, count(*) FILTER (WHERE result = 'W') AS won, count(*) FILTER (WHERE result = 'D') AS drawn, count(*) FILTER (WHERE result = 'L') AS lost, CAST(sum(goals_for) AS BIGINT) AS goals_for, CAST(sum(goals_against) AS BIGINT) AS goals_against, count(*) FILTER (WHERE b1 IS NULL OR rn > b1) AS unbeaten, count(*) FILTER (WHERE b2 IS NULL OR rn > b2) AS winless, max(CASE WHEN wn = 1 AND result = 'W' THEN goals_for - goals_against END) AS biggest_margin, max(CASE WHEN wn = 1 AND result = 'W' THEN id END) AS biggest_win_id FROM q GROUP BY team, opponent")


def _pp(s, d):
    return pa(s, d).join(pl(s, d).select("element", "position"), "element")


CTES["pp"] = ("SELECT pa.*, pl.position FROM pa JOIN pl USING (element)", ("pa", "pl"))
_PR = "SELECT season, GW, element, position, predicted, rank() OVER (PARTITION BY season, GW ORDER BY predicted DESC) AS place, count(*) OVER (PARTITION BY season, GW) AS pool, rank() OVER (PARTITION BY season, GW, position ORDER BY predicted DESC) AS position_place, count(*) OVER (PARTITION BY season, GW, position) AS position_pool FROM pp"
add("P10_prediction_ranks", lambda s, d: P.prediction_ranks(_pp(s, d)), ctes("pp") + _PR)
_LAST = f"season = '{CURRENT}'"


def _weeks(s, d):
    return L.projected_by_element(app(s, d), 1, 4)


def insight(s, d):
    now = app(s, d).filter(_LAST)
    four = L.projected_by_element(now, 1, 4).groupBy("element").agg(F.round(F.sum("points"), 2).alias("points"))
    return P.insight_table(now, pl(s, d), four)


_COP = "CASE WHEN status IN ('u', 'n') THEN 0 WHEN chance_next IS NOT NULL THEN chance_next / 100 WHEN status IN ('i', 's') THEN 0 ELSE 1 END"
CTES["ins"] = (
    f"SELECT p.element, name, web_name, team, position, p.predicted_points, fixtures, CAST({_COP} AS DOUBLE) AS chance_of_playing, status, news, selected_by_percent, CASE WHEN selected_by_percent < 10 THEN 'differential' WHEN selected_by_percent >= 25 THEN 'template' ELSE 'safe' END AS ownership, now_cost / 10 AS price, f.points_4gw, round(p.predicted_points / (now_cost / 10), 2) AS points_per_m, round(f.points_4gw / (now_cost / 10), 2) AS points_per_m_4gw "
    f"FROM (SELECT element, round(sum(predicted_points), 2) AS predicted_points, count(*) AS fixtures FROM app WHERE {_LAST} GROUP BY element) p LEFT JOIN pl USING (element) "
    f"LEFT JOIN (SELECT element, round(sum(x), 2) AS points_4gw FROM (SELECT element, CASE WHEN GW <= 4 THEN round(sum(predicted_points), 2) ELSE 0 END AS x FROM app WHERE {_LAST} GROUP BY element, GW) GROUP BY element) f USING (element)", ("app", "pl"))
add("P11_insight_table", insight, ctes("ins") + "SELECT * FROM ins")
_CO = {
    "k": "SELECT *, row_number() OVER (ORDER BY predicted_points DESC, name) AS place FROM ins WHERE predicted_points > 0",
    "t": "SELECT * FROM k WHERE place <= 12",
    "c": "SELECT c.element AS captain, v.element AS vice, round(c.predicted_points + (1 - c.chance_of_playing) * v.predicted_points, 9) AS extra FROM t c JOIN t v ON c.element <> v.element ORDER BY extra DESC, CAST(c.chance_of_playing < 1 AND c.team = v.team AS INT), c.predicted_points DESC, c.element, v.predicted_points DESC, v.element LIMIT 1",
}
add("P12_captain_options", lambda s, d: P.captain_options(insight(s, d)),
    ctes("ins", extra=_CO) + "SELECT CAST(place AS INT) AS place, element, name, predicted_points, CASE WHEN element = captain THEN 'captain' WHEN element = vice THEN 'vice' END AS role, round(extra, 2) AS expected_extra_points FROM t, c WHERE place <= 10 OR element IN (captain, vice)")
add("P13_differentials", lambda s, d: P.differentials(insight(s, d)).select("element", "name", "predicted_points", "selected_by_percent"),
    ctes("ins") + "SELECT element, name, predicted_points, selected_by_percent FROM ins WHERE selected_by_percent < 10 AND predicted_points > 0 ORDER BY predicted_points DESC, name LIMIT 20")
add("P14_budget_picks", lambda s, d: P.budget_picks(insight(s, d)).select("position", "element", "name", "price", "predicted_points", "rank_no"),
    ctes("ins") + "SELECT position, element, name, price, predicted_points, CAST(rn AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY predicted_points DESC, name) AS rn FROM ins WHERE price <= CASE position WHEN 'GK' THEN 4.5 WHEN 'DEF' THEN 4.5 WHEN 'MID' THEN 5.5 ELSE 6.0 END + 1e-9 AND predicted_points > 0) WHERE rn <= 5")


def _moved(kind, col, where, order):
    return f"SELECT '{kind}' AS kind, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place, name, CAST({col} AS DOUBLE) AS amount FROM pl WHERE {where} ORDER BY place LIMIT 15"


add("P15_transfer_summary", lambda s, d: P.transfer_summary(pl(s, d)),
    ctes("pl") + " UNION ALL ".join("(" + _moved(*a) + ")" for a in (
        ("in", "transfers_in_event", "transfers_in_event <> 0", "transfers_in_event DESC, name"), ("out", "transfers_out_event", "transfers_out_event <> 0", "transfers_out_event DESC, name"),
        ("riser", "cost_change_event / 10", "cost_change_event > 0", "abs(cost_change_event) DESC, selected_by_percent DESC, name"), ("faller", "cost_change_event / 10", "cost_change_event < 0", "abs(cost_change_event) DESC, selected_by_percent DESC, name"))))
add("P16_set_piece_takers", lambda s, d: P.set_piece_takers(pl(s, d)),
    ctes("pl") + "SELECT team, kind, string_agg(CAST(choice AS STRING) || ' ' || name, ', ' ORDER BY choice, name) AS takers FROM (" + " UNION ALL ".join(f"SELECT team, name, '{k}' AS kind, {k} AS choice FROM pl" for k in ("penalties_order", "freekicks_order", "corners_order")) + ") WHERE choice > 0 GROUP BY team, kind")
add("P17_top_by_fixture", lambda s, d: P.top_by_fixture(sided(s, d)).select("fixture", "home_team", "away_team", "name", "line", "predicted_points", "rank_no"),
    ctes("sided") + "SELECT fixture, home_team, away_team, name, line, predicted_points, CAST(rn AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY predicted_points DESC, name, line) AS rn FROM sided WHERE predicted_points > 0) WHERE rn <= 3")
CTES["wk"] = ("SELECT e.season, e.element, g.GW, coalesce(p, 0) AS points FROM (SELECT DISTINCT season, element FROM app) e JOIN (SELECT season, GW FROM (SELECT DISTINCT season, GW, dense_rank() OVER (PARTITION BY season ORDER BY GW) AS r FROM app) WHERE r <= 4 AND season IN (SELECT season FROM app GROUP BY season HAVING min(GW) = 1)) g ON g.season = e.season LEFT JOIN (SELECT season, element, GW, round(sum(predicted_points), 2) AS p FROM app GROUP BY ALL) p ON p.season = e.season AND p.element = e.element AND p.GW = g.GW", ("app",))
add("P18_player_runs", lambda s, d: P.player_runs(_weeks(s, d), pl(s, d).select("element", "name")),
    ctes("wk", "pl", extra={"t": "SELECT season, element, round(sum(points), 2) AS total, string_agg(CAST(points AS STRING), ' ' ORDER BY GW) AS weeks FROM wk GROUP BY season, element"})
    + "SELECT season, element, name, total, CAST(rn AS INT) AS rank_no, weeks FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY total DESC, element) AS rn FROM t) JOIN pl USING (element) WHERE rn <= 20")
add("P19_promoted_teams", lambda s, d: P.promoted_teams(app(s, d).filter("GW = 1 AND day(kickoff_time) <= 2")),
    ctes("app", extra={"t": "SELECT DISTINCT CAST(substr(season, 1, 4) AS INT) AS y, season, team FROM app WHERE GW = 1 AND day(kickoff_time) <= 2"}) + "SELECT season, team FROM t WHERE y > (SELECT min(y) FROM t) AND (y - 1, team) NOT IN (SELECT (y, team) FROM t)")
add("P20_ownership_ranking", lambda s, d: P.ownership_ranking(pl(s, d)), ctes("pl") + "SELECT element, name, position, selected_by_percent, row_number() OVER (PARTITION BY position ORDER BY selected_by_percent DESC, element) AS place FROM pl")
add("P21_most_common_value", lambda s, d: P.most_common_value(pl(s, d), "team"), ctes("pl") + "SELECT team, count(*) AS n FROM pl GROUP BY team ORDER BY n DESC, team LIMIT 1")
_TESTS = {"goal_run": "goals_scored > 0", "return_run": "goals_scored + assists > 0", "clean_run": "clean_sheets > 0", "blank_run": "total_points <= 2"}
add("P22_player_highlights", lambda s, d: P.player_highlights(app(s, d)),
    ctes("app", "pos", extra={k: _streak_sql(t).replace("AS run", f"AS {k}") for k, t in _TESTS.items()} | {
        "b": "SELECT element, total_points AS best_points, fixture AS best_fixture FROM (SELECT *, row_number() OVER (PARTITION BY element ORDER BY total_points DESC, kickoff_time DESC, fixture DESC, line DESC) AS k FROM app) WHERE k = 1",
        "se": "SELECT element, season AS best_season FROM (SELECT element, season, row_number() OVER (PARTITION BY element ORDER BY sum(total_points) DESC, season) AS k FROM app GROUP BY element, season) WHERE k = 1",
        "l5": "SELECT element, avg(total_points) AS last5 FROM (SELECT *, row_number() OVER (PARTITION BY element ORDER BY kickoff_time DESC, fixture DESC, line DESC) AS k FROM pos) WHERE k <= 5 GROUP BY element",
        "z": "SELECT element, count(*) FILTER (WHERE total_points >= 10) AS big_scores, count(*) FILTER (WHERE minutes > 0) AS appearances, sum(total_points) AS pts FROM app GROUP BY element"})
    + "SELECT z.element, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in _TESTS) + ", best_points, best_fixture, best_season, big_scores, appearances, round(last5, 6) AS last5, CASE WHEN appearances > 0 THEN round(pts / appearances, 6) END AS per_game FROM z LEFT JOIN b USING (element) LEFT JOIN se USING (element) LEFT JOIN l5 USING (element) " + " ".join(f"LEFT JOIN {k} USING (element)" for k in _TESTS))
add("P23_metric_leaders", lambda s, d: P.metric_leaders(D.season_stats(app(s, d)), [r["name"] for r in pl(s, d).filter("element IN (7, 9)").select("name").take(2)], ["total_points", "goals", "assists", "bonus", "games"]),
    ctes("ss", "pl", extra={"v": " UNION ALL ".join(f"SELECT ss.name, '{m}' AS metric, CAST(sum({m}) AS DOUBLE) AS v FROM ss JOIN pl USING (name) WHERE element IN (7, 9) GROUP BY ss.name" for m in ("total_points", "goals", "assists", "bonus", "games"))})
    + "SELECT metric, CASE WHEN max(v) <> min(v) THEN arg_max(name, v) END AS leader, max(v) - min(v) AS lead FROM v GROUP BY metric")
_T4 = {"won": "result = 'W'", "unbeaten": "result <> 'L'", "lost": "result = 'L'", "winless": "result <> 'W'"}
add("P23_team_highlights", lambda s, d: P.team_highlights(fx(s, d)),
    ctes("tr", extra={"r": "SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY kickoff_time, id) AS rn FROM tr WHERE result IS NOT NULL"}
         | {f"r_{k}": _RUN.format(n=k, t=t) for k, t in _T4.items()}
         | {"t": "SELECT season, team, count(result) AS played, coalesce(sum(goals_for), 0) AS gf, coalesce(sum(goals_against), 0) AS ga, count(*) FILTER (WHERE goals_against = 0) AS clean_sheets FROM tr GROUP BY season, team",
            "n": "SELECT season, team, avg(difficulty) AS dd, count(*) AS nn FROM (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY kickoff_time, id) AS k FROM tr WHERE status = 'scheduled') WHERE k <= 3 GROUP BY season, team"})
    + "SELECT season, team, clean_sheets, played > 0 AND gf = max(CASE WHEN played > 0 THEN gf END) OVER (PARTITION BY season) AS best_attack, played > 0 AND ga = min(CASE WHEN played > 0 THEN ga END) OVER (PARTITION BY season) AS best_defence, CASE WHEN nn = 3 THEN round(dd, 6) END AS next3_difficulty, "
    + ", ".join(f"coalesce({k}, 0) AS {k}" for k in _T4) + " FROM t LEFT JOIN n USING (season, team) " + " ".join(f"LEFT JOIN r_{k} USING (season, team)" for k in _T4))
add("P24_outlook", lambda s, d: P.outlook(_pp(s, d), _weeks(s, d), pl(s, d), D.season_stats(app(s, d))),
    ctes("pp", "wk", "ss", extra={"r": _PR, "j": "SELECT season, element, round(sum(points), 2) AS projected FROM wk GROUP BY season, element"})
    + "SELECT r.*, pl.name, pl.status, pl.news, pl.now_cost / 10 AS price, j.projected, ss.total_points AS season_points, ss.games AS season_games FROM r LEFT JOIN pl USING (element) LEFT JOIN j ON j.season = r.season AND j.element = r.element LEFT JOIN ss ON ss.season = r.season AND ss.name = pl.name")
