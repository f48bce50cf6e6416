"""Queries for sources (S) and table maintenance (K)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.functions.numbers import settle
from touchline.operators import league as L
from touchline.operators import temporal as X
from touchline.plans import roles
from touchline.plans.features import CTES, _p, cap, match_events, odds, raw_odds, shifted_kickoffs, six
from touchline.plans.registry import add
from touchline.plans.roles import CURRENT, ctes
from touchline.session import shared_folder
from touchline.sources import readers as S
from touchline.sources import tables as K

app, fx, pl, sided = roles.appearances, roles.fixtures, roles.players, roles.sided_appearances
ROW = ["element", "fixture", "line"]


# ---------------------------------------------------------------- sources
def _raw_history(s, d):
    """An older file's layout: other column names and position codes, texts for times."""
    a = app(s, d)
    pos = F.when(F.col("position") == "GK", "GKP").when(F.col("element") % 97 == 0, "AM").otherwise(F.col("position"))
    return a.select(F.col("season").alias("season_x"), F.col("team").alias("team_x"), "name", pos.alias("position"), F.date_format("kickoff_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("kickoff_time"), "fixture", "GW", "total_points", "minutes", "value", "element", F.when(F.col("element") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("threat")).alias("threat"))


add("S1_normalize_history", lambda s, d: S.normalize_history(_raw_history(s, d)).groupBy("season", "position").agg(F.count("*").alias("n"), F.sum("total_points").alias("points"), F.count("threat").alias("threats"), F.count("xP").alias("xp"), F.min(F.unix_seconds("kickoff_time")).alias("first")),
    ctes("app") + "SELECT season, position, count(*) AS n, CAST(sum(total_points) AS BIGINT) AS points, count(*) FILTER (WHERE element % 3 <> 0) AS threats, 0::BIGINT AS xp, CAST(min(epoch(kickoff_time)) AS BIGINT) AS first FROM app WHERE position = 'GK' OR element % 97 <> 0 GROUP BY season, position")


def _sided_raw(s, d):
    return sided(s, d).withColumn("opponent", F.when(F.col("was_home"), F.col("away_team")).otherwise(F.col("home_team"))).drop("home_team", "away_team").withColumn("position", F.when(F.col("element") % 97 == 0, "AM").otherwise(F.col("position")))


add("S2_sides_and_form", lambda s, d: S.with_sides_and_form(_sided_raw(s, d)).select(*ROW, "home_team", "away_team", "form"),
    ctes("sided") + "SELECT element, fixture, line, home_team, away_team, round_even(avg(total_points) OVER (PARTITION BY name, season ORDER BY kickoff_time, fixture, line ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 1) AS form FROM sided WHERE element % 97 <> 0")


def _merge(s, d):
    a = sided(s, d).select("season", "fixture", "line", "element", "team", "total_points", F.lit(1).alias("mng_win"))
    master = a.filter("season <= '1998-99'").drop("mng_win").withColumn("opponent", F.lit("old"))
    return S.merge_new_seasons(master, a.filter("season >= '1998-99'"), ["xP"])


add("S3_merge_new_seasons", lambda s, d: _merge(s, d).select("season", *ROW, "team", "opponent", "xP"),
    ctes("sided") + "SELECT season, element, fixture, line, team, CASE WHEN season <= '1998-99' THEN 'old' ELSE (SELECT min(b.team) FROM sided b WHERE b.season = a.season AND b.fixture = a.fixture AND b.team <> a.team) END AS opponent, CAST(NULL AS STRING) AS \"xP\" FROM sided a")
add("S4_season_file_frame", lambda s, d: S.season_file_frame(app(s, d).select(*ROW, "team", "total_points"), CURRENT), ctes("app") + f"SELECT element, fixture, line, team AS team_x, total_points, '{CURRENT}' AS season FROM app")
add("S5_player_codes", lambda s, d: S.player_codes(app(s, d).filter("element % 2 = 0").select("season", "element", (F.col("element") % 700).alias("code")).distinct(), pl(s, d), CURRENT),
    ctes("app", "pl") + f"SELECT DISTINCT season, element, element % 700 AS code FROM app WHERE element % 2 = 0 UNION SELECT '{CURRENT}', element, code FROM pl WHERE ('{CURRENT}', element) NOT IN (SELECT (season, element) FROM app WHERE element % 2 = 0)")


def _captures(s, d):
    c = cap(s, d)
    pub = S.capture_rows(c.filter("kind = 'view'").withColumn("news", F.lit("x")), F.col("season"), "captured_at", "hist")
    arch = c.filter("kind = 'click'").withColumn("news", F.when(F.col("value") < 20, "Knock").otherwise(" "))
    now = c.filter("kind = 'error'").withColumnRenamed("captured_at", "fetched_at").withColumn("news", F.lit(None).cast("string"))
    return S.all_captures(pub, arch, now, "2023-24")


add("S6_all_captures", lambda s, d: _captures(s, d).select("season", "sha", "element", "status", "chance", "news_flag"),
    ctes("cap") + "SELECT season, CASE kind WHEN 'view' THEN 'hist-' WHEN 'click' THEN 'live-' ELSE 'status-' END || strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') AS sha, element, status, chance, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN CASE WHEN value < 20 THEN 1 ELSE 0 END ELSE 0 END AS news_flag FROM cap WHERE kind IN ('view', 'click', 'error')")
add("S7_parse_odds", lambda s, d: six(odds(s, d).select("season", "home", "away", "p_home", "p_draw", "p_away", "p_over")), ctes("od") + "SELECT season, home, away, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away, round(p_over, 6) AS p_over FROM od")
_SO = "CAST(year(kickoff_time) - CASE WHEN month(kickoff_time) < 7 THEN 1 ELSE 0 END AS INT)"
_SL = f"CAST({_SO} AS STRING) || '-' || lpad(CAST(({_SO} + 1) % 100 AS STRING), 2, '0')"
_UP = {"up": f"SELECT sl AS season, home_team AS home, away_team AS away, id FROM (SELECT *, {_SL} AS sl, row_number() OVER (PARTITION BY {_SL}, home_team, away_team ORDER BY id DESC) AS k FROM fx WHERE id % 4 <> 0) WHERE k = 1"}


def _upcoming(s, d):
    raw = raw_odds(s, d).withColumn("Div", F.when(F.col("id") % 4 == 0, "E1").otherwise("E0"))
    return S.parse_upcoming_odds(raw, "E0")


add("S8_upcoming_odds", lambda s, d: _upcoming(s, d).select("season", "home", "away", F.col("row_no").alias("id")), ctes("fx", extra=_UP) + "SELECT season, home, away, id FROM up")
add("S9_odds_union", lambda s, d: S.odds_union(odds(s, d).filter("row_no % 2 = 0"), _upcoming(s, d)).select("season", "home", "away", F.col("row_no").alias("id")),
    ctes("od", extra=_UP | {"a": "SELECT season, home, away, id FROM od WHERE id % 2 = 0"}) + "SELECT * FROM a UNION ALL SELECT * FROM up WHERE (season, home, away) NOT IN (SELECT (season, home, away) FROM a)")


def _oc(s, d):
    m = fx(s, d).select(F.col("id").alias("match_id"), F.col("home_team").alias("team"), "status")
    live = m.filter("match_id % 3 = 0").withColumn("status", F.lit("live"))
    return S.other_competitions(m.filter("match_id % 2 = 0"), live, ["match_id", "team"])


add("S10_other_competitions", _oc, ctes("fx") + "SELECT id AS match_id, home_team AS team, CASE WHEN id % 3 = 0 THEN 'live' ELSE status END AS status FROM fx WHERE id % 3 = 0 OR id % 2 = 0")


def _stat_raw(s, d):
    p = roles.table(s, d, "part")
    pos = F.when(F.col("p_size") % 3 == 0, " DF, MF").when(F.col("p_size") % 3 == 1, "GK").otherwise(F.lit(None).cast("string"))
    return p.select(F.when(F.col("p_partkey") % 25 == 0, "Rk").otherwise(F.col("p_partkey").cast("string")).alias("Rk"), F.when(F.col("p_partkey") % 26 == 0, "Player").otherwise(F.concat(F.lit("Ü "), F.col("p_name"))).alias("Player"), pos.alias("Pos"), F.col("p_brand").alias("Squad"))


add("S11_clean_stat_table", lambda s, d: S.clean_stat_table(_stat_raw(s, d), "2021-22", "standard"),
    "SELECT CAST(p_partkey AS STRING) AS Rk, 'Ü ' || p_name AS Player, CASE p_size % 3 WHEN 0 THEN 'DF,MF' WHEN 1 THEN 'GK' END AS Pos, p_brand AS Squad, CASE p_size % 3 WHEN 0 THEN 'DF' WHEN 1 THEN 'GK' END AS Pos_Primary, p_size % 3 = 0 AS Is_Multi_Pos, 'u ' || p_name AS Player_Key, '2021-22' AS Season, 'standard' AS Table_Type FROM part WHERE p_partkey % 25 <> 0 AND p_partkey % 26 <> 0")


def _paths(s, d):
    o = roles.table(s, d, "orders")
    y = 2000 + F.col("o_orderkey") % 20
    kind = F.element_at(F.array(F.lit("Standard"), F.lit("Goalkeeping"), F.lit("Shooting")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    span = F.concat_ws("-", y.cast("string"), (y + 1).cast("string"))
    return o.select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("/base/notes/"), span, F.lit(".txt"))).otherwise(F.concat(F.lit("/base/EFL-"), span, F.lit("/"), span, F.lit("_"), kind, F.lit("_Teams.txt"))).alias("path"))


add("S12_file_inventory", lambda s, d: S.file_inventory(_paths(s, d)).groupBy("season", "table_type", "unit").agg(F.count("*").alias("n")),
    "SELECT CAST(2000 + o_orderkey % 20 AS STRING) || '-' || CAST(2001 + o_orderkey % 20 AS STRING) AS season, ['standard', 'goalkeeping', 'shooting'][o_orderkey % 3 + 1] AS table_type, 'teams' AS unit, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL")


def _teams_raw(s, d):
    a = app(s, d).groupBy("season", F.col("team").alias("Squad")).agg(F.count_distinct("GW").alias("MP"), F.sum("goals_scored").alias("Gls"), F.sum("goals_conceded").alias("GA"), F.sum("clean_sheets").alias("W"), F.sum("bonus").alias("D"))
    return a.select("season", "Squad", "MP", "Gls"), a.select("season", "Squad", "GA", "W", "D")


add("S13_team_tables", lambda s, d: six(S.team_tables(*_teams_raw(s, d))),
    ctes("app", extra={"t": "SELECT CAST(substr(season, 1, 4) AS INT) + 1 AS y, team, count(DISTINCT GW) AS mp, sum(goals_scored) AS g, sum(goals_conceded) AS ga, sum(clean_sheets) AS w, sum(bonus) AS d FROM app GROUP BY season, team"})
    + "SELECT CAST(y AS STRING) || '-' || lpad(CAST((y + 1) % 100 AS STRING), 2, '0') AS season, team, round(g / mp, 6) AS efl_gf_pg, round(ga / mp, 6) AS efl_ga_pg, round((w * 3 + d) / mp, 6) AS efl_ppg FROM t")


def _mgr(s, d):
    return fx(s, d).select(F.col("home_team").alias("team"), F.when(F.col("id") % 3 != 0, F.to_date("kickoff_time")).alias("vacancy"), F.when(F.col("id") % 5 != 0, F.date_add(F.to_date("kickoff_time"), 9)).alias("appointed"))


add("S14_manager_events", lambda s, d: S.manager_events(_mgr(s, d)).withColumn("date", F.col("date").cast("string")), ctes("fx") + "SELECT home_team AS team, 'vacancy' AS event, strftime(kickoff_time, '%Y-%m-%d') AS date FROM fx WHERE id % 3 <> 0 UNION ALL SELECT home_team, 'appointed', strftime(kickoff_time + INTERVAL 9 DAY, '%Y-%m-%d') FROM fx WHERE id % 5 <> 0")


def _schedule(s, d):
    return fx(s, d).select(F.col("gameweek").alias("Matchday"), F.date_format("kickoff_time", "dd/MM/yyyy").alias("Date"), F.when(F.col("id") % 6 != 0, F.format_string("%02d:30", F.pmod("id", F.lit(24)))).alias("Time"), F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"))


_LT = "kickoff_time + CASE WHEN id % 6 <> 0 THEN to_hours(CAST(id % 24 AS INT)) + INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END"
add("S15_schedule_rows", lambda s, d: S.schedule_rows(_schedule(s, d), CURRENT).select("id", "season", "gameweek", F.unix_seconds("kickoff_time").alias("kickoff"), "home_team", "away_team", "status"),
    ctes("fx") + f"SELECT 'csv-{CURRENT}-' || CAST(gameweek AS STRING) || '-' || replace(home_team, ' ', '_') AS id, '{CURRENT}' AS season, gameweek, CAST(epoch(timezone('UTC', timezone('Europe/London', {_LT}))) AS BIGINT) AS kickoff, home_team, away_team, 'scheduled' AS status FROM fx")


def _summaries(s, d):
    """One nested JSON text per player and season: the matches as the feed sends them."""
    a = sided(s, d)
    h = F.struct("fixture", "line", F.col("GW").alias("round"), "was_home", "minutes", "total_points", "value")
    return a.groupBy("element", "season").agg(F.collect_list(h).alias("history")).select(F.to_json(F.struct("element", "history")).alias("json"))


def _xp(s, d):
    return pl(s, d).select("element", F.lit(3).alias("GW"), F.round("ep_next", 3).alias("xP"))


add("S16_season_rows", lambda s, d: S.season_rows(_summaries(s, d), fx(s, d), _xp(s, d)),
    ctes("sided", "pl") + "SELECT s.element, s.fixture, s.line, s.GW, s.team, s.was_home, s.minutes, s.total_points, s.value, CASE WHEN s.GW = 3 THEN round(pl.ep_next, 3) END AS \"xP\" FROM sided s LEFT JOIN pl USING (element) WHERE s.status = 'finished'")


def _elements(s, d):
    p = roles.table(s, d, "part")
    return p.select(F.to_json(F.struct(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).cast("int").alias("team"), (F.col("p_size") % 5 + 1).alias("element_type"), F.lit("a").alias("status"), F.when(F.col("p_size") % 2 == 0, 75.0).alias("chance"), F.when(F.col("p_size") % 3 == 0, "Knock").alias("news"), F.lit(50).alias("now_cost"))).alias("json"))


def _club_ids(s, d):
    return roles.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).filter("id <> 7")


add("S17_status_rows", lambda s, d: S.status_rows(_elements(s, d), _club_ids(s, d)),
    "SELECT p_partkey AS element, CASE WHEN p_partkey % 25 <> 7 THEN n_name END AS team, ['GK', 'DEF', 'MID', 'FWD'][p_size % 5 + 1] AS position, 'a' AS status, CASE WHEN p_size % 2 = 0 THEN 75::DOUBLE END AS chance, CASE WHEN p_size % 3 = 0 THEN 'Knock' ELSE '' END AS news, 50 AS now_cost FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_size % 5 <> 4")


def _event_json(s, d):
    g = app(s, d).groupBy("season", "GW").agg(F.sum("total_points").alias("p"))
    return g.select("season", F.to_json(F.struct(F.col("GW").alias("id"), (F.col("GW") < 9).alias("finished"), F.when(F.col("GW") < 9, F.col("p")).otherwise(0).alias("average_entry_score"), (F.col("p") % 2).alias("highest_score"))).alias("json"))


add("S18_event_summaries", lambda s, d: S.event_summaries(_event_json(s, d)), ctes("app", extra={"g": "SELECT season, GW, CAST(sum(total_points) AS BIGINT) AS p FROM app GROUP BY season, GW"}) + "SELECT season, GW AS id, GW < 9 AS finished, nullif(CASE WHEN GW < 9 THEN p ELSE 0 END, 0) AS average_entry_score, nullif(p % 2, 0) AS highest_score FROM g")


def _no(c):
    return F.regexp_extract(c, "([0-9]+)$", 1).cast("int")


def _fixture_json(s, d):
    f = fx(s, d)
    return f.select("season", F.to_json(F.struct("id", F.when(F.col("id") % 9 != 0, F.col("gameweek")).alias("event"), _no("home_team").alias("team_h"), _no("away_team").alias("team_a"), F.col("home_score").alias("team_h_score"), F.col("away_score").alias("team_a_score"), (F.col("status") == "finished").alias("finished"), (F.col("status") != "scheduled").alias("started"), F.col("kickoff_time").cast("string").alias("kickoff_time"))).alias("json"))


def _team_ids(s, d):
    return roles.table(s, d, "supplier").filter("s_suppkey % 10 <> 4").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"))


add("S19_fixture_rows", lambda s, d: S.fixture_rows(_fixture_json(s, d), _team_ids(s, d)),
    ctes("fx", extra={"h": "SELECT *, CAST(regexp_extract(home_team, '([0-9]+)$', 1) AS INT) AS h, CAST(regexp_extract(away_team, '([0-9]+)$', 1) AS INT) AS a FROM fx"})
    + "SELECT CAST(id AS STRING) || '-' || season AS id, season, CASE WHEN id % 9 <> 0 THEN gameweek END AS gameweek, CASE WHEN id % 9 <> 0 THEN season || '-GW' || CAST(gameweek AS STRING) END AS gw_id, status, CASE WHEN status = 'finished' THEN home_score END AS home_score, CASE WHEN status = 'finished' THEN away_score END AS away_score, x.s_name AS home_team, y.s_name AS away_team FROM h JOIN supplier x ON x.s_suppkey = h.h JOIN supplier y ON y.s_suppkey = h.a WHERE h.h % 10 <> 4 AND h.a % 10 <> 4")
add("S20_infer_team_names", lambda s, d: S.infer_team_names(fx(s, d).select("id", _no("home_team").alias("team_h"), _no("away_team").alias("team_a")), sided(s, d)), ctes("sided") + "SELECT DISTINCT CAST(regexp_extract(team, '([0-9]+)$', 1) AS INT) AS id, team AS name FROM sided")


def _event_feed(s, d):
    """Match events as JSON: goals, own goals listed either way, some without the club."""
    a = sided(s, d).filter("team_h_score IS NOT NULL AND total_points >= 6")
    mine = F.when(F.col("was_home"), "home").otherwise("away")
    other = F.when(F.col("was_home"), "away").otherwise("home")
    own = F.col("own_goals") > 0
    flip = F.col("fixture") % 2 == 0
    det = F.struct(
        F.when(own & ~flip, other).otherwise(mine).alias("side"), F.when(own, "own_goal").when(F.col("penalties_missed") > 0, "missed_penalty").otherwise("goal").alias("kind"),
        F.when(F.col("line") % 5 == 0, F.concat(F.lit("90'+"), (F.col("line") % 7).cast("string"), F.lit("'"))).otherwise(F.concat((F.col("line") % 90).cast("string"), F.lit("'"))).alias("clock"), F.col("name").alias("player"), F.lit(None).cast("string").alias("club"))
    forh = F.when(own, ~F.col("was_home")).otherwise(F.col("was_home"))
    goal = F.col("penalties_missed") == 0
    m = a.groupBy("fixture").agg(
        F.first("home_team").alias("home"), F.first("away_team").alias("away"), F.count_if(forh & (goal | own)).cast("int").alias("home_score"), F.count_if(~forh & (goal | own)).cast("int").alias("away_score"),
        F.array_sort(F.collect_list(F.struct("line", "element", det.alias("d")))).alias("l"))
    return m.select(F.col("fixture").alias("id"), F.to_json(F.struct("home", "away", "home_score", "away_score", F.transform("l", lambda x: x["d"]).alias("details")), {"ignoreNullFields": "false"}).alias("json"))


add("S21_goal_rows", lambda s, d: S.goal_rows(_event_feed(s, d)).select("id", "minute", "extra", "kind", "player", "team"),
    ctes("sided", extra={"g": "SELECT fixture AS id, CAST(CASE WHEN line % 5 = 0 THEN 90 ELSE line % 90 END AS INT) AS minute, CAST(CASE WHEN line % 5 = 0 THEN line % 7 END AS INT) AS extra, CASE WHEN own_goals > 0 THEN 'own_goal' WHEN penalties_missed > 0 THEN 'missed_penalty' ELSE 'goal' END AS kind, name AS player, team, fixture % 2 = 0 AS flip, CASE WHEN own_goals > 0 THEN home_team <> team ELSE home_team = team END AS forh, home_team, away_team FROM sided WHERE team_h_score IS NOT NULL AND total_points >= 6",
        "t": "SELECT id, count(*) FILTER (WHERE kind <> 'missed_penalty' AND (forh <> (kind = 'own_goal' AND flip))) AS h0, count(*) FILTER (WHERE kind <> 'missed_penalty' AND forh) AS hs FROM g GROUP BY id"})
    + "SELECT g.id, minute, extra, kind, player, CASE WHEN kind = 'own_goal' AND flip AND h0 = hs THEN CASE WHEN team = home_team THEN away_team ELSE home_team END ELSE team END AS team FROM g JOIN t USING (id)")


def _live_feed(s, d):
    """One JSON text per player and gameweek with the statistics of each match."""
    st = F.array(F.struct(F.lit("minutes").alias("identifier"), F.col("minutes").cast("long").alias("value"), F.lit(2).cast("long").alias("points")), F.struct(F.lit("goals_scored").alias("identifier"), F.col("goals_scored").cast("long").alias("value"), (F.col("goals_scored") * 4).cast("long").alias("points")))
    a = app(s, d).groupBy("season", "GW", "element", "fixture").agg(F.max("minutes").alias("minutes"), F.max("goals_scored").alias("goals_scored"), F.sum("total_points").alias("tp"))
    e = a.withColumn("x", F.struct("fixture", st.alias("stats"))).groupBy("season", "GW", "element").agg(F.collect_list("x").alias("explain"), F.sum("tp").alias("total_points"), F.sum("minutes").alias("minutes"))
    return e.select(F.concat_ws("-", "season", F.col("GW").cast("string")).alias("grp"), F.to_json(F.struct(F.col("element").alias("id"), F.struct("total_points", "minutes").alias("stats"), "explain")).alias("json"))


def _started(s, d):
    return roles.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("started"))


_LF = {"m": "SELECT season || '-' || CAST(GW AS STRING) AS grp, element, fixture, max(minutes) AS minutes, max(goals_scored) AS goals, CAST(sum(total_points) AS BIGINT) AS tp FROM app GROUP BY ALL", "st": "SELECT o_orderkey AS fixture FROM orders WHERE o_orderstatus <> 'P'"}
add("S22_live_players", lambda s, d: S.live_players(_live_feed(s, d), _started(s, d)), ctes("app", extra=_LF) + "SELECT grp, element, CAST(sum(tp) AS BIGINT) AS points, CAST(sum(minutes) AS BIGINT) AS minutes FROM m GROUP BY grp, element HAVING count(*) FILTER (WHERE fixture IN (SELECT fixture FROM st)) > 0")
add("S22_live_stat_rows", lambda s, d: S.live_stat_rows(_live_feed(s, d), _started(s, d), ["minutes", "goals_scored"]), ctes("app", extra=_LF) + "SELECT grp, fixture, element, CAST(2 + goals * 4 AS BIGINT) AS points, CAST(minutes AS BIGINT) AS minutes, CAST(goals AS BIGINT) AS goals_scored FROM m WHERE fixture IN (SELECT fixture FROM st)")
add("S23_replace_season", lambda s, d: S.replace_season(app(s, d).select("season", *ROW, "total_points", "bps"), app(s, d).filter(f"season = '{CURRENT}' AND GW < 4").select("season", *ROW, (F.col("total_points") + 1).alias("total_points")), CURRENT),
    ctes("app") + f"SELECT season, element, fixture, line, total_points, bps FROM app WHERE season <> '{CURRENT}' UNION ALL SELECT season, element, fixture, line, total_points + 1, NULL FROM app WHERE season = '{CURRENT}' AND GW < 4")
add("S24_local_to_utc", lambda s, d: _schedule(s, d).select("HomeTeam", "AwayTeam", "Date", F.unix_seconds(S.local_to_utc(F.col("Date"), F.col("Time"))).alias("utc"), S.season_of(F.to_date("Date", "dd/MM/yyyy")).alias("season")),
    ctes("fx") + f"SELECT home_team AS HomeTeam, away_team AS AwayTeam, strftime(kickoff_time, '%d/%m/%Y') AS Date, CAST(epoch(timezone('UTC', timezone('Europe/London', {_LT}))) AS BIGINT) AS utc, {_SL} AS season FROM fx")


def _games(s, d):
    return fx(s, d).select(F.col("id").alias("game_id"), "season", "kickoff_time", _no("home_team").alias("home_club"), _no("away_team").alias("away_club"), F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals"))


def _league_clubs(s, d):
    """Clubs of the league in a season: those whose number ends below seven."""
    return fx(s, d).select("season", _no("home_team").alias("club_id"), F.col("home_team").alias("team")).distinct().filter("club_id % 10 < 7")


_LC = {"cl": "SELECT DISTINCT season, CAST(regexp_extract(home_team, '([0-9]+)$', 1) AS INT) AS club_id, home_team AS team FROM fx WHERE CAST(regexp_extract(home_team, '([0-9]+)$', 1) AS INT) % 10 < 7",
       "gm": "SELECT *, CAST(regexp_extract(home_team, '([0-9]+)$', 1) AS INT) AS h, CAST(regexp_extract(away_team, '([0-9]+)$', 1) AS INT) AS a FROM fx"}
add("S25_club_match_rows", lambda s, d: S.club_match_rows(_games(s, d), _league_clubs(s, d)).drop("kickoff_time"),
    ctes("fx", extra=_LC) + "SELECT gm.id AS game_id, gm.season, h AS club_id, a AS opponent, true AS was_home, home_score AS goals_for, away_score AS goals_against, cl.team FROM gm JOIN cl ON cl.season = gm.season AND cl.club_id = h UNION ALL SELECT gm.id, gm.season, a, h, false, away_score, home_score, cl.team FROM gm JOIN cl ON cl.season = gm.season AND cl.club_id = a")


def _squads(s, d):
    a = app(s, d).groupBy(F.col("fixture").alias("game_id"), F.col("element").alias("player_id")).agg(F.min("team").alias("club_id"), F.min("name").alias("name"), F.max("minutes").alias("minutes"), F.sum("goals_scored").alias("goals"), F.sum("assists").alias("assists"))
    line = a.filter("player_id % 3 <> 0").select("game_id", "player_id", "club_id", "name", F.when(F.col("player_id") % 2 == 0, "starting_lineup").otherwise("substitutes").alias("type"))
    return S.squads_from_lineups(line, a.filter("player_id % 5 <> 0"))


add("S26_squads_from_lineups", _squads,
    ctes("app", extra={"a": "SELECT fixture AS game_id, element AS player_id, min(team) AS club_id, min(name) AS name, max(minutes) AS m, sum(goals_scored) AS g, sum(assists) AS s FROM app GROUP BY fixture, element"})
    + "SELECT game_id, player_id, club_id, name, CASE WHEN player_id % 5 <> 0 THEN m ELSE 0 END AS minutes, CASE WHEN player_id % 3 <> 0 THEN CAST(player_id % 2 = 0 AS INT) ELSE CAST(m >= 60 AS INT) END AS started, CASE WHEN player_id % 5 <> 0 THEN CAST(g AS BIGINT) ELSE 0 END AS goals, CASE WHEN player_id % 5 <> 0 THEN CAST(s AS BIGINT) ELSE 0 END AS assists FROM a WHERE player_id % 3 <> 0 OR player_id % 5 <> 0")

# ---------------------------------------------------------------- table maintenance
_LATE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY season DESC, GW DESC, kickoff_time DESC, fixture DESC, line DESC) AS lr FROM app) WHERE lr = 1"
add("K1_player_dimension", lambda s, d: K.player_dimension(app(s, d)), ctes("app", extra={"l": _LATE}) + "SELECT name, lower(name) AS name_normalized, position, team, element, season AS last_season, season = (SELECT max(season) FROM app) AS is_current FROM l")
add("K1_small_dimensions", lambda s, d: K.small_dimensions(sided(s, d)), ctes("sided") + "SELECT 'team' AS kind, home_team AS id FROM sided UNION SELECT 'team', away_team FROM sided UNION SELECT 'season', season FROM sided UNION SELECT 'gameweek', season || '-GW' || CAST(GW AS STRING) FROM sided")
add("K1_fixture_dimension", lambda s, d: K.fixture_dimension(sided(s, d)), ctes("sided") + "SELECT DISTINCT season, fixture, GW, home_team, away_team, team_h_score, team_a_score, CAST(fixture AS STRING) || '-' || season AS id FROM sided")


def _current(s, d):
    return K.player_dimension(app(s, d)).select("name", "position", "team")


def _updates(s, d):
    return K.player_updates(pl(s, d).filter("element % 3 <> 0").withColumn("position", F.when(F.col("element") % 7 == 0, "MID").otherwise(F.col("position"))), app(s, d).filter(F.col("season") == CURRENT))


_GONE = "(coalesce(status, '') = 'u' AND regexp_matches(lower(news), '\\b(has joined|joined|on loan|loan|has departed|departed|has left|left the club|released|returned to|has returned|transferred|permanently|contract terminated|mutual consent)\\b'))"
_KU = {"sx": f"SELECT name, element, CASE WHEN element % 7 = 0 THEN 'MID' ELSE position END AS position, team, NOT {_GONE} AS plays_for FROM pl WHERE element % 3 <> 0",
       "lx": f"SELECT name, element, position, team FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY GW DESC, kickoff_time DESC, fixture DESC, line DESC) AS k FROM app WHERE season = '{CURRENT}') WHERE k = 1 AND name NOT IN (SELECT name FROM sx)",
       "ux": "SELECT * FROM sx UNION ALL SELECT name, element, position, team, false FROM lx",
       "cx": f"SELECT name, position, team FROM ({_LATE})"}
add("K2_merge_players", lambda s, d: K.merge_players(_current(s, d), _updates(s, d)), ctes("app", "pl", extra=_KU) + "SELECT coalesce(c.name, u.name) AS name, CASE WHEN u.name IS NOT NULL THEN u.position ELSE c.position END AS position, CASE WHEN u.name IS NOT NULL THEN CASE WHEN plays_for THEN u.team END ELSE c.team END AS team FROM cx c FULL JOIN ux u ON u.name = c.name")
add("K3_player_updates", _updates, ctes("app", "pl", extra=_KU) + "SELECT * FROM ux")
add("K4_keeps_club", lambda s, d: pl(s, d).select("element", K.keeps_club().alias("keeps")), ctes("pl") + f"SELECT element, NOT {_GONE} AS keeps FROM pl")
add("K5_drop_stale_clubs", lambda s, d: K.drop_stale_clubs(_current(s, d), pl(s, d).filter("element % 4 <> 0")), ctes("app", "pl", extra={"c": f"SELECT name, position, team FROM ({_LATE})"}) + "SELECT name, position, CASE WHEN name IN (SELECT name FROM pl WHERE element % 4 <> 0) THEN team END AS team FROM c")


def _fx_parts(s, d):
    f = fx(s, d).select("id", "season", "gameweek", "home_team", "away_team", "home_score", "away_score", "status", "source")
    upd = f.filter("id % 5 = 0 AND season >= '1999-00'").withColumns({"gameweek": F.when(F.col("id") % 10 != 0, F.col("gameweek") + 1), "source": F.lit("api")})
    return f.filter("id % 25 <> 0"), upd


add("K6_merge_fixtures", lambda s, d: K.merge_fixtures(*_fx_parts(s, d)),
    ctes("fx", extra={"f": "SELECT id, season, gameweek, home_team, away_team, home_score, away_score, status, source FROM fx"})
    + "SELECT * FROM f WHERE id % 25 <> 0 AND NOT (id % 5 = 0 AND season >= '1999-00') AND NOT (season >= '1999-00' AND source = 'csv') UNION ALL SELECT id, season, CASE WHEN id % 10 <> 0 THEN gameweek + 1 END, home_team, away_team, home_score, away_score, status, 'api' FROM f WHERE id % 5 = 0 AND season >= '1999-00'")


def _folder(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _reload(s, d):
    """Load all seasons, then load one of them again with corrected rows: nothing doubles."""
    a = app(s, d).select("season", *ROW, "total_points")
    path = _folder(s, "facts")
    K.write_partitions(a, path)
    fixed = a.filter("season = '1999-00'").withColumn("total_points", F.col("total_points") + 100)
    K.write_partitions(fixed, path)
    K.write_partitions(fixed, path)
    return K.read_back(s, path).select("season", *ROW, "total_points")


add("K7_reload_season", _reload, ctes("app") + "SELECT season, element, fixture, line, CASE WHEN season = '1999-00' THEN total_points + 100 ELSE total_points END AS total_points FROM app")


def _replace_stats(s, d):
    from touchline.operators.derived import season_stats

    path = _folder(s, "stats")
    st = season_stats(app(s, d)).select("season", "name", "total_points", "games")
    K.write_partitions(st, path)
    K.write_partitions(season_stats(app(s, d).filter("season = '1998-99' AND GW <= 6")).select("season", "name", "total_points", "games"), path)
    return K.read_back(s, path).select("season", "name", "total_points", "games")


add("K8_replace_season_stats", _replace_stats, ctes("app") + "SELECT season, name, CAST(sum(total_points) AS BIGINT) AS total_points, count(*) AS games FROM app WHERE season <> '1998-99' OR GW <= 6 GROUP BY season, name")


def _deadlined(s, d):
    dl = X.deadlines(match_events(s, d)).select("season", "GW", (F.col("deadline") + F.expr("INTERVAL 12 HOURS")).alias("deadline"))
    return cap(s, d).filter("kind = 'click'").withColumnRenamed("value", "xP").join(dl, ["season", "GW"])


def _append(s, d):
    path = _folder(s, "archive")
    ok = K.before_deadline(_deadlined(s, d)).select("season", "GW", "element", "capture_id", "xP")
    K.append_rows(ok.filter("capture_id % 2 = 0"), path)
    K.append_rows(ok.filter("capture_id % 2 = 1"), path)
    return K.read_back(s, path).select("season", "GW", "element", "capture_id", "xP")


_DLX = {"j": "SELECT cap.*, dl.deadline + INTERVAL 12 HOUR AS dd FROM cap JOIN dl USING (season, GW) WHERE kind = 'click'"}
add("K9_append_captures", _append, ctes("dl", extra=_DLX) + "SELECT season, GW, element, capture_id, value AS \"xP\" FROM j WHERE captured_at < dd")
add("K10_last_forecasts", lambda s, d: K.last_forecasts(_deadlined(s, d)), ctes("dl", extra=_DLX) + "SELECT season, element, GW, arg_max(value, (captured_at, capture_id)) AS \"xP\" FROM j WHERE captured_at < dd GROUP BY season, element, GW")


def _output(s, d):
    now = app(s, d).filter((F.col("season") == CURRENT) & (F.col("GW") == 7)).groupBy("element").agg(F.sum("predicted_points").alias("predicted_points"))
    opp = L.opponents_in_gameweek(fx(s, d).filter((F.col("season") == CURRENT) & (F.col("gameweek") == 7))).select("team", "opponents")
    return K.prediction_output(pl(s, d), now, opp)


add("K11_prediction_output", _output,
    ctes("app", "pl", "tr", extra={"p": f"SELECT element, sum(predicted_points) AS pp FROM app WHERE season = '{CURRENT}' AND GW = 7 GROUP BY element", "o": f"SELECT team, string_agg(opponent || CASE WHEN is_home THEN ' (H)' ELSE ' (A)' END, ' & ' ORDER BY kickoff_time, id) AS opponent FROM tr WHERE season = '{CURRENT}' AND gameweek = 7 GROUP BY team"})
    + "SELECT pl.element, name, pl.team, position, round(coalesce(pp, 0), 3) AS predicted_points, coalesce(opponent, 'No fixture') AS opponent FROM pl LEFT JOIN p USING (element) LEFT JOIN o ON o.team = pl.team")


def _inputs(s, d):
    """Model inputs written in full precision and read back."""
    path = _folder(s, "inputs")
    six_cols = app(s, d).select(*ROW, (F.col("threat") / 7).alias("x"))
    six_cols.write.parquet(path)
    back = s.read.parquet(path)
    return back.join(six_cols.withColumnRenamed("x", "y"), ROW).agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("equal"))


add("K12_model_inputs", _inputs, ctes("app") + "SELECT count(*) AS n, count(*) AS equal FROM app")
add("K13_label_counts", lambda s, d: K.label_counts({"player": pl(s, d), "fixture": fx(s, d), "appearance": app(s, d)}), ctes("app", "fx", "pl") + "SELECT 'player' AS label, count(*) AS n FROM pl UNION ALL SELECT 'fixture', count(*) FROM fx UNION ALL SELECT 'appearance', count(*) FROM app")


def _promo(s, d):
    sup = roles.table(s, d, "supplier")
    listed = sup.select(F.concat(F.lit("Club "), F.col("s_suppkey").cast("string")).alias("team"))
    known = listed.filter("team LIKE 'Club 1%'")
    lower = sup.select(F.concat(F.lit("Club "), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, " Town").otherwise("")).alias("squad"), F.col("s_suppkey").alias("row_no")).filter("row_no % 3 <> 0")
    return K.promoted_clubs(listed, known, lower)


add("K14_promoted_clubs", _promo, "SELECT 'Club ' || CAST(s_suppkey AS STRING) AS team, 'Club ' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 2 = 0 THEN ' Town' ELSE '' END AS squad FROM supplier WHERE NOT starts_with('Club ' || CAST(s_suppkey AS STRING), 'Club 1') AND s_suppkey % 3 <> 0")
