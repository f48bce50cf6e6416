"""Queries for derived tables (A) and the read library (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.numbers import settle
from touchline.operators import derived as D
from touchline.operators import readlib as R
from touchline.plans import roles
from touchline.plans.registry import add
from touchline.plans.roles import CURRENT, ctes

app, fx, pl, sided = roles.appearances, roles.fixtures, roles.players, roles.sided_appearances
SEASON = "1999-00"


def ss(s, d):
    return D.season_stats(app(s, d))


# ---------------------------------------------------------------- derived tables
add("A1_season_stats", lambda s, d: _rounded(ss(s, d)), ctes("ss") + "SELECT name, season, total_points, goals, assists, clean_sheets, bonus, bps, minutes, saves, goals_conceded, yellow_cards, red_cards, value_sum, games, max_value, max_selected, appearances, team, position, round(ict_sum, 6) AS ict_sum, round(influence_sum, 6) AS influence_sum, round(creativity_sum, 6) AS creativity_sum, round(threat_sum, 6) AS threat_sum, round(ict_played_sum, 6) AS ict_played_sum, round(influence_played_sum, 6) AS influence_played_sum, round(creativity_played_sum, 6) AS creativity_played_sum, round(threat_played_sum, 6) AS threat_played_sum FROM ss")


def _rounded(df):
    return df.select(*[settle(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _tm(s, d):
    return D.team_matches(sided(s, d))


add("A2_team_matches", lambda s, d: _rounded(_tm(s, d)).drop("kickoff_time"),
    ctes("tm") + "SELECT season, fixture, team, GW, was_home, gf, ga, round(xgf, 6) AS xgf, round(xga, 6) AS xga FROM tm")
add("A3_opponents", lambda s, d: D.opponents(sided(s, d)),
    ctes("sided") + "SELECT DISTINCT a.season, a.fixture, a.team, b.team AS opponent FROM sided a JOIN sided b ON a.season = b.season AND a.fixture = b.fixture AND a.team <> b.team")
add("A4_team_season_estimates", lambda s, d: _rounded(D.team_season_estimates(app(s, d))),
    ctes("app", extra={
        "g": "SELECT season, team, GW, sum(goals_scored) AS g, max(clean_sheets) FILTER (WHERE position = 'DEF') AS cs FROM app GROUP BY season, team, GW",
        "t": "SELECT season, team, count(*) AS m, CAST(sum(g) AS BIGINT) AS goals, CAST(coalesce(sum(cs), 0) AS BIGINT) AS cs, count(cs) AS nd FROM g GROUP BY season, team",
        "u": "SELECT *, CASE WHEN nd > 0 THEN m - cs ELSE 0 END AS gc, greatest(0, m - cs - (m - cs) // 3) AS l FROM t"})
    + "SELECT season, team, m AS matches_played, goals AS goals_scored, cs AS clean_sheets, gc AS goals_conceded, cs AS wins_est, l AS losses_est, m - cs - l AS draws_est, cs * 3 + m - cs - l AS points, goals - gc AS goal_difference, round(goals / m, 6) AS goals_per_game, round(gc / m, 6) AS conceded_per_game, round((cs * 3 + m - cs - l) / m, 6) AS points_per_game FROM u")
add("A5_gameweek_actuals", lambda s, d: D.gameweek_actuals(app(s, d)),
    ctes("app") + "SELECT season, GW, element, CAST(sum(total_points) AS BIGINT) AS points, CAST(sum(minutes) AS BIGINT) AS minutes FROM app GROUP BY ALL")


def _codes(a):
    return a.filter("season >= '1997-98'").select("season", "element", (F.col("element") % 500).alias("code")).distinct()


def _spelled(a):
    """Names shortened to the product words, so that several codes share one."""
    return a.withColumn("name", F.regexp_replace("name", " [0-9]+$", ""))


add("A6_player_identity", lambda s, d: D.player_identity(_spelled(app(s, d)), _codes(app(s, d))),
    ctes("app", extra={
        "r": "SELECT DISTINCT season, element, regexp_replace(name, ' [0-9]+$', '') AS name FROM app",
        "k": "SELECT r.*, CASE WHEN season >= '1997-98' THEN element % 500 END AS code FROM r",
        "n": "SELECT code, arg_max(name, season || name) AS nm FROM k WHERE code IS NOT NULL GROUP BY code",
        "m": "SELECT code, CASE WHEN count(*) OVER (PARTITION BY nm) > 1 THEN nm || ' #' || CAST(code AS STRING) ELSE nm END AS lab FROM n"})
    + "SELECT season, element, name, coalesce(lab, name) AS player_key FROM k LEFT JOIN m USING (code)")
add("A7_fixtures_per_gameweek", lambda s, d: D.fixtures_per_gameweek(app(s, d)),
    ctes("app") + "SELECT season, GW, team, count(DISTINCT fixture) AS fixtures_in_gw FROM app GROUP BY ALL")
add("A8_weighted_rates", lambda s, d: _rounded(D.weighted_rates(app(s, d), ["season", "element"], "minutes", {"xg_rate": "expected_goals", "influence_rate": "influence"})),
    ctes("app") + "SELECT season, element, CAST(sum(minutes) AS BIGINT) AS weight_total, round(CASE WHEN sum(minutes) FILTER (WHERE expected_goals IS NOT NULL) > 0 THEN sum(expected_goals * minutes) / sum(minutes) FILTER (WHERE expected_goals IS NOT NULL) END, 6) AS xg_rate, round(CASE WHEN sum(minutes) > 0 THEN sum(influence * minutes) / sum(minutes) END, 6) AS influence_rate FROM app GROUP BY season, element")


def _stat_tables(s, d):
    a = app(s, d)
    keys = ["element", "season", "team"]
    base = a.groupBy(*keys, "position").agg(F.sum("minutes").alias("minutes"), F.sum("goals_scored").alias("goals"))
    shoot = a.groupBy(*keys).agg(F.sum("bps").alias("shots"), F.sum("minutes").alias("minutes"))
    misc = a.filter("yellow_cards + red_cards > 0").groupBy(*keys).agg(F.sum("yellow_cards").alias("cards"))
    keep = a.groupBy(*keys).agg(F.sum("saves").alias("saves"), F.sum("goals").alias("goals")) if "goals" in a.columns else a.groupBy(*keys).agg(F.sum("saves").alias("saves"))
    return keys, base, {"shoot": shoot, "misc": misc}, keep


def _merged(s, d):
    keys, base, others, keep = _stat_tables(s, d)
    return D.merge_stat_tables(base, others, keys, keep)


_MERGED = {
    "b": "SELECT element, season, team, position, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(goals_scored) AS BIGINT) AS goals, CAST(sum(bps) AS BIGINT) AS shots, CAST(sum(minutes) AS BIGINT) AS minutes_shoot, CASE WHEN position = 'GK' THEN CAST(sum(saves) AS BIGINT) END AS saves FROM app GROUP BY element, season, team, position",
    "c": "SELECT element, season, team, CAST(sum(yellow_cards) AS BIGINT) AS cards FROM app WHERE yellow_cards + red_cards > 0 GROUP BY ALL",
    "mg": "SELECT b.*, c.cards FROM b LEFT JOIN c USING (element, season, team)",
}
add("A9_merge_stat_tables", _merged, ctes("app", extra=_MERGED) + "SELECT * FROM mg")


def _texts(s, d):
    """Prices as thousands-separated text; short ones carry a letter and cannot be read."""
    li = roles.table(s, d, "lineitem")
    price = F.format_number("l_extendedprice", 0)
    return li.select(
        F.when(F.col("l_linenumber") == 1, F.concat(price, F.lit("x"))).otherwise(price).alias("price_text"),
        F.when(F.col("l_quantity") > 49, F.lit("n/a")).otherwise(F.format_number("l_quantity", 0)).alias("quantity_text"),
        F.format_number("l_partkey", 0).alias("part_text"),
    )


add("A10_coercion_report", lambda s, d: D.coercion_report(_texts(s, d), ["price_text", "quantity_text", "part_text"]),
    "WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber = 1) AS a, count(*) FILTER (WHERE l_quantity > 49) AS b FROM lineitem), "
    "u AS (SELECT 'price_text' AS column_name, a AS new_nulls, n AS \"rows\" FROM c UNION ALL SELECT 'quantity_text', b, n FROM c UNION ALL SELECT 'part_text', 0, n FROM c) "
    "SELECT *, CASE WHEN new_nulls / \"rows\" > 0.05 THEN 'review' WHEN new_nulls > 0 THEN 'minor' ELSE 'ok' END AS state FROM u")
add("A10_coerced_sums", lambda s, d: D.coerce_numbers(_texts(s, d), ["price_text", "quantity_text", "part_text"]).agg(
        F.sum("price_text").alias("price"), F.sum("quantity_text").alias("quantity"), F.sum("part_text").alias("part")),
    "SELECT sum(CASE WHEN l_linenumber <> 1 THEN round_even(l_extendedprice, 0) END) AS price, sum(CASE WHEN l_quantity <= 49 THEN l_quantity END) AS quantity, CAST(sum(l_partkey) AS DOUBLE) AS part FROM lineitem")


def _nation_map(s, d):
    n = roles.table(s, d, "nation")
    return n.filter("n_nationkey % 3 = 0").select(
        F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("source"),
        F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("target"))


add("A11_map_names", lambda s, d: D.map_names(
        roles.table(s, d, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("squad")),
        "squad", _nation_map(s, d), "squad_clean"),
    "SELECT c_custkey, 'NATION_' || CAST(c_nationkey AS STRING) AS squad, CASE WHEN c_nationkey % 3 = 0 THEN 'Nation ' ELSE 'NATION_' END || CAST(c_nationkey AS STRING) AS squad_clean FROM customer")
add("A12_drop_redundant_columns", lambda s, d: D.drop_redundant_columns(_merged(s, d)),
    ctes("app", extra=_MERGED) + "SELECT * EXCLUDE (minutes_shoot) FROM mg")
add("A13_split_keepers", lambda s, d: D.split_flag(_merged(s, d)).groupBy("is_gk").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes")),
    ctes("app", extra=_MERGED) + "SELECT position = 'GK' AS is_gk, count(*) AS n, CAST(sum(minutes) AS BIGINT) AS minutes FROM mg GROUP BY 1")


def _raw_stats(s, d):
    p = roles.table(s, d, "part").filter("p_partkey IS NOT NULL")
    pos = F.when(F.col("p_type") == "PROMO", "GK").when(F.col("p_type") == "ECONOMY", "DF,MF").when(F.col("p_type") == "LARGE", "FW").when(F.col("p_type") == "SMALL", "??")
    one = p.select(F.col("p_name").alias("Player"), F.col("p_brand").alias("Squad Name"), pos.alias("Pos"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("Gls-90"))
    return one.unionByName(one)


add("A14_clean_player_stats", lambda s, d: D.clean_player_stats(_raw_stats(s, d), "Pos", ["Gls-90"]),
    "SELECT DISTINCT p_name AS player, p_brand AS squad_name, CASE p_type WHEN 'PROMO' THEN 'GK' WHEN 'ECONOMY' THEN 'DF,MF' WHEN 'LARGE' THEN 'FW' WHEN 'SMALL' THEN '??' END AS pos, CASE WHEN p_size > 5 THEN p_size ELSE 0 END AS gls_90, CASE p_type WHEN 'PROMO' THEN 'GK' WHEN 'ECONOMY' THEN 'DEF' WHEN 'LARGE' THEN 'FWD' ELSE 'MID' END AS position FROM part")


def _lower_tier(s, d):
    """Second-tier seasons: clubs up to the middle of the alphabet of the same table."""
    a = app(s, d)
    return a.groupBy("season", "team", "name", "element").agg(F.sum("minutes").alias("minutes"), F.sum("goals_scored").alias("goals"))


def _promoted(s, d):
    """Three promoted clubs a season: those with most second-tier minutes."""
    from touchline.functions.ordered import top_n

    t = _lower_tier(s, d).groupBy("season", "team").agg(F.sum("minutes").alias("m"))
    return top_n(t, ["season"], [F.col("m").desc(), F.col("team")], 3, "finish_position").select("season", F.col("team").alias("club"), "finish_position")


_PROMO = {
    "lt": "SELECT season, team, name, element, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(goals_scored) AS BIGINT) AS goals FROM app GROUP BY ALL",
    "pr": "SELECT season, team AS club, CAST(rn AS INT) AS finish_position FROM (SELECT season, team, row_number() OVER (PARTITION BY season ORDER BY sum(minutes) DESC, team) AS rn FROM lt GROUP BY season, team) WHERE rn <= 3",
    "fl": "SELECT lt.*, h.f IS NOT NULL AS was_promoted, coalesce(h.f, 0) AS team_finish_position FROM lt LEFT JOIN (SELECT t.season, t.team, max(finish_position) AS f FROM (SELECT DISTINCT season, team FROM lt) t JOIN pr ON t.season = pr.season AND contains(lower(t.team), lower(pr.club)) GROUP BY ALL) h ON lt.season = h.season AND lt.team = h.team",
}


def _flagged(s, d):
    return D.promoted_flags(_lower_tier(s, d), _promoted(s, d), "season", "team")


add("A15_promoted_flags", _flagged, ctes("app", extra=_PROMO) + "SELECT * FROM fl")


def _year(c="season"):
    return F.substring(c, 1, 4).cast("int")


def _matched(s, d):
    low = _flagged(s, d).select(
        F.regexp_extract("name", "([0-9]+)$", 1).alias("player"), _year().alias("season_no"), "minutes", "was_promoted", F.col("team").alias("squad"))
    top = app(s, d).select("name", _year().alias("season_no"), "total_points", "minutes", "goals_scored")
    return D.match_promoted_players(low, top, 100)


add("A16_match_promoted_players", lambda s, d: _rounded(_matched(s, d)),
    ctes("app", extra=_PROMO | {
        "lo": "SELECT regexp_extract(name, '([0-9]+)$', 1) AS player, CAST(substr(season, 1, 4) AS INT) + 1 AS season_no, minutes AS lower_minutes, team AS squad FROM fl WHERE was_promoted AND minutes >= 100",
        "tp": "SELECT name, CAST(substr(season, 1, 4) AS INT) AS season_no, CAST(sum(total_points) AS BIGINT) AS top_points, CAST(sum(minutes) AS BIGINT) AS top_minutes, CAST(sum(goals_scored) AS BIGINT) AS top_goals FROM app GROUP BY ALL",
        "hh": "SELECT lo.*, tp.* EXCLUDE (season_no), row_number() OVER (PARTITION BY player, squad, lo.season_no, lower_minutes ORDER BY name, top_points, top_minutes, top_goals) AS rn FROM lo JOIN tp ON lo.season_no = tp.season_no AND contains(lower(tp.name), lower(lo.player))"})
    + "SELECT * EXCLUDE (rn), round(top_points / (top_minutes / 90), 6) AS top_points_per_90 FROM hh WHERE rn = 1 AND top_minutes >= 100")


def _per90(s, d):
    t = _lower_tier(s, d)
    rate = F.when(F.col("minutes") > 0, F.col("goals") / (F.col("minutes") / 90)).otherwise(0.0)
    return t.select("season", "team", rate.alias("goals_per_90"), "minutes", (rate / 2).alias("top_goals_per_90"), (F.col("minutes") * 2).alias("top_minutes"), (F.col("goals") * 5).alias("top_points"))


add("A17_team_translation_sums", lambda s, d: _rounded(D.team_translation_sums(_per90(s, d))),
    ctes("app", extra={"lt": _PROMO["lt"], "g": "SELECT season, team, sum(CASE WHEN minutes > 0 THEN goals ELSE 0 END) AS g, sum(minutes) AS m, sum(goals) AS ag, count(*) AS n FROM lt GROUP BY ALL"})
    + "SELECT season, team, round(CAST(g AS DOUBLE), 6) AS lower_goals, round(CAST(g AS DOUBLE), 6) AS top_goals, CAST(m AS BIGINT) AS lower_minutes, CAST(2 * m AS BIGINT) AS top_minutes, CAST(5 * ag AS BIGINT) AS top_points, n AS player_count, round(g / n, 6) AS lower_goals_per_match, round(g / n, 6) AS top_goals_per_match, round(5 * ag / n, 6) AS top_points_per_player FROM g")
add("A18_trajectories", lambda s, d: D.trajectories(_flagged(s, d)),
    ctes("app", extra=_PROMO) + "SELECT name, count(DISTINCT season) AS seasons, CAST(sum(minutes) AS BIGINT) AS minutes, array_to_string(list_sort(list(DISTINCT season) FILTER (WHERE was_promoted)), ',') AS promoted_seasons FROM fl GROUP BY name HAVING count(DISTINCT season) >= 2 AND bool_or(was_promoted)")
add("A19_club_votes", lambda s, d: D.club_votes(
        fx(s, d).select(F.to_date("kickoff_time").alias("date"), F.regexp_extract("home_team", "([0-9]+)$", 1).cast("int").alias("club_id")),
        fx(s, d).select(F.to_date("kickoff_time").alias("date"), F.col("home_team").alias("team"))),
    ctes("fx", extra={
        "h": "SELECT CAST(kickoff_time AS DATE) AS dt, home_team AS team, CAST(regexp_extract(home_team, '([0-9]+)$', 1) AS INT) AS club_id FROM fx",
        "v": "SELECT a.club_id, b.team, count(*) AS votes FROM h a JOIN h b ON a.dt = b.dt GROUP BY ALL",
        "b": "SELECT *, row_number() OVER (PARTITION BY club_id ORDER BY votes DESC, team) AS rn FROM v",
        "o": "SELECT b.club_id, b.team, b.votes, n.homes FROM b JOIN (SELECT club_id, count(*) AS homes FROM h GROUP BY 1) n USING (club_id) WHERE rn = 1 AND votes >= 0.8 * homes"})
    + "SELECT *, count(*) OVER (PARTITION BY team) > 1 AS is_duplicate FROM o")


def _linked(s, d):
    low = _lower_tier(s, d).select(_year().alias("season_no"), F.col("team").alias("squad"), F.upper("name").alias("player"), "minutes")
    top = app(s, d).select(_year().alias("season_no"), "team", "name", "minutes", "total_points")
    return D.link_promoted_squads(low, top, _promoted(s, d).select(_year().alias("season_no"), "club"))


add("A20_link_promoted_squads", _linked,
    ctes("app", extra=_PROMO) + "SELECT l.y + 1 AS season_no, l.team, l.name AS name_key, l.minutes AS lower_minutes, t.top_minutes, t.top_points, t.top_games FROM (SELECT *, CAST(substr(season, 1, 4) AS INT) AS y FROM lt) l JOIN pr ON pr.season = l.season AND pr.club = l.team JOIN (SELECT CAST(substr(season, 1, 4) AS INT) AS y, team, name, CAST(sum(minutes) AS BIGINT) AS top_minutes, CAST(sum(total_points) AS BIGINT) AS top_points, count(*) AS top_games FROM app GROUP BY ALL) t ON t.y = l.y + 1 AND t.team = l.team AND t.name = l.name")

# ---------------------------------------------------------------- read library
SUMS = "name, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(bonus) AS BIGINT) AS bonus, CAST(sum(games) AS BIGINT) AS games"
PO = "list_position(['GK', 'DEF', 'MID', 'FWD'], position)"

add("G1_top_scorers", lambda s, d: R.top_by_metric(ss(s, d), "goals", "total_goals"),
    ctes("ss") + f"SELECT name AS player_name, goals AS total_goals, total_points FROM (SELECT {SUMS} FROM ss GROUP BY name) WHERE goals > 0 ORDER BY goals DESC, total_points DESC, name LIMIT 10")
add("G2_top_assisters", lambda s, d: R.top_by_metric(ss(s, d), "assists", "total_assists", season=SEASON),
    ctes("ss") + f"SELECT name AS player_name, assists AS total_assists, total_points FROM (SELECT {SUMS} FROM ss WHERE season = '{SEASON}' GROUP BY name) WHERE assists > 0 ORDER BY assists DESC, total_points DESC, name LIMIT 10")
_G3 = f"(SELECT {SUMS}, count(*) AS k, arg_max(ss.team, ss.season) AS lt, arg_max(ss.position, ss.season) AS lp FROM ss %s GROUP BY name)"
for key, pos, season, sort in [("all", None, None, "points"), ("mid", "MID", SEASON, "points_per_game"), ("bps", "DEF", None, "bps")]:
    where = " AND ".join([f"{c} = '{v}'" for c, v in (("position", pos), ("season", season)) if v])
    many = f"'{pos}'" if pos else "pl.position"
    col = R.SORT_NAMES[sort]
    first = "total_points / games" if col == "points_per_game" else f"t.{col}"
    add(f"G3_top_by_position_{key}", lambda s, d, p=pos, y=season, o=sort: R.top_by_position(ss(s, d), pl(s, d), p, y, o),
        ctes("ss", "pl") + f"SELECT t.name AS player_name, CASE WHEN k = 1 THEN lp ELSE {many} END AS position, CASE WHEN k = 1 THEN lt ELSE coalesce(pl.team, lt) END AS team, total_points, goals, assists, bonus, games, round(total_points / games, 2) AS points_per_game FROM {_G3 % ('WHERE ' + where if where else '')} t LEFT JOIN pl ON pl.name = t.name ORDER BY {first} DESC, total_points DESC, t.name LIMIT 10")
add("G3_top_in_gameweek", lambda s, d: R.top_by_position_in_gameweek(app(s, d), pl(s, d), 5, "FWD", SEASON, "goals"),
    ctes("app", "pl") + f"SELECT app.name AS player_name, pl.position, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(goals_scored) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(bonus) AS BIGINT) AS bonus, count(*) AS games, arg_min(app.team, (kickoff_time, fixture, line)) AS team, round(sum(total_points) / count(*), 2) AS points_per_game FROM app JOIN pl ON pl.name = app.name WHERE GW = 5 AND season = '{SEASON}' AND pl.position = 'FWD' GROUP BY app.name, pl.position ORDER BY goals DESC, total_points DESC, player_name LIMIT 10")
_G4 = f"SELECT position, name AS player_name, total_points, goals, assists, bonus, games, round(total_points / games, 2) AS points_per_game, CAST(rn AS INT) AS rank_no FROM (SELECT t.*, pl.position, row_number() OVER (PARTITION BY pl.position ORDER BY total_points DESC, t.name) AS rn FROM (SELECT {SUMS} FROM ss GROUP BY name) t JOIN pl ON pl.name = t.name) WHERE rn <= 5"
add("G4_top_per_position", lambda s, d: R.top_per_position(R.player_totals(ss(s, d)), pl(s, d)), ctes("ss", "pl") + _G4)
_AVG = "name AS player_name, season, team, position, games, total_points, goals, assists, clean_sheets, bonus, minutes, round(ict_sum / games, 2) AS avg_ict_index, round(value_sum / games / 10, 2) AS avg_value_millions"
add("G5_player_season", lambda s, d: R.player_season(ss(s, d)), ctes("ss") + f"SELECT {_AVG} FROM ss")
NAME = "(SELECT name FROM pl WHERE element = 7)"


def name7(s, d):
    """The name of one player, looked up as a user would type it."""
    row = pl(s, d).filter("element = 7").select("name").first()
    return row["name"]


add("G6_player_seasons", lambda s, d: R.player_seasons(ss(s, d), name7(s, d)), ctes("ss", "pl") + f"SELECT {_AVG} FROM ss WHERE name = {NAME}")
add("G7_player_career", lambda s, d: R.player_career(ss(s, d)),
    ctes("ss") + "SELECT name AS player_name, count(*) AS seasons, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(clean_sheets) AS BIGINT) AS clean_sheets, CAST(sum(bonus) AS BIGINT) AS bonus, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(games) AS BIGINT) AS games, max(max_value) / 10 AS max_value_millions FROM ss GROUP BY name")
add("G8_player_gameweek", lambda s, d: R.player_gameweek(app(s, d), fx(s, d)),
    ctes("app", "fx") + "SELECT app.name AS player_name, fixture, line, team, app.season, GW, total_points, goals_scored, assists, minutes, bonus, home_team, away_team, home_score, away_score FROM app JOIN fx ON fx.id = app.fixture")
add("G9_team_top_performers", lambda s, d: R.team_top_performers(ss(s, d), "Club 3"),
    ctes("ss") + "SELECT name AS player_name, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists FROM ss WHERE team = 'Club 3' GROUP BY name ORDER BY total_points DESC, name LIMIT 5")
add("G10_team_squad_current", lambda s, d: R.team_squad(ss(s, d), pl(s, d), "Club 3", CURRENT, CURRENT),
    ctes("ss", "pl") + f"SELECT pl.name AS player_name, pl.position, 'Club 3' AS team, coalesce(total_points, 0) AS total_points, coalesce(minutes, 0) AS minutes, coalesce(goals, 0) AS goals, coalesce(assists, 0) AS assists, coalesce(appearances, games, 0) AS games, status, news FROM pl LEFT JOIN ss ON ss.name = pl.name AND ss.season = '{CURRENT}' WHERE pl.team = 'Club 3' ORDER BY list_position(['GK', 'DEF', 'MID', 'FWD'], pl.position), total_points DESC, minutes DESC, player_name LIMIT 40")
add("G10_team_squad_past", lambda s, d: R.team_squad(ss(s, d), pl(s, d), "Club 3", SEASON, CURRENT, "DEF"),
    ctes("ss") + f"SELECT name AS player_name, position, team, total_points, minutes, goals, assists, appearances AS games, CAST(NULL AS STRING) AS status, CAST(NULL AS STRING) AS news FROM ss WHERE team = 'Club 3' AND season = '{SEASON}' AND position = 'DEF' ORDER BY total_points DESC, minutes DESC, name LIMIT 40")
_FR = "id, season, gameweek, home_team, away_team, home_score, away_score"
add("G11_fixture_results", lambda s, d: R.fixture_results(fx(s, d), "Club 3"), ctes("fx") + f"SELECT {_FR} FROM fx WHERE home_score IS NOT NULL AND 'Club 3' IN (home_team, away_team)")
add("G12_head_to_head", lambda s, d: R.head_to_head(fx(s, d), "Club 3", "Club 9"), ctes("fx") + f"SELECT {_FR} FROM fx WHERE home_score IS NOT NULL AND 'Club 3' IN (home_team, away_team) AND 'Club 9' IN (home_team, away_team)")
add("G13_best_value", lambda s, d: R.best_value(ss(s, d), pl(s, d), SEASON),
    ctes("ss", "pl") + f"SELECT ss.name AS player_name, pl.position, total_points, value_sum / games / 10 AS value_millions, round(total_points * 10 / (value_sum / games), 2) AS points_per_million FROM ss JOIN pl ON pl.name = ss.name WHERE season = '{SEASON}' AND games > 0 AND value_sum > 0 ORDER BY total_points * 10 / (value_sum / games) DESC, ss.name LIMIT 10")
for direction in ("in", "out"):
    add(f"G14_most_transferred_{direction}", lambda s, d, k=direction: R.most_transferred(app(s, d), None, 7, k, 40),
        ctes("app") + f"SELECT name AS player_name, fixture, line, transfers_{direction} AS transfers, total_points AS points FROM app WHERE GW = 7 ORDER BY transfers DESC NULLS FIRST, name, fixture, line LIMIT 40")
add("G15_bonus_leaders", lambda s, d: R.bonus_leaders(ss(s, d), SEASON),
    ctes("ss") + f"SELECT name AS player_name, bonus AS total_bonus, bps AS total_bps, games, round(bonus / games, 2) AS bonus_per_game FROM ss WHERE season = '{SEASON}' AND bonus > 0 ORDER BY bonus DESC, bps DESC, name LIMIT 10")
add("G16_clean_sheet_leaders", lambda s, d: R.clean_sheet_leaders(ss(s, d), pl(s, d)),
    ctes("ss", "pl") + "SELECT ss.name AS player_name, pl.position, CAST(sum(clean_sheets) AS BIGINT) AS total_clean_sheets, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(games) AS BIGINT) AS games, round(sum(clean_sheets) / sum(games), 2) AS clean_sheets_per_game FROM ss JOIN pl ON pl.name = ss.name WHERE pl.position IN ('GK', 'DEF') GROUP BY ss.name, pl.position HAVING sum(clean_sheets) > 0 ORDER BY 3 DESC, 4 DESC, 1 LIMIT 10")
add("G17_ict_leaders", lambda s, d: R.ict_leaders(ss(s, d), pl(s, d), None),
    ctes("ss", "pl") + "SELECT ss.name AS player_name, season, pl.position, round(influence_played_sum / appearances, 2) AS avg_influence, round(creativity_played_sum / appearances, 2) AS avg_creativity, round(threat_played_sum / appearances, 2) AS avg_threat, total_points, appearances AS games, round(ict_played_sum / appearances, 2) AS avg_ict_index FROM ss JOIN pl ON pl.name = ss.name WHERE appearances >= 10 ORDER BY round(ict_played_sum / appearances, 9) DESC, ss.name, season LIMIT 10")
add("G18_most_selected", lambda s, d: R.most_selected(app(s, d), pl(s, d), SEASON, 7),
    ctes("app", "pl") + f"SELECT app.name AS player_name, pl.position, fixture, line, selected, value / 10 AS value_millions, total_points AS points FROM app JOIN pl ON pl.name = app.name WHERE season = '{SEASON}' AND GW = 7 ORDER BY selected DESC, app.name, fixture, line LIMIT 10")
add("G19_compare_players", lambda s, d: R.compare_players(ss(s, d), pl(s, d), [r["name"] for r in pl(s, d).filter("element IN (7, 9)").select("name").take(2)]),
    ctes("ss", "pl") + "SELECT ss.name AS player_name, pl.position, pl.team, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(clean_sheets) AS BIGINT) AS clean_sheets, CAST(sum(bonus) AS BIGINT) AS bonus, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(games) AS BIGINT) AS games, round(sum(ict_sum) / sum(games), 2) AS avg_ict_index, round(sum(value_sum) / 10 / sum(games), 2) AS avg_value_millions FROM ss JOIN pl ON pl.name = ss.name WHERE pl.element IN (7, 9) GROUP BY ALL")
add("G20_form_history", lambda s, d: R.form_history(app(s, d), name7(s, d)),
    ctes("app") + "SELECT season, GW AS gameweek, fixture, line, total_points AS points, goals_scored AS goals, assists, minutes FROM app WHERE element = 7")
add("G21_similar_players", lambda s, d: R.similar_players(ss(s, d), pl(s, d), name7(s, d)),
    ctes("ss", "pl", extra={"t": f"SELECT g.*, pl.position, pl.element FROM (SELECT {SUMS} FROM ss GROUP BY name) g JOIN pl USING (name)"})
    + "SELECT t.name AS player_name, t.position, t.total_points, t.goals, t.assists, t.bonus, t.games, abs(t.total_points - r.total_points) + abs(t.goals - r.goals) * 10 + abs(t.assists - r.assists) * 5 AS diff_score FROM t JOIN t r ON r.element = 7 AND r.position = t.position WHERE t.element <> 7 ORDER BY diff_score, t.name LIMIT 10")
add("G22_search_players", lambda s, d: R.search_players(pl(s, d), "Réd Wid"),
    ctes("pl") + "SELECT name AS player_name, position, element AS element_id, team AS team_name FROM pl WHERE contains(lower(name), 'red wid') ORDER BY name LIMIT 20")
add("G23_all_player_names", lambda s, d: R.all_player_names(pl(s, d)), ctes("pl") + "SELECT DISTINCT name AS player_name FROM pl")
add("G23_players_by_position", lambda s, d: R.players_by_position(pl(s, d), "GK"), ctes("pl") + "SELECT name AS player_name, element AS element_id FROM pl WHERE position = 'GK'")
add("G23_all_teams", lambda s, d: R.all_teams(app(s, d)), ctes("app") + "SELECT DISTINCT team AS team_name FROM app")
_SUMM = "SELECT f.season, total_gameweeks, total_fixtures, total_goals, coalesce(p, 0) AS total_points, coalesce(n, 0) AS total_players, round(total_goals / total_fixtures, 2) AS goals_per_game FROM (SELECT season, count(DISTINCT gameweek) AS total_gameweeks, count(*) AS total_fixtures, CAST(sum(home_score + away_score) AS BIGINT) AS total_goals FROM fx WHERE home_score IS NOT NULL GROUP BY season) f LEFT JOIN (SELECT season, CAST(sum(total_points) AS BIGINT) AS p, count(*) AS n FROM ss GROUP BY season) s USING (season)"
add("G24_season_summary", lambda s, d: R.seasons_summary(fx(s, d), ss(s, d), SEASON), ctes("fx", "ss") + _SUMM + f" WHERE f.season = '{SEASON}'")
add("G25_all_seasons_summary", lambda s, d: R.seasons_summary(fx(s, d), ss(s, d)), ctes("fx", "ss") + _SUMM)
add("G26_highest_gameweek_score", lambda s, d: R.highest_gameweek_score(app(s, d), None),
    ctes("app") + "SELECT name AS player_name, season, GW AS gameweek, total_points AS points, goals_scored AS goals, assists, bonus, fixture, line FROM app WHERE total_points > 0 ORDER BY points DESC, name, fixture, line LIMIT 1")
for card in ("yellow", "red"):
    add(f"G27_most_cards_{card}", lambda s, d, c=card: R.most_cards(ss(s, d), SEASON, c),
        ctes("ss") + f"SELECT name AS player_name, {card}_cards AS total_cards FROM ss WHERE season = '{SEASON}' AND {card}_cards > 0 ORDER BY 2 DESC, 1 LIMIT 5")
add("G28_saves_leaders", lambda s, d: R.saves_leaders(ss(s, d), pl(s, d), SEASON),
    ctes("ss", "pl") + f"SELECT name AS player_name, saves AS total_saves, clean_sheets FROM ss WHERE season = '{SEASON}' AND saves > 0 AND name IN (SELECT name FROM pl WHERE position = 'GK') ORDER BY 2 DESC, 1 LIMIT 5")
add("G29_highest_scoring_fixtures", lambda s, d: R.highest_scoring_fixtures(fx(s, d), SEASON),
    ctes("fx") + f"SELECT id, home_team, away_team, home_score, away_score, home_score + away_score AS total_goals, gameweek FROM fx WHERE season = '{SEASON}' AND home_score IS NOT NULL ORDER BY total_goals DESC, gameweek, home_team, id LIMIT 5")
_EMB = "name, season, position, total_points, goals AS goals_scored, assists, clean_sheets, bonus, bps, minutes, round(ict_sum / games, 6) AS ict_index, round(influence_sum / games, 6) AS influence, round(creativity_sum / games, 6) AS creativity, round(threat_sum / games, 6) AS threat, round(value_sum / games, 6) AS value, max_selected AS selected, saves, goals_conceded, yellow_cards, red_cards, games, team"
add("G30_embedding_rows", lambda s, d: _rounded(R.embedding_rows(ss(s, d))), ctes("ss") + f"SELECT {_EMB} FROM ss")
add("G31_player_totals", lambda s, d: R.player_totals(ss(s, d)), ctes("ss") + f"SELECT {SUMS} FROM ss GROUP BY name")
add("G31_player_totals_gameweek", lambda s, d: R.player_totals(None, app(s, d), None, 3),
    ctes("app") + "SELECT name, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(goals_scored) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(bonus) AS BIGINT) AS bonus, count(*) AS games FROM app WHERE GW = 3 GROUP BY name")
_LEAD = "SELECT ss.name, ss.team, ss.position, appearances AS games, minutes, goals, assists, clean_sheets, bonus, total_points, round_even(value_sum / 10 / games, 1) AS price, %s AS status, %s AS news, round_even(CASE WHEN appearances > 0 THEN total_points / appearances ELSE 0 END, 2) AS points_per_game FROM ss LEFT JOIN pl ON pl.name = ss.name WHERE season = '%s' AND minutes >= %d %s ORDER BY %s DESC, total_points DESC, ss.name LIMIT 50"
add("G32_leaders_current", lambda s, d: R.leaders(ss(s, d), pl(s, d), CURRENT, CURRENT, max_price=9.0),
    ctes("ss", "pl") + _LEAD % ("pl.status", "pl.news", CURRENT, 0, "AND value_sum / 10 / games <= 9.0 + 1e-9", "total_points"))
add("G32_leaders_per_game", lambda s, d: R.leaders(ss(s, d), pl(s, d), SEASON, CURRENT, "points_per_game", "MID"),
    ctes("ss", "pl") + _LEAD % ("CAST(NULL AS STRING)", "CAST(NULL AS STRING)", SEASON, 270, "AND ss.position = 'MID'", "CASE WHEN appearances > 0 THEN total_points / appearances ELSE 0 END"))
add("G33_clubs", lambda s, d: R.clubs(fx(s, d)), ctes("fx") + "SELECT season, home_team AS team FROM fx UNION SELECT season, away_team FROM fx")
add("G34_match_players", lambda s, d: R.match_players(app(s, d), ss(s, d)),
    ctes("app", "ss") + "SELECT app.fixture, app.line, app.season, app.name, app.team, app.minutes, app.total_points, ss.position AS season_position FROM app LEFT JOIN ss ON ss.name = app.name AND ss.season = app.season")
add("G35_meetings", lambda s, d: R.meetings(fx(s, d)),
    ctes("fx", extra={"f": "SELECT *, least(home_team, away_team) || '|' || greatest(home_team, away_team) AS pair FROM fx"})
    + "SELECT id, earlier_id, home_team, home_score, away_score FROM (SELECT a.id, b.id AS earlier_id, b.home_team, b.home_score, b.away_score, row_number() OVER (PARTITION BY a.id ORDER BY b.kickoff_time DESC, b.id DESC) AS rn FROM f a JOIN f b ON a.pair = b.pair AND b.kickoff_time < a.kickoff_time AND b.home_score IS NOT NULL) WHERE rn <= 6")
add("G36_scorers", lambda s, d: R.scorers(sided(s, d)),
    ctes("sided") + "SELECT fixture, name, line, 'goal' AS kind, goals_scored AS n, CASE WHEN was_home THEN 'home' ELSE 'away' END AS side FROM sided WHERE goals_scored > 0 UNION ALL SELECT fixture, name, line, 'own_goal', own_goals, CASE WHEN was_home THEN 'away' ELSE 'home' END FROM sided WHERE own_goals > 0")
add("G37_position_pool", lambda s, d: R.position_pool(ss(s, d), name7(s, d)),
    ctes("ss", "pl") + f"SELECT season, position, name, total_points, goals, assists, minutes FROM ss WHERE (season, position) IN (SELECT (season, position) FROM ss WHERE name = {NAME})")
add("G38_expected_goals", lambda s, d: R.expected_goals_by_fixture(app(s, d)),
    ctes("app") + "SELECT fixture, team, round(sum(expected_goals), 2) AS xg FROM app GROUP BY ALL HAVING count(expected_goals) > 0")
add("G39_next_fixture", lambda s, d: R.next_fixture(fx(s, d), "2001-06-20"),
    ctes("fx", extra={"u": "SELECT home_team AS team, away_team AS opponent, true AS is_home, id, kickoff_time FROM fx UNION ALL SELECT away_team, home_team, false, id, kickoff_time FROM fx"})
    + "SELECT team, id, opponent, is_home FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff_time, id) AS rn FROM u WHERE kickoff_time > TIMESTAMP '2001-06-20') WHERE rn = 1")
add("G40_opponent_strength", lambda s, d: _rounded(R.opponent_strength(_tm(s, d), "1995-03-01")),
    ctes("tm") + "SELECT t.team, round(coalesce(c, 1.5), 6) AS avg_conceded, round(coalesce(s, 1.5), 6) AS avg_scored FROM (SELECT DISTINCT team FROM tm) t LEFT JOIN (SELECT team, avg(ga) AS c, avg(gf) AS s FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff_time DESC, fixture DESC) AS rn FROM tm WHERE kickoff_time <= TIMESTAMP '1995-03-01') WHERE rn <= 5 GROUP BY team) USING (team)")
add("G41_random_players", lambda s, d: R.random_players(ss(s, d), SEASON),
    ctes("ss") + f"SELECT name, position, total_points FROM ss WHERE season = '{SEASON}' AND total_points >= 20 ORDER BY md5(concat_ws('|', '7', name)), name LIMIT 4")
_QUIZ = [("points", "total_points", "Who had the most points in ", " had ", " points."), ("goals", "goals", "Who scored the most goals in ", " scored ", " goals."), ("assists", "assists", "Who gave the most assists in ", " gave ", " assists."), ("bonus", "bonus", "Who won the most bonus points in ", " won ", " bonus points."), ("clean_sheets", "clean_sheets", "Who kept the most clean sheets in ", " kept ", " clean sheets."), ("cards", "yellow_cards", "Who saw the most yellow cards in ", " saw ", " yellow cards.")]
add("G42_quiz", lambda s, d: R.quiz(ss(s, d), fx(s, d)),
    ctes("ss", "fx") + " UNION ALL ".join(
        f"SELECT season, '{k}' AS category, '{q}' || season || '?' AS question, name AS answer, name || '{a}' || CAST(n AS STRING) || '{b}' AS explanation FROM (SELECT season, name, {c} AS n, row_number() OVER (PARTITION BY season ORDER BY {c} DESC, name) AS rn FROM ss) WHERE rn = 1 AND n > 0"
        for k, c, q, a, b in _QUIZ)
    + " UNION ALL SELECT season, 'fixture', 'Which match of ' || season || ' had the most goals?', home_team || ' v ' || away_team, home_team || ' v ' || away_team || ' had ' || CAST(home_score + away_score AS STRING) || ' goals.' FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY home_score + away_score DESC, id) AS rn FROM fx WHERE home_score IS NOT NULL) WHERE rn = 1")
add("G43_filter_predictions", lambda s, d: R.filter_predictions(app(s, d), "MID", "CLUB 3", 9.0, "réd").select("name", "fixture", "line", "team", "value", "predicted_points"),
    ctes("app") + "SELECT name, fixture, line, team, value, predicted_points FROM app WHERE position = 'MID' AND lower(team) = 'club 3' AND value / 10 <= 9.0 + 1e-9 AND contains(lower(name), 'red')")
add("G44_top_predicted", lambda s, d: R.top_predicted(app(s, d), 20, 4, 3),
    ctes("app") + "SELECT element, name, position, value, round(sum(predicted_points), 3) AS predicted_total FROM app WHERE GW BETWEEN 3 AND 6 GROUP BY ALL ORDER BY predicted_total DESC, element, value LIMIT 20")
add("G45_best_value_predicted", lambda s, d: R.best_value_predicted(app(s, d), 20),
    ctes("app") + "SELECT name, position, fixture, line, predicted_points, value, round(predicted_points / (value / 10), 4) AS points_per_million FROM app WHERE value > 0 ORDER BY points_per_million DESC, name, fixture, line LIMIT 20")
add("G46_tied_leaders", lambda s, d: R.tied_leaders(app(s, d), ["season", "GW"], "total_points").select("season", "GW", "name", "fixture", "line", "total_points"),
    ctes("app") + "SELECT season, GW, name, fixture, line, total_points FROM (SELECT *, rank() OVER (PARTITION BY season, GW ORDER BY total_points DESC) AS r FROM app) WHERE r = 1")
add("G47_top_predicted_per_side", lambda s, d: R.top_predicted_per_side(sided(s, d)),
    ctes("sided") + "SELECT fixture, was_home, name, line, predicted_points, CAST(rn AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY fixture, was_home ORDER BY predicted_points DESC, element, line) AS rn FROM sided) WHERE rn <= 3")
add("G48_season_totals_for", lambda s, d: R.season_totals_for(ss(s, d), pl(s, d).filter("penalties_order = 1").select("name"), SEASON),
    ctes("ss", "pl") + f"SELECT name, total_points, goals, assists, minutes, games FROM ss WHERE season = '{SEASON}' AND name IN (SELECT name FROM pl WHERE penalties_order = 1)")
