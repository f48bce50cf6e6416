"""Ranked read queries over appearances, season sums, fixtures, players and predictions.

``season=None`` adds all seasons up. Every ranking has a full order, so its first rows are
the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.ordered import asof_join, latest_lists, match_keys, top_n
from touchline.functions.numbers import settle
from touchline.functions.words import normalize_name

# Position order, accepted sort names and what they sort by
POSITION_ORDER = ("GK", "DEF", "MID", "FWD")
SORT_NAMES = {
    "total_points": "total_points",
    "points": "total_points",
    "points_per_game": "points_per_game",
    "goals": "goals",
    "goals_scored": "goals",
    "assists": "assists",
    "bonus": "bonus",
    "bps": "bonus",
}
LEADER_SORTS = ("total_points", "goals", "assists", "clean_sheets", "bonus", "points_per_game", "minutes")
PER_GAME_MIN_MINUTES = 270


def _pick(df: DataFrame, **eq) -> DataFrame:
    for col, val in eq.items():
        if val is not None:
            df = df.filter(F.col(col) == F.lit(val))
    return df


def _zero_sum(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0))


def _per(num: Column, den: str = "games") -> Column:
    return num / F.when(F.col(den) == 0, 1).otherwise(F.col(den))


def position_order(col: str = "position") -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in POSITION_ORDER]), F.col(col))


def player_totals(stats: DataFrame, app: DataFrame | None = None, season: str | None = None, gameweek: int | None = None) -> DataFrame:
    """Per player: points, goals, assists, bonus, games of a season, a gameweek, or everything."""
    if gameweek is not None:
        return _pick(app, GW=gameweek, season=season).groupBy("name").agg(
            _zero_sum("total_points").alias("total_points"),
            _zero_sum("goals_scored").alias("goals"),
            _zero_sum("assists").alias("assists"),
            _zero_sum("bonus").alias("bonus"),
            F.count(F.lit(1)).alias("games"),
        )
    return _pick(stats, season=season).groupBy("name").agg(
        *[_zero_sum(c).alias(c) for c in ("total_points", "goals", "assists", "bonus", "games")]
    )


def top_by_metric(stats: DataFrame, metric: str, out: str, season: str | None = None, limit: int = 10) -> DataFrame:
    """Top scorers or assisters: positive totals, ties by points, then name."""
    t = _pick(stats, season=season).groupBy("name").agg(F.sum(metric).alias(out), F.sum("total_points").alias("total_points"))
    t = t.filter(F.col(out) > 0).withColumnRenamed("name", "player_name")
    return t.orderBy(F.col(out).desc(), F.col("total_points").desc(), "player_name").limit(limit)


def top_by_position(
    stats: DataFrame, players: DataFrame, position: str | None = None, season: str | None = None,
    sort_by: str = "total_points", limit: int = 10,
) -> DataFrame:
    """Season ranking by a chosen metric. Team and position are those of the season; over several
    seasons they fall back to the current ones (``players``: name, position, team)."""
    t = _pick(stats, season=season, position=position).groupBy("name").agg(
        *[_zero_sum(c).alias(c) for c in ("total_points", "goals", "assists", "bonus", "games")],
        F.count(F.lit(1)).alias("__seasons"),
        F.max_by("team", "season").alias("__team"),
        F.max_by("position", "season").alias("__pos"),
    )
    now = players.select("name", F.col("team").alias("__now_team"), F.col("position").alias("__now_pos"))
    t = t.join(now, "name", "left")
    one = F.col("__seasons") == 1
    many_pos = F.lit(position) if position else F.col("__now_pos")
    ppg = _per(F.col("total_points"))
    metric = SORT_NAMES.get(sort_by, "total_points")
    t = t.select(
        F.col("name").alias("player_name"),
        F.when(one, F.col("__pos")).otherwise(many_pos).alias("position"),
        F.when(one, F.col("__team")).otherwise(F.coalesce("__now_team", "__team")).alias("team"),
        "total_points", "goals", "assists", "bonus", "games",
        ppg.alias("__ppg"),
    )
    first = F.col("__ppg") if metric == "points_per_game" else F.col(metric)
    return (
        t.orderBy(first.desc(), F.col("total_points").desc(), "player_name")
        .limit(limit)
        .withColumn("points_per_game", settle("__ppg", 2))
        .drop("__ppg")
    )


def top_by_position_in_gameweek(
    app: DataFrame, players: DataFrame, gameweek: int, position: str | None = None, season: str | None = None,
    sort_by: str = "total_points", limit: int = 10,
) -> DataFrame:
    """The same for one gameweek; the position filter uses the player's current position."""
    t = _pick(app, GW=gameweek, season=season).groupBy("name").agg(
        _zero_sum("total_points").alias("total_points"),
        _zero_sum("goals_scored").alias("goals"),
        _zero_sum("assists").alias("assists"),
        _zero_sum("bonus").alias("bonus"),
        F.count(F.lit(1)).alias("games"),
        F.min_by("team", F.struct("kickoff_time", "fixture", "line")).alias("team"),
    )
    now = _pick(players, position=position).select("name", "position")
    t = t.join(now, "name").withColumn("__ppg", _per(F.col("total_points")))
    metric = SORT_NAMES.get(sort_by, "total_points")
    first = F.col("__ppg") if metric == "points_per_game" else F.col(metric)
    return (
        t.withColumnRenamed("name", "player_name")
        .orderBy(first.desc(), F.col("total_points").desc(), "player_name")
        .limit(limit)
        .withColumn("points_per_game", settle("__ppg", 2))
        .drop("__ppg")
    )


def top_per_position(totals: DataFrame, players: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` players of each position, positions in fixed order."""
    t = totals.join(players.select("name", "position"), "name")
    t = top_n(t, ["position"], [F.col("total_points").desc(), F.col("name")], n)
    return t.select(
        "position", F.col("name").alias("player_name"), "total_points", "goals", "assists", "bonus", "games",
        settle(_per(F.col("total_points")), 2).alias("points_per_game"), "rank_no",
    ).orderBy(position_order(), "rank_no")


def _averages(t: DataFrame) -> DataFrame:
    return t.select(
        F.col("name").alias("player_name"), "season", "team", "position", "games", "total_points", "goals", "assists",
        "clean_sheets", "bonus", "minutes",
        settle(_per(F.col("ict_sum")), 2).alias("avg_ict_index"),
        settle(_per(F.col("value_sum")) / 10, 2).alias("avg_value_millions"),
    )


def player_season(stats: DataFrame, name: str | None = None, season: str | None = None) -> DataFrame:
    """Season sums of a player with averages per game; no name or season means all of them."""
    return _averages(_pick(stats, name=name, season=season))


def player_seasons(stats: DataFrame, name: str) -> DataFrame:
    """One row per season of a player, in order."""
    return _averages(_pick(stats, name=name)).orderBy("season")


def player_career(stats: DataFrame, name: str | None = None) -> DataFrame:
    """Career totals and highest price."""
    t = _pick(stats, name=name).groupBy("name").agg(
        F.count(F.lit(1)).alias("seasons"),
        *[F.sum(c).alias(c) for c in ("total_points", "goals", "assists", "clean_sheets", "bonus", "minutes", "games")],
        F.max("max_value").alias("__v"),
    )
    return t.select(
        F.col("name").alias("player_name"), "seasons", "total_points", "goals", "assists", "clean_sheets", "bonus", "minutes", "games",
        (F.col("__v") / 10).alias("max_value_millions"),
    )


def player_gameweek(app: DataFrame, fixtures: DataFrame, season: str | None = None, gameweek: int | None = None, name: str | None = None) -> DataFrame:
    """A player's rows of a gameweek with the match they come from."""
    a = _pick(app, name=name, season=season, GW=gameweek)
    f = fixtures.select(F.col("id").alias("fixture"), "home_team", "away_team", "home_score", "away_score")
    return a.join(f, "fixture").select(
        F.col("name").alias("player_name"), "fixture", "line", "team", "season", "GW", "total_points", "goals_scored", "assists",
        "minutes", "bonus", "home_team", "away_team", "home_score", "away_score",
    )


def team_top_performers(stats: DataFrame, team: str, season: str | None = None, limit: int = 5) -> DataFrame:
    t = _pick(stats, team=team, season=season).groupBy("name").agg(
        *[F.sum(c).alias(c) for c in ("total_points", "goals", "assists")]
    )
    return t.withColumnRenamed("name", "player_name").orderBy(F.col("total_points").desc(), "player_name").limit(limit)


def team_squad(stats: DataFrame, players: DataFrame, team: str, season: str, current: str, position: str | None = None, limit: int = 40) -> DataFrame:
    """Today's squad with status and news for the current season, else everyone who had the club then."""
    cols = ("total_points", "minutes", "goals", "assists")
    if season == current:
        mine = stats.filter(F.col("season") == season).select("name", *cols, "appearances", F.col("games").alias("__g"))
        t = _pick(players, team=team, position=position).select("name", "position", "status", "news").join(mine, "name", "left")
    else:
        t = _pick(stats, team=team, season=season, position=position).select(
            "name", "position", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("news"),
            *cols, "appearances", F.col("games").alias("__g"),
        )
    return (
        t.select(
            F.col("name").alias("player_name"), "position", F.lit(team).alias("team"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in cols],
            F.coalesce("appearances", "__g", F.lit(0)).alias("games"), "status", "news",
        )
        .orderBy(position_order(), F.col("total_points").desc(), F.col("minutes").desc(), "player_name")
        .limit(limit)
    )


def fixture_results(fixtures: DataFrame, team: str, season: str | None = None) -> DataFrame:
    """Played matches of a team, home or away, by date."""
    f = _pick(fixtures, season=season).filter(
        F.col("home_score").isNotNull() & ((F.col("home_team") == team) | (F.col("away_team") == team))
    )
    return f.select("id", "season", "gameweek", "home_team", "away_team", "home_score", "away_score").orderBy("season", "gameweek", "id")


def head_to_head(fixtures: DataFrame, team1: str, team2: str) -> DataFrame:
    """Played matches between two teams, newest first."""
    h, a = F.col("home_team"), F.col("away_team")
    f = fixtures.filter(F.col("home_score").isNotNull() & (((h == team1) & (a == team2)) | ((h == team2) & (a == team1))))
    return f.select("id", "season", "gameweek", "home_team", "away_team", "home_score", "away_score").orderBy(
        F.col("season").desc(), F.col("gameweek").desc(), "id"
    )


def best_value(stats: DataFrame, players: DataFrame, season: str, position: str | None = None, limit: int = 10) -> DataFrame:
    """Points per million of the average price."""
    t = _pick(stats, season=season).filter((F.col("games") > 0) & (F.col("value_sum") > 0)).drop("position", "team")
    t = t.join(_pick(players, position=position).select("name", "position"), "name")
    avg = F.col("value_sum") / F.col("games")
    ppm = F.col("total_points") * 10 / avg
    return (
        t.select(F.col("name").alias("player_name"), "position", "total_points", (avg / 10).alias("value_millions"), ppm.alias("__p"))
        .orderBy(F.col("__p").desc(), "player_name").limit(limit)
        .withColumn("points_per_million", settle("__p", 2)).drop("__p")
    )


def most_transferred(app: DataFrame, season: str | None, gameweek: int, direction: str = "in", limit: int = 10) -> DataFrame:
    """Most transfers in or out in a gameweek; unknown counts sort as largest."""
    col = "transfers_in" if direction == "in" else "transfers_out"
    return (
        _pick(app, season=season, GW=gameweek)
        .select(F.col("name").alias("player_name"), "fixture", "line", F.col(col).alias("transfers"), F.col("total_points").alias("points"))
        .orderBy(F.col("transfers").desc_nulls_first(), "player_name", "fixture", "line")
        .limit(limit)
    )


def bonus_leaders(stats: DataFrame, season: str, limit: int = 10) -> DataFrame:
    t = _pick(stats, season=season).filter(F.col("bonus") > 0)
    return t.select(
        F.col("name").alias("player_name"), F.col("bonus").alias("total_bonus"), F.col("bps").alias("total_bps"), "games",
        settle(F.col("bonus") / F.col("games"), 2).alias("bonus_per_game"),
    ).orderBy(F.col("total_bonus").desc(), F.col("total_bps").desc(), "player_name").limit(limit)


def clean_sheet_leaders(stats: DataFrame, players: DataFrame, season: str | None = None, position: str | None = None, limit: int = 10) -> DataFrame:
    """Goalkeepers and defenders with most clean sheets."""
    wanted = [position] if position in ("GK", "DEF") else ["GK", "DEF"]
    now = players.filter(F.col("position").isin(wanted)).select("name", "position")
    t = _pick(stats, season=season).drop("position").join(now, "name").groupBy("name", "position").agg(
        F.sum("clean_sheets").alias("total_clean_sheets"), F.sum("total_points").alias("total_points"), F.sum("games").alias("games")
    )
    return (
        t.filter(F.col("total_clean_sheets") > 0)
        .select(F.col("name").alias("player_name"), "position", "total_clean_sheets", "total_points", "games",
                settle(_per(F.col("total_clean_sheets")), 2).alias("clean_sheets_per_game"))
        .orderBy(F.col("total_clean_sheets").desc(), F.col("total_points").desc(), "player_name").limit(limit)
    )


def ict_leaders(stats: DataFrame, players: DataFrame, season: str | None, limit: int = 10, min_apps: int = 10) -> DataFrame:
    """Highest average index over matches actually played."""
    t = _pick(stats, season=season).filter(F.col("appearances") >= min_apps).drop("position").join(players.select("name", "position"), "name")
    a = F.col("appearances")
    return (
        t.select(
            F.col("name").alias("player_name"), "season", "position", (F.col("ict_played_sum") / a).alias("__i"),
            settle(F.col("influence_played_sum") / a, 2).alias("avg_influence"),
            settle(F.col("creativity_played_sum") / a, 2).alias("avg_creativity"),
            settle(F.col("threat_played_sum") / a, 2).alias("avg_threat"), "total_points", a.alias("games"),
        )
        .orderBy(F.round("__i", 9).desc(), "player_name", "season").limit(limit)
        .withColumn("avg_ict_index", settle("__i", 2)).drop("__i")
    )


def most_selected(app: DataFrame, players: DataFrame, season: str | None, gameweek: int, limit: int = 10) -> DataFrame:
    t = _pick(app, season=season, GW=gameweek).drop("position").join(players.select("name", "position"), "name")
    return t.select(
        F.col("name").alias("player_name"), "position", "fixture", "line", "selected", (F.col("value") / 10).alias("value_millions"),
        F.col("total_points").alias("points"),
    ).orderBy(F.col("selected").desc_nulls_first(), "player_name", "fixture", "line").limit(limit)


def compare_players(stats: DataFrame, players: DataFrame, names: Sequence[str], season: str | None = None) -> DataFrame:
    """All sums and averages of the named players side by side."""
    t = _pick(stats, season=season).filter(F.col("name").isin(list(names))).groupBy("name").agg(
        *[F.sum(c).alias(c) for c in ("total_points", "goals", "assists", "clean_sheets", "bonus", "minutes", "ict_sum", "value_sum", "games")]
    )
    t = t.join(players.select("name", "position", "team"), "name", "left")
    return t.select(
        F.col("name").alias("player_name"), "position", "team", "total_points", "goals", "assists", "clean_sheets", "bonus", "minutes", "games",
        settle(F.col("ict_sum") / F.col("games"), 2).alias("avg_ict_index"),
        settle(F.col("value_sum") / 10 / F.col("games"), 2).alias("avg_value_millions"),
    ).orderBy(F.col("total_points").desc(), "player_name")


def form_history(app: DataFrame, name: str | None, season: str | None = None) -> DataFrame:
    """A player's matches in order."""
    return _pick(app, name=name, season=season).select(
        "season", F.col("GW").alias("gameweek"), "fixture", "line", F.col("total_points").alias("points"),
        F.col("goals_scored").alias("goals"), "assists", "minutes",
    ).orderBy("season", "gameweek", "fixture", "line")


def similar_players(stats: DataFrame, players: DataFrame, name: str, season: str | None = None, limit: int = 10) -> DataFrame:
    """Same position, smallest weighted distance on points, goals and assists."""
    t = _pick(stats, season=season).groupBy("name").agg(
        *[F.sum(c).alias(c) for c in ("total_points", "goals", "assists", "bonus", "games")]
    ).join(players.select("name", "position"), "name")
    ref = t.filter(F.col("name") == name).select(  # one row: names are unique
        F.col("position"), F.col("total_points").alias("__p"), F.col("goals").alias("__g"), F.col("assists").alias("__a")
    )
    diff = F.abs(F.col("total_points") - F.col("__p")) + F.abs(F.col("goals") - F.col("__g")) * 10 + F.abs(F.col("assists") - F.col("__a")) * 5
    return (
        t.filter(F.col("name") != name).join(ref, "position")
        .select(F.col("name").alias("player_name"), "position", "total_points", "goals", "assists", "bonus", "games", diff.alias("diff_score"))
        .orderBy("diff_score", "player_name").limit(limit)
    )


def search_players(players: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Names containing the text, without regard to accents and case."""
    needle = normalize_name(F.lit(pattern))
    return players.filter(F.contains(normalize_name(F.col("name")), needle)).select(
        F.col("name").alias("player_name"), "position", F.col("element").alias("element_id"), F.col("team").alias("team_name")
    ).orderBy("player_name").limit(limit)


def all_player_names(players: DataFrame) -> DataFrame:
    return players.select(F.col("name").alias("player_name")).distinct().orderBy("player_name")


def players_by_position(players: DataFrame, position: str) -> DataFrame:
    return _pick(players, position=position).select(F.col("name").alias("player_name"), F.col("element").alias("element_id")).orderBy("player_name")


def all_teams(app: DataFrame) -> DataFrame:
    return app.select(F.col("team").alias("team_name")).distinct().orderBy("team_name")


def seasons_summary(fixtures: DataFrame, stats: DataFrame, season: str | None = None) -> DataFrame:
    """Played gameweeks, matches, goals, points and players of each season."""
    # a gameweek set per season is small: at most one entry per week of the year
    f = _pick(fixtures, season=season).filter(F.col("home_score").isNotNull()).groupBy("season").agg(
        F.size(F.collect_set("gameweek")).cast("long").alias("total_gameweeks"),
        F.count(F.lit(1)).alias("total_fixtures"),
        F.sum(F.col("home_score") + F.col("away_score")).alias("total_goals"),
    )
    s = stats.groupBy("season").agg(_zero_sum("total_points").alias("p"), F.count(F.lit(1)).alias("n"))
    return f.join(s, "season", "left").select(
        "season", "total_gameweeks", "total_fixtures", "total_goals",
        F.coalesce("p", F.lit(0)).alias("total_points"), F.coalesce("n", F.lit(0)).alias("total_players"),
        settle(F.col("total_goals") / F.col("total_fixtures"), 2).alias("goals_per_game"),
    ).orderBy("season")


def highest_gameweek_score(app: DataFrame, season: str | None) -> DataFrame:
    a = _pick(app, season=season).filter(F.col("total_points") > 0)
    return a.select(
        F.col("name").alias("player_name"), "season", F.col("GW").alias("gameweek"), F.col("total_points").alias("points"),
        F.col("goals_scored").alias("goals"), "assists", "bonus", "fixture", "line",
    ).orderBy(F.col("points").desc(), "player_name", "fixture", "line").limit(1)


def most_cards(stats: DataFrame, season: str, card: str = "yellow") -> DataFrame:
    col = "yellow_cards" if card == "yellow" else "red_cards"
    return _pick(stats, season=season).filter(F.col(col) > 0).select(
        F.col("name").alias("player_name"), F.col(col).alias("total_cards")
    ).orderBy(F.col("total_cards").desc(), "player_name").limit(5)


def saves_leaders(stats: DataFrame, players: DataFrame, season: str) -> DataFrame:
    gk = players.filter(F.col("position") == "GK").select("name")
    return _pick(stats, season=season).filter(F.col("saves") > 0).join(gk, "name", "left_semi").select(
        F.col("name").alias("player_name"), F.col("saves").alias("total_saves"), "clean_sheets"
    ).orderBy(F.col("total_saves").desc(), "player_name").limit(5)


def highest_scoring_fixtures(fixtures: DataFrame, season: str | None) -> DataFrame:
    f = _pick(fixtures, season=season).filter(F.col("home_score").isNotNull())
    return f.select(
        "id", "home_team", "away_team", "home_score", "away_score", (F.col("home_score") + F.col("away_score")).alias("total_goals"), "gameweek"
    ).orderBy(F.col("total_goals").desc(), "gameweek", "home_team", "id").limit(5)


def embedding_rows(stats: DataFrame) -> DataFrame:
    """Per-game averages a player-season vector is built from."""
    g = F.col("games")
    return stats.select(
        "name", "season", "position", "total_points", F.col("goals").alias("goals_scored"), "assists", "clean_sheets", "bonus", "bps", "minutes",
        (F.col("ict_sum") / g).alias("ict_index"), (F.col("influence_sum") / g).alias("influence"),
        (F.col("creativity_sum") / g).alias("creativity"), (F.col("threat_sum") / g).alias("threat"),
        (F.col("value_sum") / g).alias("value"), F.col("max_selected").alias("selected"), "saves", "goals_conceded",
        "yellow_cards", "red_cards", "games", "team",
    )


def leaders(
    stats: DataFrame, players: DataFrame, season: str, current: str, sort: str = "total_points", position: str | None = None,
    limit: int = 50, team: str | None = None, max_price: float | None = None,
) -> DataFrame:
    """Season leaders table. Availability describes today and is shown for the current season only."""
    if sort not in LEADER_SORTS:
        raise ValueError(f"sort must be one of {', '.join(LEADER_SORTS)}")
    t = _pick(stats, season=season, position=position)
    t = t.filter(F.col("minutes") >= (PER_GAME_MIN_MINUTES if sort == "points_per_game" else 0))
    if team:
        t = t.filter(F.lower("team") == team.strip().lower())
    t = t.withColumn("__price", F.when(F.col("games") > 0, F.col("value_sum") / 10 / F.col("games")))
    if max_price is not None:
        t = t.filter(F.col("__price") <= max_price + 1e-9)
    t = t.withColumn("games", F.coalesce("appearances", "games")).withColumn(
        "__ppg", F.when(F.col("games") > 0, F.col("total_points") / F.col("games")).otherwise(0.0)
    )
    now = season == current
    t = t.join(players.select("name", F.col("status").alias("__st"), F.col("news").alias("__nw")), "name", "left")
    first = F.col("__ppg") if sort == "points_per_game" else F.col(sort)
    return (
        t.select(
            "name", "team", "position", "games", "minutes", "goals", "assists", "clean_sheets", "bonus", "total_points",
            "__ppg", F.bround("__price", 1).alias("price"),
            (F.col("__st") if now else F.lit(None).cast("string")).alias("status"),
            (F.col("__nw") if now else F.lit(None).cast("string")).alias("news"),
        )
        .orderBy(first.desc(), F.col("total_points").desc(), "name").limit(limit)
        .withColumn("points_per_game", F.bround("__ppg", 2)).drop("__ppg")
    )


def clubs(fixtures: DataFrame, season: str | None = None) -> DataFrame:
    """Distinct clubs that play in a season."""
    f = _pick(fixtures, season=season)
    return f.select("season", F.explode(F.array("home_team", "away_team")).alias("team")).distinct().orderBy("season", "team")


def match_players(app: DataFrame, stats: DataFrame) -> DataFrame:
    """Players of each match with the position they had that season."""
    pos = stats.select("name", "season", F.col("position").alias("season_position"))
    return app.select("fixture", "line", "season", "name", "team", "minutes", "total_points").join(pos, ["name", "season"], "left")


def meetings(fixtures: DataFrame, n: int = 6) -> DataFrame:
    """For each match the latest ``n`` earlier meetings of the two clubs."""
    pair = F.array_join(F.array_sort(F.array("home_team", "away_team")), "|")
    f = fixtures.select("id", "kickoff_time", "home_team", "away_team", "home_score", "away_score", pair.alias("pair"))
    played = f.filter(F.col("home_score").isNotNull())
    recent = latest_lists(played, ["pair"], "kickoff_time", ["id"], ["home_team", "home_score", "away_score"], n, "past")
    hit = asof_join(f.select("id", "kickoff_time", "pair"), recent, "kickoff_time", ["pair"], ["past"])
    return hit.select("id", F.explode("past").alias("m")).select(
        "id", F.col("m.id").alias("earlier_id"), F.col("m.home_team").alias("home_team"),
        F.col("m.home_score").alias("home_score"), F.col("m.away_score").alias("away_score"),
    )


def scorers(app: DataFrame) -> DataFrame:
    """Goals and own goals of matches; an own goal counts for the other side."""
    a = app.filter((F.col("goals_scored") > 0) | (F.col("own_goals") > 0))
    side = F.when(F.col("was_home"), "home").otherwise("away")
    other = F.when(F.col("was_home"), "away").otherwise("home")
    kinds = F.array(
        F.struct(F.lit("goal").alias("kind"), F.col("goals_scored").alias("n"), side.alias("side")),
        F.struct(F.lit("own_goal").alias("kind"), F.col("own_goals").alias("n"), other.alias("side")),
    )
    return a.select("fixture", "name", "line", F.explode(kinds).alias("k")).select("fixture", "name", "line", "k.*").filter(F.col("n") > 0)


def position_pool(stats: DataFrame, name: str, season: str | None = None) -> DataFrame:
    """Everyone with the player's position in the player's seasons."""
    mine = _pick(stats, name=name, season=season).select("season", "position")
    return stats.join(mine, ["season", "position"], "left_semi").select("season", "position", "name", "total_points", "goals", "assists", "minutes")


def expected_goals_by_fixture(app: DataFrame) -> DataFrame:
    """Rounded expected goals per side; sides without data are left out."""
    t = app.groupBy("fixture", "team").agg(F.sum("expected_goals").alias("x"), F.count("expected_goals").alias("n"))
    return t.filter(F.col("n") > 0).select("fixture", "team", settle("x", 2).alias("xg"))


def next_fixture(fixtures: DataFrame, after: str) -> DataFrame:
    """First match of each team after a time."""
    f = fixtures.filter(F.col("kickoff_time") > F.lit(after).cast("timestamp"))
    two = F.array(
        F.struct(F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.lit(True).alias("is_home")),
        F.struct(F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit(False).alias("is_home")),
    )
    f = f.select("id", "kickoff_time", F.explode(two).alias("s")).select("id", "kickoff_time", "s.*")
    best = f.groupBy("team").agg(F.min(F.struct("kickoff_time", "id", "opponent", "is_home")).alias("m"))
    return best.select("team", "m.id", "m.opponent", "m.is_home")


def opponent_strength(tm: DataFrame, until: str, matches: int = 5, default: float = 1.5) -> DataFrame:
    """Mean goals for and against of a team's last matches up to a date; a default when there are none."""
    past = tm.withColumn("__in", F.col("kickoff_time") <= F.lit(until).cast("timestamp"))
    last = top_n(past.filter("__in"), ["team"], [F.col("kickoff_time").desc(), F.col("fixture").desc()], matches)
    means = last.groupBy("team").agg(F.avg("ga").alias("c"), F.avg("gf").alias("s"))
    return tm.select("team").distinct().join(means, "team", "left").select(
        "team", F.coalesce("c", F.lit(default)).alias("avg_conceded"), F.coalesce("s", F.lit(default)).alias("avg_scored")
    )


def random_players(stats: DataFrame, season: str, floor: int = 20, count: int = 4, seed: int = 7) -> DataFrame:
    """A repeatable random choice of players above a points floor: order by a digest of seed and name."""
    s = _pick(stats, season=season).filter(F.col("total_points") >= floor)
    return s.select("name", "position", "total_points").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "name")), "name").limit(count)


def quiz(stats: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Question, answer and explanation per season, from the leader of each ranking."""
    asks = {
        "points": ("total_points", "Who had the most points in %s?", "%s had %d points."),
        "goals": ("goals", "Who scored the most goals in %s?", "%s scored %d goals."),
        "assists": ("assists", "Who gave the most assists in %s?", "%s gave %d assists."),
        "bonus": ("bonus", "Who won the most bonus points in %s?", "%s won %d bonus points."),
        "clean_sheets": ("clean_sheets", "Who kept the most clean sheets in %s?", "%s kept %d clean sheets."),
        "cards": ("yellow_cards", "Who saw the most yellow cards in %s?", "%s saw %d yellow cards."),
    }
    best = stats.groupBy("season").agg(
        *[F.min(F.struct((-F.col(c)).alias("n"), F.col("name").alias("who"))).alias(k) for k, (c, _, _) in asks.items()]
    )
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("category"), F.format_string(q, "season").alias("question"), F.col(f"{k}.who").alias("answer"),
            F.format_string(e, F.col(f"{k}.who"), -F.col(f"{k}.n")).alias("explanation"), (-F.col(f"{k}.n")).alias("n"),
        )
        for k, (_, q, e) in asks.items()
    ])
    people = best.select("season", F.explode(rows).alias("r")).select("season", "r.*").filter(F.col("n") > 0).drop("n")
    goals = F.col("home_score") + F.col("away_score")
    top = fixtures.filter(F.col("home_score").isNotNull()).groupBy("season").agg(
        F.min(F.struct((-goals).alias("n"), F.col("id"), F.col("home_team").alias("h"), F.col("away_team").alias("a"))).alias("m")
    )
    match = top.select(
        "season", F.lit("fixture").alias("category"), F.format_string("Which match of %s had the most goals?", "season").alias("question"),
        F.format_string("%s v %s", "m.h", "m.a").alias("answer"), F.format_string("%s v %s had %d goals.", "m.h", "m.a", -F.col("m.n")).alias("explanation"),
    )
    return people.unionByName(match)


def filter_predictions(pred: DataFrame, position: str | None = None, team: str | None = None, max_price: float | None = None, q: str | None = None) -> DataFrame:
    """Prediction rows by position, club (any case), price and accent-free name text."""
    out = _pick(pred, position=position)
    if team:
        out = out.filter(F.lower("team") == team.strip().lower())
    if max_price is not None:
        out = out.filter(F.col("value") / 10 <= max_price + 1e-9)
    if q:
        out = out.filter(F.contains(normalize_name(F.col("name")), normalize_name(F.lit(q))))
    return out


def top_predicted(pred: DataFrame, limit: int = 10, horizon: int = 1, first_gw: int | None = None, **filters) -> DataFrame:
    """Highest predicted points summed over ``horizon`` gameweeks."""
    p = filter_predictions(pred, **filters)
    if first_gw is not None:
        p = p.filter(F.col("GW").between(first_gw, first_gw + horizon - 1))
    t = p.groupBy("element", "name", "position", "value").agg(F.round(F.sum("predicted_points"), 3).alias("predicted_total"))
    return t.orderBy(F.col("predicted_total").desc(), "element", "value").limit(limit)


def best_value_predicted(pred: DataFrame, limit: int = 10, **filters) -> DataFrame:
    """Predicted points per million."""
    p = filter_predictions(pred, **filters).filter(F.col("value") > 0)
    ppm = F.col("predicted_points") / (F.col("value") / 10)
    return p.select("name", "position", "fixture", "line", "predicted_points", "value", F.round(ppm, 4).alias("points_per_million")).orderBy(
        F.col("points_per_million").desc(), "name", "fixture", "line"
    ).limit(limit)


def tied_leaders(df: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    """All rows that share the group's best value."""
    best = df.groupBy(*group).agg(F.max(metric).alias("__b"))
    return match_keys(df, best, group).filter(F.col(metric) == F.col("__b")).drop("__b")


def top_predicted_per_side(pred: DataFrame, n: int = 3) -> DataFrame:
    """Best predicted players of each side of each match."""
    return top_n(
        pred, ["fixture", "was_home"], [F.col("predicted_points").desc(), F.col("element"), F.col("line")], n
    ).select("fixture", "was_home", "name", "line", "predicted_points", "rank_no")


def season_totals_for(stats: DataFrame, names: DataFrame, season: str) -> DataFrame:
    """This season's totals of a list of players."""
    return _pick(stats, season=season).join(names, "name", "left_semi").select("name", "total_points", "goals", "assists", "minutes", "games")
