"""League tables, gameweek pages, saved squads and their scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numbers import settle
from touchline.functions.ordered import asof_join, latest_lists, match_keys, top_n, trailing_runs

# Statuses and their order, squad rules, awards
STATUSES = ("scheduled", "in_progress", "finished")
STATUS_ORDER = ("i", "s", "d", "u", "n")
POSITIONS = ("GK", "DEF", "MID", "FWD")
SQUAD_SIZE = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}
XI_MIN = {"GK": 1, "DEF": 3, "MID": 2, "FWD": 1}
XI_MAX = {"GK": 1, "DEF": 5, "MID": 5, "FWD": 3}
XI_SIZE = 11
MAX_PER_CLUB = 3
MAX_FREE_TRANSFERS = 5
HIT_COST = 4


def _by_position(values: dict[str, int], col: str = "position") -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(col))


# ------------------------------------------------------------------ fixtures and tables

def clean_fixtures(fixtures: DataFrame) -> DataFrame:
    """Known statuses only, no score before kick-off, and the preliminary schedule dropped for
    every season that has official rows."""
    f = fixtures.filter(F.col("home_team").isNotNull() & F.col("away_team").isNotNull())
    official = f.filter(F.col("source") != "csv").select("season").distinct().withColumn("__has", F.lit(True))
    f = f.join(official, "season", "left").filter(F.col("__has").isNull() | (F.col("source") != "csv")).drop("__has")
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("scheduled")
    hidden = F.col("status") == "scheduled"
    return f.withColumn("status", status).withColumns(
        {c: F.when(~hidden, F.col(c)) for c in ("home_score", "away_score")}
    )


def team_rows(fixtures: DataFrame) -> DataFrame:
    """Two rows per match, one from each side: opponent, goals, result, difficulty."""
    played = F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & (F.col("status") != "scheduled")

    def side(team: str, opp: str, gf: str, ga: str, diff: str, home: bool) -> Column:
        return F.struct(
            F.col(team).alias("team"), F.col(opp).alias("opponent"), F.lit(home).alias("is_home"),
            F.when(played, F.col(gf)).alias("goals_for"), F.when(played, F.col(ga)).alias("goals_against"),
            F.col(diff).alias("difficulty"),
        )

    two = F.array(
        side("home_team", "away_team", "home_score", "away_score", "home_difficulty", True),
        side("away_team", "home_team", "away_score", "home_score", "away_difficulty", False),
    )
    rows = fixtures.select("id", "season", "gameweek", "kickoff_time", "status", F.explode(two).alias("s")).select(
        "id", "season", "gameweek", "kickoff_time", "status", "s.*"
    )
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return rows.withColumn("result", F.when(gf > ga, "W").when(gf == ga, "D").when(gf < ga, "L"))


def _table_sums() -> list[Column]:
    r = F.col("result")
    return [
        F.count("result").alias("played"),
        F.count_if(r == "W").alias("won"), F.count_if(r == "D").alias("drawn"), F.count_if(r == "L").alias("lost"),
        F.coalesce(F.sum("goals_for"), F.lit(0)).alias("goals_for"),
        F.coalesce(F.sum("goals_against"), F.lit(0)).alias("goals_against"),
    ]


def _table_order() -> list[Column]:
    return [F.col("points").desc(), F.col("goal_difference").desc(), F.col("goals_for").desc(), F.col("team")]


def league_table(fixtures: DataFrame, form: int = 5) -> DataFrame:
    """Table per season with the last results (oldest first) and the next match; clubs without a
    played match keep their row."""
    rows = team_rows(fixtures)
    upcoming = F.when(F.col("status") == "scheduled", F.struct("kickoff_time", "id", "opponent", "is_home"))
    t = rows.groupBy("season", "team").agg(*_table_sums(), F.min(upcoming).alias("__next"))
    last = top_n(
        rows.filter(F.col("result").isNotNull()).select("season", "team", "kickoff_time", "id", "result"),
        ["season", "team"], [F.col("kickoff_time").desc(), F.col("id").desc()], form,
    )
    # at most ``form`` results per club
    runs = last.groupBy("season", "team").agg(F.array_sort(F.collect_list(F.struct("kickoff_time", "id", "result"))).alias("__r"))
    runs = runs.select("season", "team", F.array_join(F.transform("__r", lambda x: x["result"]), "").alias("form"))
    t = t.join(runs, ["season", "team"], "left").withColumns({
        "goal_difference": F.col("goals_for") - F.col("goals_against"), "points": F.col("won") * 3 + F.col("drawn"),
    })
    place = F.row_number().over(Window.partitionBy("season").orderBy(*_table_order()))
    return t.select(
        "season", place.alias("position"), "team", "played", "won", "drawn", "lost", "goals_for", "goals_against",
        "goal_difference", "points", F.coalesce("form", F.lit("")).alias("form"),
        F.col("__next.opponent").alias("next_opponent"), F.col("__next.is_home").alias("next_is_home"),
    )


def season_state(fixtures: DataFrame) -> DataFrame:
    """Per season: latest started gameweek, first one with a match to come, the finished ones."""
    gw = fixtures.filter(F.col("gameweek").isNotNull()).groupBy("season", "gameweek").agg(
        F.bool_or(F.col("status").isin("in_progress", "finished")).alias("started"),
        F.bool_and(F.col("status") == "finished").alias("finished"),
        F.bool_or(F.col("status") == "scheduled").alias("coming"),
    )
    done = F.array_sort(F.collect_list(F.when(F.col("finished"), F.col("gameweek"))))
    return gw.groupBy("season").agg(
        F.max(F.when(F.col("started"), F.col("gameweek"))).alias("current_gameweek"),
        F.min(F.when(F.col("coming"), F.col("gameweek"))).alias("next_gameweek"),
        F.array_join(done.cast("array<string>"), ",").alias("finished_gameweeks"),
        F.min("gameweek").alias("__first"), F.max("gameweek").alias("__last"),
    )


def default_gameweek(fixtures: DataFrame) -> DataFrame:
    """The gameweek to show: on the fixtures page the next one, on the gameweek page the current."""
    s = season_state(fixtures)
    fallback = F.when(F.col("next_gameweek").isNotNull(), F.col("__last")).otherwise(F.col("__first"))
    return s.select(
        "season",
        F.coalesce("next_gameweek", "current_gameweek", fallback).alias("fixtures_page"),
        F.coalesce("current_gameweek", "next_gameweek", "__first").alias("gameweek_page"),
    )


def opponents_in_gameweek(fixtures: DataFrame) -> DataFrame:
    """Opponents of each team per gameweek in kick-off order; (H) marks home matches."""
    rows = team_rows(fixtures)
    label = F.concat("opponent", F.when(F.col("is_home"), " (H)").otherwise(" (A)"))
    # a team plays few matches in one gameweek
    ordered = F.array_sort(F.collect_list(F.struct("kickoff_time", "id", label.alias("label"))))
    return rows.groupBy("season", "gameweek", "team").agg(ordered.alias("__o")).select(
        "season", "gameweek", "team", F.array_join(F.transform("__o", lambda x: x["label"]), ", ").alias("opponents")
    )


def fixture_ticker(fixtures: DataFrame, start: int, count: int) -> DataFrame:
    """Difficulty of each club's run of gameweeks, easiest first; clubs without a match stay."""
    rows = team_rows(fixtures)
    inside = F.col("gameweek").between(start, start + count - 1)
    t = rows.groupBy("season", "team").agg(
        F.count_if(inside).alias("fixtures"),
        F.coalesce(F.sum(F.when(inside, F.col("difficulty"))), F.lit(0)).alias("total_difficulty"),
        F.avg(F.when(inside, F.col("difficulty"))).alias("__avg"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(inside, F.struct("gameweek", "kickoff_time", "id", "opponent")))),
            lambda x: F.concat_ws(":", x["gameweek"].cast("string"), x["opponent"])), ",").alias("run"),
    )
    t = t.withColumn("average_difficulty", F.bround("__avg", 2))
    order = [F.coalesce("average_difficulty", F.lit(99.0)), F.col("fixtures").desc(), F.col("team")]
    return t.withColumn("place", F.row_number().over(Window.partitionBy("season").orderBy(*order))).drop("__avg")


def position_history(fixtures: DataFrame) -> DataFrame:
    """Table position of each club after every gameweek with a played match.

    Results are summed per club and gameweek first; a running sum over that small grid gives all
    tables at once, and one ranking per gameweek the positions.
    """
    rows = team_rows(fixtures).filter(F.col("gameweek").isNotNull())
    per = rows.groupBy("season", "team", "gameweek").agg(*_table_sums(), F.count(F.lit(1)).alias("__any"))
    played = per.filter(F.col("played") > 0).groupBy("season").agg(F.array_sort(F.collect_set("gameweek")).alias("__gws"))
    grid = per.select("season", "team").distinct().join(played, "season").select("season", "team", F.explode("__gws").alias("gameweek"))
    # weeks without a played match still count as "has a fixture", so keep both sets of weeks
    full = grid.join(per, ["season", "team", "gameweek"], "full")
    up = Window.partitionBy("season", "team").orderBy("gameweek").rowsBetween(Window.unboundedPreceding, 0)
    cum = full.select(
        "season", "team", "gameweek",
        *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(c) for c in ("played", "won", "drawn", "goals_for", "goals_against", "__any")],
    ).join(grid, ["season", "team", "gameweek"], "left_semi")
    cum = cum.filter(F.col("__any") > 0).withColumns({
        "points": F.col("won") * 3 + F.col("drawn"), "goal_difference": F.col("goals_for") - F.col("goals_against"),
    })
    place = F.row_number().over(Window.partitionBy("season", "gameweek").orderBy(*_table_order()))
    return cum.withColumn("position", place).filter(F.col("played") > 0).select("season", "team", "gameweek", "position", "points")


def team_match_rows(fixtures: DataFrame, xg: DataFrame) -> DataFrame:
    """Each match from each side, with expected goals (``xg``: fixture, team, xg)."""
    own = xg.select(F.col("fixture").alias("id"), "team", F.col("xg").alias("xg_for"))
    opp = xg.select(F.col("fixture").alias("id"), F.col("team").alias("opponent"), F.col("xg").alias("xg_against"))
    return (
        team_rows(fixtures).join(own, ["id", "team"], "left").join(opp, ["id", "opponent"], "left")
        .withColumn("score", F.concat_ws("-", F.col("goals_for").cast("string"), F.col("goals_against").cast("string")))
        .withColumn("score", F.when(F.col("result").isNotNull(), F.col("score")))
    )


def team_summary(matches: DataFrame) -> DataFrame:
    """Season record of each club from ``team_match_rows``."""
    r, home = F.col("result"), F.col("is_home")
    both = F.col("xg_for").isNotNull() & F.col("xg_against").isNotNull()
    margin = F.col("goals_for") - F.col("goals_against")
    best = F.max(F.when(r == "W", F.struct(
        margin.alias("m"), F.col("goals_for").alias("g"), (-F.unix_timestamp("kickoff_time")).alias("k"), (-F.col("id")).alias("i"), "opponent", "score")))
    return matches.filter(r.isNotNull()).groupBy("season", "team").agg(
        F.count(F.lit(1)).alias("played"),
        F.count_if(F.col("goals_against") == 0).alias("clean_sheets"),
        F.count_if(F.col("goals_for") == 0).alias("failed_to_score"),
        settle(F.sum(F.when(both, F.col("xg_for"))), 6).alias("xg_for"),
        settle(F.sum(F.when(both, F.col("xg_against"))), 6).alias("xg_against"),
        F.count_if(both).alias("xg_matches"),
        *[F.count_if((r == x) & (home if at == "home" else ~home)).alias(f"{at}_{n}")
          for at in ("home", "away") for x, n in (("W", "won"), ("D", "drawn"), ("L", "lost"))],
        best.alias("__b"),
    ).withColumn("biggest_win", F.concat_ws(" ", "__b.opponent", "__b.score")).withColumn(
        "biggest_win", F.when(F.col("__b").isNotNull(), F.col("biggest_win"))).drop("__b")


def squad_leaders(stats: DataFrame, players: DataFrame, predicted: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Squad rows with price and prediction, and the club's top ``n`` for each stat."""
    squad = (
        stats.join(players.select("name", (F.col("now_cost") / 10).alias("price"), "web_name"), "name", "left")
        .join(predicted.select("name", "predicted_points"), "name", "left")
    )
    long = squad.unpivot(["season", "team", "name", "position", "total_points", "price", "predicted_points"], list(keys), "stat", "value")
    return top_n(
        long.filter(F.col("value") > 0), ["season", "team", "stat"],
        [F.col("value").desc(), F.col("total_points").desc(), F.col("name")], n,
    )


def form_before(fixtures: DataFrame, n: int = 5) -> DataFrame:
    """For each match and side the results of the side's last ``n`` matches before kick-off."""
    rows = team_rows(fixtures)
    done = rows.filter(F.col("result").isNotNull())
    recent = latest_lists(done, ["team"], "kickoff_time", ["id"], ["result"], n, "past")
    hit = asof_join(rows.select("id", "team", "kickoff_time"), recent, "kickoff_time", ["team"], ["past"])
    return hit.select("id", "team", F.coalesce(F.array_join(F.transform("past", lambda x: x["result"]), ""), F.lit("")).alias("form"))


def started(minutes: str = "minutes", starts: str = "starts") -> Column:
    """Whether a player started; 60 minutes stand in where starts were not recorded."""
    return F.coalesce(F.col(starts) > 0, F.col(minutes) >= 60)


def match_summary(app: DataFrame) -> DataFrame:
    """Events, expected goals, points and line-up sizes per match and side, with the match's best player."""
    def named(col: str, side_ok: Column) -> Column:
        got = F.when((F.col(col) > 0) & side_ok, F.struct((-F.col(col)).alias("n"), "name", "line"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(got)), lambda x: F.concat_ws(":", x["name"], (-x["n"]).cast("string"))), ",")

    own, other = F.col("__own"), ~F.col("__own")
    a = app.withColumn("__s", F.explode(F.array(F.lit(True), F.lit(False))))
    # a row counts for its own side and, for own goals only, for the other side
    a = a.filter(F.col("__s") | (F.col("own_goals") > 0)).withColumn("__own", F.col("__s")).withColumn(
        "side", F.when(F.col("was_home") == F.col("__s"), "home").otherwise("away"))
    st = started()
    sides = a.groupBy("fixture", "side").agg(
        named("goals_scored", own).alias("scorers"), named("assists", own).alias("assists"),
        named("own_goals", other).alias("own_goals_for"), named("yellow_cards", own).alias("yellow_cards"),
        named("red_cards", own).alias("red_cards"),
        settle(F.sum(F.when(own, F.col("expected_goals"))), 6).alias("xg"),
        F.coalesce(F.sum(F.when(own, F.col("total_points"))), F.lit(0)).alias("points"),
        F.count_if(own & st).alias("starters"),
        F.count_if(own & ~st & (F.col("minutes") > 0)).alias("substitutes"),
        F.count_if(own & ~st & (F.col("minutes") == 0)).alias("unused"),
    )
    best = app.groupBy("fixture").agg(F.max(F.struct("total_points", "bps", "name")).alias("__b"))
    return sides.join(best, "fixture").select(*sides.columns, F.when(F.col("__b.total_points") != 0, F.col("__b.name")).alias("top_scorer"))


# ------------------------------------------------------------------ players' availability

def injuries(players: DataFrame) -> DataFrame:
    """Unavailable players: by status, newest news first, then name."""
    rank = F.array_position(F.array(*[F.lit(x) for x in STATUS_ORDER]), F.col("status"))
    rank = F.when(rank == 0, len(STATUS_ORDER) + 1).otherwise(rank).cast("int")
    p = players.filter(F.col("status") != "a").withColumn("status_rank", rank)
    return p.orderBy("status_rank", F.col("news_added").desc_nulls_last(), "name").select("name", "team", "position", "status", "status_rank", "news", "news_added")


def chance_of_playing(status: str = "status", chance: str = "chance_next") -> Column:
    s, c = F.coalesce(F.lower(status), F.lit("a")), F.col(chance)
    return (
        F.when(s.isin("u", "n"), 0.0)
        .when(c.isNotNull(), F.least(F.greatest(c / 100, F.lit(0.0)), F.lit(1.0)))
        .when(s.isin("i", "s"), 0.0).otherwise(1.0)
    )


# ------------------------------------------------------------------ gameweek page

def gameweek_top_scorers(actual: DataFrame, group: Sequence[str] = ("season", "GW"), n: int = 10) -> DataFrame:
    """Best scores: most points, fewest minutes, then id."""
    return top_n(actual, list(group), [F.col("points").desc(), F.col("minutes"), F.col("element")], n)


def bonus_awards(rows: DataFrame, match: Sequence[str] = ("fixture",)) -> DataFrame:
    """3, 2 and 1 points for the best scores of a match; equal scores share a place and push the
    next one down, which is what a competition rank does. A row outside the first three places
    gets 0. The places come from the three best values per match, so no match is sorted whole."""
    known = rows.filter(F.col("bps").isNotNull())
    counts = known.groupBy(*match, "bps").agg(F.count(F.lit(1)).alias("__c"))
    best = top_n(counts, list(match), [F.col("bps").desc()], 3, "__d")
    ahead = F.coalesce(F.sum("__c").over(Window.partitionBy(*match).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    award = best.select(*match, "bps", F.greatest(F.lit(3) - ahead, F.lit(0)).cast("int").alias("award"))
    return match_keys(known, award, [*match, "bps"]).withColumn("award", F.coalesce("award", F.lit(0)))


def score_sums(rows: DataFrame) -> DataFrame:
    """Bonus scores per player and gameweek over a double gameweek."""
    return rows.filter(F.col("bps").isNotNull()).groupBy("season", "GW", "element").agg(F.sum("bps").alias("bps"))


def overlay_live(fixtures: DataFrame, live: DataFrame) -> DataFrame:
    """Scores and status of the live feed laid over stored matches that have started."""
    l = live.select(F.col("id"), F.col("started").alias("__st"), F.col("finished").alias("__fi"), F.col("home_score").alias("__h"), F.col("away_score").alias("__a"))
    on = F.coalesce("__st", F.lit(False))
    return fixtures.join(l, "id", "left").withColumns({
        "status": F.when(on, F.when(F.col("__fi"), "finished").otherwise("in_progress")).otherwise(F.col("status")),
        "home_score": F.when(on, F.col("__h")).otherwise(F.col("home_score")),
        "away_score": F.when(on, F.col("__a")).otherwise(F.col("away_score")),
    }).drop("__st", "__fi", "__h", "__a")


def gameweek_state(fixtures: DataFrame, now: str) -> DataFrame:
    """finished, live or upcoming, from the statuses and the deadline (90 minutes before the first kick-off)."""
    g = fixtures.groupBy("season", "gameweek").agg(
        F.bool_and(F.col("status") == "finished").alias("__all"),
        F.bool_or(F.col("status").isin("in_progress", "finished")).alias("__any"),
        (F.min("kickoff_time") - F.expr("INTERVAL 90 MINUTES")).alias("__deadline"),
    )
    live = (F.lit(now).cast("timestamp") >= F.col("__deadline")) | F.col("__any")
    return g.select("season", "gameweek", F.when(F.col("__all"), "finished").when(live, "live").otherwise("upcoming").alias("state"))


def model_calls(rows: DataFrame, group: Sequence[str], n: int = 3, pool: int = 20) -> DataFrame:
    """Best and worst of the model's highest predictions and the hauls it had low.
    ``rows``: element, predicted, actual."""
    g = list(group)
    gap = F.col("actual") - F.col("predicted")
    backed = top_n(rows, g, [F.col("predicted").desc(), F.col("element")], pool, "__place")
    best = top_n(backed, g, [F.col("actual").desc(), F.col("predicted").desc(), F.col("element")], n).withColumn("call", F.lit("best"))
    worst = top_n(backed.withColumn("__gap", gap), g, [F.col("__gap"), F.col("element")], n).filter(F.col("__gap") < 0).drop("__gap").withColumn("call", F.lit("worst"))
    out = rows.join(backed.select(*g, "element", "__place"), [*g, "element"], "left_anti").withColumn("__gap", gap)
    missed = top_n(out, g, [F.col("__gap").desc(), F.col("element")], n).filter(F.col("__gap") > 0).drop("__gap").withColumn("call", F.lit("missed"))
    cols = [*g, "call", "rank_no", "element", "predicted", "actual"]
    return best.select(cols).unionByName(worst.select(cols)).unionByName(missed.select(cols)).withColumn("gap", settle(gap, 6))


def merge_live(stored: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live points and minutes win over the stored ones."""
    l = live.select(*keys, F.col("points").alias("__p"), F.col("minutes").alias("__m"))
    return stored.join(l, list(keys), "full").select(
        *keys, F.coalesce("__p", "points").alias("points"), F.coalesce("__m", "minutes").alias("minutes")
    )


# ------------------------------------------------------------------ squads

def best_eleven(pool: DataFrame, group: Sequence[str] = ("season", "GW")) -> DataFrame:
    """Best valid eleven of every group at once: the minimum of each position, then the best of
    the rest within the position limits. Groups that cannot field one are left out."""
    g = list(group)
    pos = F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position"))
    ranked = top_n(pool, [*g, "position"], [F.col("points").desc(), F.col("element")], max(XI_MAX.values()), "__r")
    ranked = ranked.filter(F.col("__r") <= _by_position(XI_MAX)).withColumn("__must", F.col("__r") <= _by_position(XI_MIN))
    free = XI_SIZE - sum(XI_MIN.values())
    # at most 14 rows per group remain here
    w = Window.partitionBy(*g, "__must").orderBy(F.col("points").desc(), pos, "element")
    picked = ranked.withColumn("__f", F.row_number().over(w)).filter(F.col("__must") | (F.col("__f") <= free))
    whole = Window.partitionBy(*g)
    return picked.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__m", F.count_if("__must").over(whole)).filter(
        (F.col("__n") == XI_SIZE) & (F.col("__m") == sum(XI_MIN.values()))
    ).drop("__r", "__must", "__f", "__n", "__m")


def captain_pairs(starters: DataFrame, group: Sequence[str] = ("season", "GW")) -> DataFrame:
    """Captain and vice-captain with the highest expected extra points: the captain's, plus the
    vice's when the captain may not play. An eleven gives 110 ordered pairs, so pairs stay few."""
    g = list(group)
    cols = ["element", "points", "p_play", "team", "opponents"]
    c = starters.select(*g, *[F.col(x).alias(f"c_{x}") for x in cols])
    v = starters.select(*g, *[F.col(x).alias(f"v_{x}") for x in cols])
    p = c.join(v, g).filter(F.col("c_element") != F.col("v_element"))
    value = F.round(F.col("c_points") + (1 - F.col("c_p_play")) * F.col("v_points"), 9)
    same = (F.col("c_team") == F.col("v_team")) | F.array_contains("c_opponents", F.col("v_team")) | F.array_contains("v_opponents", F.col("c_team"))
    p = p.withColumn("extra", value).withColumn("__same", ((F.col("c_p_play") < 1) & same).cast("int"))
    best = top_n(p, g, [
        F.col("extra").desc(), F.col("__same"), F.col("c_points").desc(), F.col("c_element"), F.col("v_points").desc(), F.col("v_element")
    ], 1)
    return best.select(*g, F.col("c_element").alias("captain"), F.col("v_element").alias("vice"), F.col("extra").alias("expected_extra_points"))


def squad_from_predictions(pool: DataFrame, group: Sequence[str] = ("season", "GW")) -> DataFrame:
    """Fifteen players per group: the best eleven, and as bench the next best of each position."""
    g = list(group)
    xi = best_eleven(pool, g)
    pairs = captain_pairs(xi, g)
    fifteen = top_n(pool, [*g, "position"], [F.col("points").desc(), F.col("element")], max(SQUAD_SIZE.values()), "__r").filter(
        F.col("__r") <= _by_position(SQUAD_SIZE)
    )
    s = fifteen.join(xi.select(*g, "element", F.lit("starter").alias("role")), [*g, "element"], "left").join(pairs, g)
    s = s.withColumn("role", F.coalesce("role", F.lit("bench")))
    order = F.row_number().over(Window.partitionBy(*g, "role").orderBy(F.col("position") != "GK", F.col("points").desc(), "element"))
    return s.withColumn("slot", order).withColumns({
        "is_captain": F.col("element") == F.col("captain"), "is_vice": F.col("element") == F.col("vice"),
    }).drop("captain", "vice", "__r", "expected_extra_points")


def _substitutions(squad: Column) -> Column:
    """The elements that leave and enter a squad's eleven. ``squad`` is its array of players in slot order.

    Every starter who did not play is replaced by the first free bench player who may stand in for him:
    a goalkeeper for a goalkeeper, and with enough players left in each line. A player whose match is
    open keeps the place open.
    """
    bench = F.filter(squad, lambda x: x["role"] == "bench")
    eleven = F.filter(squad, lambda x: x["role"] == "starter")
    lines = [p for p in XI_MIN if p != "GK"]

    def replace(done: Column, gone: Column) -> Column:
        def fits(sub: Column) -> Column:
            same = (sub["position"] == "GK") == (gone["position"] == "GK")
            enough = [done[p] - (gone["position"] == p).cast("int") + (sub["position"] == p).cast("int") >= XI_MIN[p] for p in lines]
            return reduce(lambda a, b: a & b, enough, same & (sub["played"] != "no") & ~F.array_contains(done["enter"], sub["element"]))

        sub = F.get(F.filter(bench, fits), F.lit(0))
        comes = F.coalesce(sub["played"] == "yes", F.lit(False))
        after = [F.when(comes, done[p] - (gone["position"] == p).cast("int") + (sub["position"] == p).cast("int")).otherwise(done[p]).alias(p) for p in lines]
        return F.struct(
            *after, F.when(comes, F.array_append(done["leave"], gone["element"])).otherwise(done["leave"]).alias("leave"),
            F.when(comes, F.array_append(done["enter"], sub["element"])).otherwise(done["enter"]).alias("enter"),
        )

    nobody = F.filter(F.transform(squad, lambda x: x["element"]), lambda _: F.lit(False))

    def held(line: str) -> Column:
        return F.size(F.filter(eleven, lambda x: x["position"] == line)).alias(line)

    start = F.struct(*[held(p) for p in lines], nobody.alias("leave"), nobody.alias("enter"))
    return F.aggregate(F.filter(eleven, lambda x: x["played"] == "no"), start, replace)


def score_squads(squads: DataFrame, actual: DataFrame, group: Sequence[str], finished: Column | None = None) -> DataFrame:
    """Score saved squads with automatic substitutions and the armband.

    ``squads``: group, element, position, role, slot, is_captain, is_vice and optionally chip,
    hit_cost; ``actual``: group's gameweek columns, element, points, minutes. A player without
    an actual row did not play when the gameweek is over and is open otherwise.
    """
    g = list(group)
    gw = [c for c in g if c in actual.columns]
    over = finished if finished is not None else F.lit(True)
    s = squads
    for col, default in (("chip", F.lit("")), ("hit_cost", F.lit(0))):
        if col not in s.columns:
            s = s.withColumn(col, default)
    s = s.join(actual.select(*gw, "element", F.col("points").alias("scored"), "minutes"), [*gw, "element"], "left")
    s = s.withColumn("played", F.when(F.col("minutes") > 0, "yes").when(over, "no").otherwise("open"))
    cols = [*g, "element", "position", "role", "slot", "is_captain", "is_vice", "chip", "hit_cost", "scored", "played"]
    s = s.select(cols)
    own = [c for c in cols if c not in g]
    squad = s.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("slot", "element", *[c for c in own if c not in ("slot", "element")]))).alias("squad"))  # 15 players
    swapped = squad.withColumn("swaps", _substitutions(F.col("squad")))
    player = swapped.select(*g, "swaps", F.explode("squad").alias("x")).select(*g, "x.*", "swaps")
    left, entered = F.array_contains("swaps.leave", F.col("element")), F.array_contains("swaps.enter", F.col("element"))
    counts = (F.col("chip") == "bboost") | ((F.col("role") == "starter") & ~left) | ((F.col("role") != "starter") & entered)
    done = player.withColumn("counts", F.coalesce(counts, F.lit(False))).drop("swaps")
    cap_out = F.bool_or(F.col("is_captain") & (F.col("played") == "no"))
    vice_ok = F.bool_or(F.col("is_vice") & (F.col("played") != "no"))
    per = done.groupBy(*g).agg(
        F.sum(F.when(F.col("counts"), F.coalesce("scored", F.lit(0))).otherwise(0)).alias("base"),
        F.sum(F.when(~F.col("counts"), F.coalesce("scored", F.lit(0))).otherwise(0)).alias("bench_points"),
        F.sum(F.when(F.col("is_captain"), F.coalesce("scored", F.lit(0))).otherwise(0)).alias("__c"),
        F.sum(F.when(F.col("is_vice"), F.coalesce("scored", F.lit(0))).otherwise(0)).alias("__v"),
        cap_out.alias("__out"), vice_ok.alias("__ok"),
        F.count_if(F.col("counts") & (F.col("role") == "bench")).alias("auto_subs"),
        F.max("chip").alias("chip"), F.max("hit_cost").alias("hit_cost"),
    )
    extra = F.when(~F.col("__out"), F.col("__c")).when(F.col("__ok"), F.col("__v")).otherwise(0)
    times = F.when(F.col("chip") == "3xc", 2).otherwise(1)
    return per.select(
        *g, "chip", "hit_cost", "bench_points", "auto_subs", (F.col("base") + extra * times).alias("gross"),
        (F.col("base") + extra * times - F.col("hit_cost")).alias("points"),
    )


def compare_squads(live: DataFrame, shadow: DataFrame, live_score: DataFrame, shadow_score: DataFrame, group: Sequence[str]) -> DataFrame:
    """Difference between two squads of a gameweek and how many players they share."""
    g = list(group)
    a = live.groupBy(*g).agg(F.collect_set("element").alias("__a"))  # fifteen players
    b = shadow.groupBy(*g).agg(F.collect_set("element").alias("__b"))
    return (
        live_score.select(*g, F.col("points").alias("live_points"))
        .join(shadow_score.select(*g, F.col("points").alias("shadow_points")), g)
        .join(a, g).join(b, g)
        .select(*g, "live_points", "shadow_points", (F.col("live_points") - F.col("shadow_points")).alias("difference"),
                F.size(F.array_intersect("__a", "__b")).alias("shared_players"))
    )


def shadow_ledger(rows: DataFrame, season: str = "season", gw: str = "GW") -> DataFrame:
    """Comparison rows with the running difference over the gameweeks that count."""
    counted = (F.col("status") == "finished") & (F.coalesce(F.col("live_model") != F.col("shadow_model"), F.lit(True))) & F.coalesce("same_run", F.lit(True))
    up = Window.partitionBy(season).orderBy(gw).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("counted", counted)
    return r.withColumn("running", F.when(F.col("counted"), F.sum(F.when(F.col("counted"), F.col("difference"))).over(up)))


def unpaired_gameweeks(live: DataFrame, shadow: DataFrame, season: str = "season", gw: str = "GW") -> DataFrame:
    """Gameweeks since the first shadow pick that only one of the two has."""
    first = shadow.groupBy(season).agg(F.min(gw).alias("__f"))
    l, s = live.select(season, gw).distinct(), shadow.select(season, gw).distinct()
    odd = l.join(s, [season, gw], "left_anti").unionByName(s.join(l, [season, gw], "left_anti"))
    return odd.join(first, season).filter(F.col(gw) >= F.col("__f")).drop("__f")


def entry_totals(results: DataFrame, averages: DataFrame, manager: Sequence[str], gw: str = "GW") -> DataFrame:
    """Running total of an entry and its difference to the gameweek average."""
    up = Window.partitionBy(*manager).orderBy(gw).rowsBetween(Window.unboundedPreceding, 0)
    keys = [c for c in (*manager, gw) if c in averages.columns]
    return results.join(averages, keys, "left").withColumn("total", F.sum("points").over(up)).withColumn(
        "vs_average", F.col("points") - F.col("gw_average"))


# ------------------------------------------------------------------ transfers and prices

def free_transfers(history: DataFrame, manager: Sequence[str], rules_max: int = MAX_FREE_TRANSFERS, hit: int = HIT_COST) -> DataFrame:
    """Free transfers after the last gameweek of each manager.

    ``history``: manager, GW, made, cost, chip. A manager has one row per gameweek, so the fold
    runs over a short sorted array; weeks without a row made no transfer.
    """
    rows = history.groupBy(*manager).agg(
        F.map_from_entries(F.collect_list(F.struct("GW", F.struct("made", "cost", "chip").alias("r")))).alias("__m"),
        F.min("GW").alias("__first"), F.max("GW").alias("__last"),
    )

    def step(free: Column, gw: Column) -> Column:
        r = F.try_element_at("__m", gw)
        made, cost = F.coalesce(r["made"], F.lit(0)), F.coalesce(r["cost"], F.lit(0))
        keeps = F.coalesce(r["chip"].isin("wildcard", "freehit"), F.lit(False))
        hits = F.floor(cost / hit).cast("int")
        used = F.greatest(made - hits, F.lit(0))
        had = F.when(hits > 0, used).when(made > free, made).otherwise(free)
        left = F.when(keeps, free).otherwise(F.greatest(had - used, F.lit(0)))
        return F.greatest(F.lit(1), F.least(left + 1, F.lit(rules_max))).cast("int")

    weeks = F.when(F.col("__last") > F.col("__first"), F.sequence(F.col("__first") + 1, F.col("__last"))).otherwise(F.array().cast("array<int>"))
    return rows.select(*manager, F.aggregate(weeks, F.lit(1), step).alias("free_transfers"))


def purchase_prices(squad: DataFrame, transfers: DataFrame, start_prices: DataFrame, now: DataFrame, manager: str, free_hits: DataFrame) -> DataFrame:
    """Price paid: latest transfer in outside free-hit weeks, else the first squad's price, else today's."""
    t = transfers.join(free_hits, [manager, "GW"], "left_anti")
    latest = t.groupBy(manager, "element").agg(F.max_by("cost", F.struct("time", "tie")).alias("__t"))
    return (
        squad.join(latest, [manager, "element"], "left")
        .join(start_prices.select(manager, "element", F.col("price").alias("__s")), [manager, "element"], "left")
        .join(now.select("element", F.col("now_cost").alias("__n")), "element", "left")
        .select(
            manager, "element", F.coalesce("__t", "__s", "__n", F.lit(0)).alias("price"),
            F.when(F.col("__t").isNotNull(), "transfer").when(F.col("__s").isNotNull(), "first squad").otherwise("estimate").alias("source"),
        )
    )


def prices_at(app: DataFrame, gameweek: int) -> DataFrame:
    """Price of each player in a gameweek, or the last one before it."""
    a = app.filter((F.col("GW") <= gameweek) & F.col("value").isNotNull())
    return a.groupBy("season", "element").agg(F.max_by("value", F.struct("GW", "kickoff_time", "fixture", "line")).alias("price"))


def projected_by_element(proj: DataFrame, first_gw: int, horizon: int) -> DataFrame:
    """Projected points per player over the first gameweeks of a projection run, blanks as 0.
    A run that starts at another gameweek is stale and gives nothing."""
    weeks = proj.groupBy("season").agg(F.slice(F.array_sort(F.collect_set("GW")), 1, horizon).alias("__w"))
    weeks = weeks.filter(F.element_at("__w", 1) == first_gw)
    sums = proj.groupBy("season", "element", "GW").agg(F.sum("predicted_points").alias("__p"))
    grid = proj.select("season", "element").distinct().join(weeks, "season").select("season", "element", F.explode("__w").alias("GW"))
    return grid.join(sums, ["season", "element", "GW"], "left").withColumn("points", settle(F.coalesce("__p", F.lit(0.0)), 2)).drop("__p")


def template_squad(pool: DataFrame, group: Sequence[str], cap: int = MAX_PER_CLUB) -> DataFrame:
    """Most-owned legal squad of each group, skipping players of clubs that are full.

    Only the first ``cap`` players of a club in a position can be chosen, and at most
    15 / cap clubs can be full, so the best size + 15 of those per position decide the result:
    the ordered choice runs over at most 75 rows per group.
    """
    g = list(group)
    order = [F.col("ownership").desc(), F.col("points").desc(), F.col("element")]
    per_club = top_n(pool.filter(F.col("ownership").isNotNull()), [*g, "position", "team"], order, cap, "__c").drop("__c")
    deep = max(SQUAD_SIZE.values()) + sum(SQUAD_SIZE.values())
    short = top_n(per_club, [*g, "position"], order, deep, "place").select(*g, "position", "element", "team", "ownership", "place")

    turn = F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position")).alias("turn")
    fields = ["position", "element", "team", "ownership"]
    listed = short.filter(F.col("position").isin(*POSITIONS)).groupBy(*g).agg(F.array_sort(F.collect_list(F.struct(turn, "place", *fields))).alias("list"))

    def pick(chosen: Column, x: Column) -> Column:
        same = lambda field: F.size(F.filter(chosen, lambda c: c[field].eqNullSafe(x[field])))
        room = same("position") < F.element_at(F.create_map(*[F.lit(v) for kv in SQUAD_SIZE.items() for v in kv]), x["position"])
        return F.when(room & (same("team") < cap), F.array_append(chosen, x)).otherwise(chosen)

    chosen = listed.select(*g, F.aggregate("list", F.filter("list", lambda _: F.lit(False)), pick).alias("chosen"))
    whole = chosen.filter(F.size("chosen") == sum(SQUAD_SIZE.values()))
    return whole.select(*g, F.explode("chosen").alias("x")).select(*g, *[f"x.{c}" for c in fields])


def win_runs(rows: DataFrame) -> DataFrame:
    """Current runs of each club in a season: wins, unbeaten, losses, winless (rows of ``team_rows``)."""
    r = F.col("result")
    tests = {"won": r == "W", "unbeaten": r != "L", "lost": r == "L", "winless": r != "W"}
    return trailing_runs(rows.filter(r.isNotNull()), ["season", "team"], ["kickoff_time", "id"], tests)
