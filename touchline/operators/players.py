"""Player pages: points breakdown, profiles, streaks, ranks, insight tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numbers import settle
from touchline.functions.ordered import match_keys, top_n, trailing_runs, value_bin, value_positions, value_ranks
from touchline.operators.league import chance_of_playing

# Scoring rules, ownership bands, price caps (tenths of a million)
GOAL_POINTS = {"GK": 6, "DEF": 6, "MID": 5, "FWD": 4}
CLEAN_SHEET_POINTS = {"GK": 4, "DEF": 4, "MID": 1, "FWD": 0}
DC_THRESHOLD = {"DEF": 10, "MID": 12, "FWD": 12}
BUDGET_CAPS = {"GK": 45, "DEF": 45, "MID": 55, "FWD": 60}
DIFFERENTIAL_BELOW = 10.0
TEMPLATE_FROM = 25.0
HAUL_POINTS = 10
BLANK_POINTS = 2
PARTS = ("appearance", "goals", "assists", "clean_sheets", "saves", "defensive", "bonus", "conceded", "cards")


def per_position(values: dict[str, int], col: str = "position") -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(col))


def points_breakdown(app: DataFrame) -> DataFrame:
    """Where each match's points came from; what the rules do not explain is ``other``."""
    pos = F.coalesce("position", F.lit("MID"))
    full = F.col("minutes") >= 60
    dc = F.col("defensive_contribution")
    parts = {
        "appearance": F.when(full, 2).otherwise(1),
        "goals": F.col("goals_scored") * per_position(GOAL_POINTS),
        "assists": F.col("assists") * 3,
        "clean_sheets": F.when(full, F.col("clean_sheets") * per_position(CLEAN_SHEET_POINTS)).otherwise(0),
        "saves": F.when(pos == "GK", F.floor(F.col("saves") / 3)).otherwise(0),
        "defensive": F.when(dc >= per_position(DC_THRESHOLD), 2).otherwise(0),
        "bonus": F.col("bonus"),
        "conceded": F.when(pos.isin("GK", "DEF"), -F.floor(F.col("goals_conceded") / 2)).otherwise(0),
        "cards": -F.col("yellow_cards") - F.col("red_cards") * 3,
    }
    on = F.col("minutes") > 0
    named = {f"p_{k}": F.when(on, F.coalesce(v, F.lit(0))).otherwise(0).cast("long") for k, v in parts.items()}
    out = app.withColumns(named)
    rest = F.col("total_points") - reduce(lambda a, b: a + b, [F.col(f"p_{k}") for k in PARTS])
    return out.withColumn("p_other", rest.cast("long"))


def profile_totals(app: DataFrame, keys: Sequence[str], min_minutes: int = 90) -> DataFrame:
    """Sums (optional ones stay null when never recorded) and rates per 90 minutes."""
    sums = ["total_points", "minutes", "goals_scored", "assists", "bps", "saves"]
    optional = ["starts", "expected_goals", "expected_assists", "defensive_contribution"]
    t = app.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.sum(c).alias(c) for c in optional],
        F.count_if(F.col("minutes") > 0).alias("appearances"),
    )
    rates = ["total_points", "goals_scored", "expected_goals", "assists", "bps"]
    enough = F.col("minutes") >= min_minutes
    return t.select("*", *[F.when(enough, settle(F.col(c) / F.col("minutes") * 90, 6)).alias(f"{c}_per_90") for c in rates])


def match_view(app: DataFrame) -> DataFrame:
    """Match rows with opponent, score and result from the player's side."""
    home = F.col("was_home")
    own, other = F.when(home, F.col("team_h_score")).otherwise(F.col("team_a_score")), F.when(home, F.col("team_a_score")).otherwise(F.col("team_h_score"))
    a = app.withColumns({"opponent": F.when(home, F.col("away_team")).otherwise(F.col("home_team")), "team_score": own, "opponent_score": other})
    s, o = F.col("team_score"), F.col("opponent_score")
    return a.withColumn("result", F.when(s > o, "W").when(s == o, "D").when(s < o, "L"))


def price_trend(app: DataFrame) -> DataFrame:
    """Price and ownership change between a player's first and last gameweek of a season, each
    taken at the gameweek's last match; players with one gameweek are left out."""
    known = app.filter(F.col("value").isNotNull())
    order = F.struct("kickoff_time", "fixture", "line")
    per = known.groupBy("season", "element", "GW").agg(F.max_by(F.struct("value", "selected"), order).alias("v"))
    t = per.groupBy("season", "element").agg(
        F.count(F.lit(1)).alias("gameweeks"), F.min_by("v", "GW").alias("a"), F.max_by("v", "GW").alias("b")
    ).filter(F.col("gameweeks") >= 2)
    return t.select(
        "season", "element", "gameweeks", (F.col("a.value") / 10).alias("first_price"), (F.col("b.value") / 10).alias("last_price"),
        F.round((F.col("b.value") - F.col("a.value")) / 10, 1).alias("price_change"),
        (F.col("b.selected") - F.col("a.selected")).alias("selected_change"),
    )


def underlying(app: DataFrame) -> DataFrame:
    """Expected against real goals and assists per season; seasons without expected stats are left out."""
    xg, xa = F.coalesce("expected_goals", F.lit(0.0)), F.coalesce("expected_assists", F.lit(0.0))
    on = F.col("minutes") > 0
    t = app.groupBy("season", "element").agg(
        F.count(F.coalesce("expected_goals", "expected_assists")).alias("__n"), F.sum("minutes").alias("minutes"),
        F.sum(xg).alias("xg"), F.sum(xa).alias("xa"), F.sum(xg + xa).alias("xgi"),
        F.sum("goals_scored").alias("goals"), F.sum("assists").alias("assists"),
        F.coalesce(F.sum(F.when(on, F.col("expected_goals_conceded"))), F.lit(0.0)).alias("xgc"),
        F.coalesce(F.sum(F.when(on, F.col("goals_conceded"))), F.lit(0)).alias("goals_conceded"),
    ).filter(F.col("__n") > 0)
    rate = lambda c: F.when(F.col("minutes") >= 90, settle(F.col(c) * 90 / F.col("minutes"), 2)).alias(f"{c}_per_90")
    return t.select(
        "season", "element", "minutes", *[settle(c, 2).alias(c) for c in ("xg", "xa", "xgi", "xgc")], "goals", "assists", "goals_conceded",
        *[rate(c) for c in ("xg", "xa", "xgi")],
    )


def competition_ranks(df: DataFrame, group: Sequence[str], value: str, out: str = "place") -> DataFrame:
    """Ranks 1, 1, 3 by falling value: one more than the number of rows above."""
    r = value_ranks(df, group, value, "__v")
    return r.withColumn(out, F.col("__v_n") - F.col("__v_lt") - F.col("__v_eq") + 1).drop("__v_lt", "__v_eq", "__v_n")


def position_rank(stats: DataFrame) -> DataFrame:
    """Rank by points among a season's players of the same position, pool size and the rival to
    compare with: the pool's leader, or the runner-up for the leader."""
    g = ["season", "position"]
    ranked = value_ranks(stats.select(*g, "name", "total_points"), g, "total_points", "v")
    two = top_n(stats.select(*g, "name", "total_points"), g, [F.col("total_points").desc(), F.col("name")], 2)
    two = two.groupBy(*g).agg(
        F.max(F.when(F.col("rank_no") == 1, F.col("name"))).alias("__one"), F.max(F.when(F.col("rank_no") == 2, F.col("name"))).alias("__two")
    )
    return match_keys(ranked, two, g).select(
        *g, "name", "total_points", (F.col("v_n") - F.col("v_lt") - F.col("v_eq") + 1).alias("place"), F.col("v_n").alias("pool"),
        F.when(F.col("name") == F.col("__one"), F.col("__two")).otherwise(F.col("__one")).alias("rival"),
    )


def head_to_head_records(fixtures: DataFrame) -> DataFrame:
    """Record of each club against each opponent, with the biggest win and the current runs."""
    from touchline.operators.league import team_rows

    rows = team_rows(fixtures).filter(F.col("result").isNotNull())
    keys = ["team", "opponent"]
    margin = F.col("goals_for") - F.col("goals_against")
    r = F.col("result")
    rec = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("played"), *[F.count_if(r == x).alias(n) for x, n in (("W", "won"), ("D", "drawn"), ("L", "lost"))],
        F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"),
        F.max(F.when(r == "W", F.struct(margin.alias("m"), "kickoff_time", "id"))).alias("__b"),
    )
    order = ["kickoff_time", "id"]
    rec = match_keys(rec, trailing_runs(rows, keys, order, {"unbeaten": r != "L", "winless": r != "W"}), keys)
    return rec.select(*[c for c in rec.columns if c != "__b"], F.col("__b.m").alias("biggest_margin"), F.col("__b.id").alias("biggest_win_id"))


def prediction_ranks(pred: DataFrame, group: Sequence[str] = ("season", "GW")) -> DataFrame:
    """Rank of each prediction overall and within its position."""
    g = list(group)
    a = value_ranks(pred, g, "predicted", "a")
    b = value_ranks(a, [*g, "position"], "predicted", "b")
    above = lambda p: (F.col(f"{p}_n") - F.col(f"{p}_lt") - F.col(f"{p}_eq") + 1)
    return b.select(
        *g, "element", "position", "predicted", above("a").alias("place"), F.col("a_n").alias("pool"),
        above("b").alias("position_place"), F.col("b_n").alias("position_pool"),
    )


def ownership_tag(col: str = "selected_by_percent") -> Column:
    c = F.col(col)
    return F.when(c < DIFFERENTIAL_BELOW, "differential").when(c >= TEMPLATE_FROM, "template").when(c.isNotNull(), "safe")


def insight_table(pred: DataFrame, status: DataFrame, horizon_points: DataFrame | None = None) -> DataFrame:
    """One row per player: predictions of a double gameweek summed, joined to the current state."""
    p = pred.groupBy("element").agg(F.sum("predicted_points").alias("__p"), F.count(F.lit(1)).alias("fixtures"))
    t = p.join(status, "element", "left")
    if horizon_points is not None:
        t = t.join(horizon_points.select("element", F.col("points").alias("points_4gw")), "element", "left")
    else:
        t = t.withColumn("points_4gw", F.lit(None).cast("double"))
    price = F.bround(F.col("now_cost") / 10, 1)
    per_million = lambda c: F.when(F.col("price") > 0, settle(F.col(c) / F.col("price"), 2))
    return t.withColumns({"predicted_points": settle("__p", 2), "price": price}).select(
        "element", "name", "web_name", "team", "position", "predicted_points", "fixtures", chance_of_playing().alias("chance_of_playing"),
        "status", "news", "selected_by_percent", ownership_tag().alias("ownership"), "price", "points_4gw",
        per_million("predicted_points").alias("points_per_m"), per_million("points_4gw").alias("points_per_m_4gw"),
    )


def _by_points() -> list[Column]:
    return [F.col("predicted_points").desc(), F.col("name")]


def captain_options(table: DataFrame, limit: int = 10, pool: int = 12) -> DataFrame:
    """Top options and the captain and vice chosen from the best ``pool`` players."""
    from touchline.operators.league import captain_pairs

    best = table.filter(F.col("predicted_points") > 0).orderBy(*_by_points()).limit(max(limit, pool)).withColumn("__g", F.lit(1))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("__g").orderBy(*_by_points())))
    cands = ranked.select(
        "__g", "element", F.col("predicted_points").alias("points"), F.col("chance_of_playing").alias("p_play"), "team",
        F.array().cast("array<string>").alias("opponents"),
    )
    pair = captain_pairs(cands, ["__g"])
    role = F.when(F.col("element") == F.col("captain"), "captain").when(F.col("element") == F.col("vice"), "vice")
    return ranked.join(pair, "__g").withColumn("role", role).filter((F.col("place") <= limit) | F.col("role").isNotNull()).select(
        "place", "element", "name", "predicted_points", "role", settle("expected_extra_points", 2).alias("expected_extra_points")
    )


def differentials(table: DataFrame, position: str | None = None, max_ownership: float = DIFFERENTIAL_BELOW, limit: int = 20) -> DataFrame:
    t = table.filter((F.col("selected_by_percent") < max_ownership) & (F.col("predicted_points") > 0))
    if position:
        t = t.filter(F.col("position") == position)
    return t.orderBy(*_by_points()).limit(limit)


def budget_picks(table: DataFrame, n: int = 5) -> DataFrame:
    """Best predicted players within the cheapest price band of each position."""
    t = table.filter((F.col("price") <= per_position(BUDGET_CAPS) / 10 + 1e-9) & (F.col("predicted_points") > 0))
    return top_n(t, ["position"], _by_points(), n)


def transfer_summary(status: DataFrame, limit: int = 15) -> DataFrame:
    """Most transferred in and out, price risers and fallers."""
    def ranked(kind: str, value: Column, order: list[Column]) -> DataFrame:
        t = status.withColumn("amount", value).filter(F.col("amount").isNotNull() & (F.col("amount") != 0))
        top = t.orderBy(*order).limit(limit)
        w = Window.partitionBy(F.lit(1)).orderBy(*order)  # over ``limit`` rows
        return top.withColumn("place", F.row_number().over(w)).select(F.lit(kind).alias("kind"), "place", "name", F.col("amount").cast("double").alias("amount"))

    change = F.col("cost_change_event")
    moves = [F.col("amount").desc(), F.col("name")]
    prices = [F.abs("amount").desc(), F.col("selected_by_percent").desc_nulls_last(), F.col("name")]
    return (
        ranked("in", F.col("transfers_in_event"), moves)
        .unionByName(ranked("out", F.col("transfers_out_event"), moves))
        .unionByName(ranked("riser", F.when(change > 0, change / 10), prices))
        .unionByName(ranked("faller", F.when(change < 0, change / 10), prices))
    )


def set_piece_takers(status: DataFrame) -> DataFrame:
    """Takers of each set piece per club, first choice first."""
    long = status.unpivot(["team", "name"], ["penalties_order", "freekicks_order", "corners_order"], "kind", "choice").filter(F.col("choice") > 0)
    # listed takers only: a handful per club
    t = long.groupBy("team", "kind").agg(F.array_sort(F.collect_list(F.struct("choice", "name"))).alias("l"))
    return t.select("team", "kind", F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["choice"].cast("string"), x["name"])), ", ").alias("takers"))


def top_by_fixture(pred: DataFrame, n: int = 3) -> DataFrame:
    """Top players of each match over both sides, players predicted nothing left out."""
    t = pred.filter(F.col("predicted_points") > 0)
    return top_n(t, ["fixture", "home_team", "away_team"], [F.col("predicted_points").desc(), F.col("name"), F.col("line")], n)


def player_runs(weeks: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """Best totals over the projected gameweeks, with the points of each week in order."""
    t = weeks.groupBy("season", "element").agg(
        F.round(F.sum("points"), 2).alias("total"), F.array_sort(F.collect_list(F.struct("GW", "points"))).alias("w")
    )
    t = top_n(t, ["season"], [F.col("total").desc(), F.col("element")], limit).join(names, "element")
    return t.select("season", "element", "name", "total", "rank_no", F.array_join(F.transform("w", lambda x: x["points"].cast("string")), " ").alias("weeks"))


def promoted_teams(app: DataFrame) -> DataFrame:
    """Clubs of a season that were not there in the season before."""
    t = app.select("season", "team").distinct()
    year = F.substring("season", 1, 4).cast("int")
    before = t.select((year + 1).alias("y"), "team")
    first = t.agg(F.min(year).alias("f"))
    now = t.withColumn("y", year).join(before, ["y", "team"], "left_anti")
    return now.join(first, now["y"] > first["f"]).select("season", "team")


def ownership_ranking(status: DataFrame) -> DataFrame:
    """Players by ownership within their position."""
    s = status.filter(F.col("selected_by_percent").isNotNull()).select("element", "name", "position", F.round("selected_by_percent", 1).alias("selected_by_percent"))
    return value_positions(s, ["position"], "selected_by_percent", False, ["element"], value_bin("element"), "place")


def most_common_value(df: DataFrame, col: str) -> DataFrame:
    """The most frequent value, the smallest on ties."""
    n = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), F.col(col)).limit(1)


def player_highlights(app: DataFrame) -> DataFrame:
    """Current runs, best haul, best season, recent form and big scores of each player."""
    key, order = ["element"], ["kickoff_time", "fixture", "line"]
    on = app.filter(F.col("minutes") > 0)
    g, a = F.col("goals_scored"), F.col("assists")
    out = app.groupBy("element").agg(
        F.max(F.struct("total_points", *order)).alias("__best"),
        F.count_if(F.col("total_points") >= HAUL_POINTS).alias("big_scores"),
        F.count_if(F.col("minutes") > 0).alias("appearances"),
        F.sum("total_points").alias("points"),
    )
    seasons = app.groupBy("element", "season").agg(F.sum("total_points").alias("p"))
    best = seasons.groupBy("element").agg(F.min_by("season", F.struct((-F.col("p")).alias("p"), "season")).alias("best_season"))
    last = top_n(on.select("element", *order, "total_points"), key, [F.col(c).desc() for c in order], 5)
    last = last.groupBy("element").agg(F.avg("total_points").alias("last5"))
    out = out.join(best, "element", "left").join(last, "element", "left")
    runs = {"goal_run": g > 0, "return_run": g + a > 0, "clean_run": F.col("clean_sheets") > 0, "blank_run": F.col("total_points") <= BLANK_POINTS}
    out = out.join(trailing_runs(on, key, order, runs), "element", "left")
    return out.select(
        "element", *[F.coalesce(n, F.lit(0)).alias(n) for n in runs], F.col("__best.total_points").alias("best_points"),
        F.col("__best.fixture").alias("best_fixture"), "best_season", "big_scores", "appearances",
        settle("last5", 6).alias("last5"), F.when(F.col("appearances") > 0, settle(F.col("points") / F.col("appearances"), 6)).alias("per_game"),
    )


def metric_leaders(stats: DataFrame, names: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Who leads each metric of a comparison, and by how much (no leader on a tie)."""
    t = stats.filter(F.col("name").isin(list(names))).groupBy("name").agg(*[F.sum(m).cast("double").alias(m) for m in metrics])
    long = t.unpivot(["name"], list(metrics), "metric", "value")
    top = long.groupBy("metric").agg(
        F.max(F.struct("value", "name")).alias("hi"), F.min("value").alias("lo"), F.count(F.lit(1)).alias("n")
    )
    tie = F.col("hi.value") == F.col("lo")
    return top.select("metric", F.when(~tie, F.col("hi.name")).alias("leader"), (F.col("hi.value") - F.col("lo")).alias("lead"))


def team_highlights(fixtures: DataFrame) -> DataFrame:
    """Runs, clean sheets, best attack and defence and the next three opponents' difficulty."""
    from touchline.operators.league import team_rows, win_runs

    rows = team_rows(fixtures)
    t = rows.groupBy("season", "team").agg(
        F.count("result").alias("played"), F.coalesce(F.sum("goals_for"), F.lit(0)).alias("gf"), F.coalesce(F.sum("goals_against"), F.lit(0)).alias("ga"),
        F.count_if(F.col("goals_against") == 0).alias("clean_sheets"),
    )
    on = F.col("played") > 0
    edge = t.groupBy("season").agg(F.max(F.when(on, F.col("gf"))).alias("__gf"), F.min(F.when(on, F.col("ga"))).alias("__ga"))
    nxt = top_n(rows.filter(F.col("status") == "scheduled"), ["season", "team"], [F.col("kickoff_time"), F.col("id")], 3)
    nxt = nxt.groupBy("season", "team").agg(F.avg("difficulty").alias("__d"), F.count("difficulty").alias("__n"))
    out = t.join(edge, "season").join(nxt, ["season", "team"], "left").join(win_runs(rows), ["season", "team"], "left")
    return out.select(
        "season", "team", "clean_sheets", (on & (F.col("gf") == F.col("__gf"))).alias("best_attack"), (on & (F.col("ga") == F.col("__ga"))).alias("best_defence"),
        F.when(F.col("__n") == 3, settle("__d", 6)).alias("next3_difficulty"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("won", "unbeaten", "lost", "winless")],
    )


def outlook(pred: DataFrame, weeks: DataFrame, status: DataFrame, totals: DataFrame, group: Sequence[str] = ("season", "GW")) -> DataFrame:
    """Prediction with ranks, projected total, availability and this season's totals in one row."""
    ranks = prediction_ranks(pred, group)
    proj = weeks.groupBy("season", "element").agg(F.round(F.sum("points"), 2).alias("projected"))
    s = status.select("element", "name", "status", "news", (F.col("now_cost") / 10).alias("price"))
    t = totals.select("season", "name", F.col("total_points").alias("season_points"), F.col("games").alias("season_games"))
    return ranks.join(s, "element", "left").join(proj, ["season", "element"], "left").join(t, ["season", "name"], "left")
