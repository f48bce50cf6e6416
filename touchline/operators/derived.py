"""Derived tables: player-season sums, team matches, identities, second-tier tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.ordered import match_keys, top_n
from touchline.functions.words import lead_gram, normalize_name, short_grams
from touchline.session import written

#: Clubs and teams, and dates, that one product of votes holds.
VOTE_BLOCK, VOTE_DATES = 4096, 1024
# Per-match columns summed per player and season, and the names of the sums
SEASON_SUMS = {
    "total_points": "total_points",
    "goals_scored": "goals",
    "assists": "assists",
    "clean_sheets": "clean_sheets",
    "bonus": "bonus",
    "bps": "bps",
    "minutes": "minutes",
    "saves": "saves",
    "goals_conceded": "goals_conceded",
    "yellow_cards": "yellow_cards",
    "red_cards": "red_cards",
    "ict_index": "ict_sum",
    "influence": "influence_sum",
    "creativity": "creativity_sum",
    "threat": "threat_sum",
    "value": "value_sum",
    "form": "form_sum",
}
PLAYED_ONLY = ("ict_index", "influence", "creativity", "threat")


def most_common(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """The value a key has most often; the smallest one on ties. Counts first, so no task
    keeps a map of all values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(col).alias("v"))).alias("__b"))
    return best.select(*keys, F.col("__b.v").alias(out))


def season_stats(app: DataFrame) -> DataFrame:
    """One row per (name, season): sums, games, maxima, played-only sums, usual team and position."""
    present = [c for c in SEASON_SUMS if c in app.columns]
    played = F.col("minutes") > 0
    sums = {SEASON_SUMS[c]: F.sum(c) for c in present}
    sums |= {"games": F.count(F.lit(1)), "appearances": F.count_if(played)}
    own = {f"{c.removesuffix('_index')}_played_sum": F.sum(F.when(played, F.col(c))) for c in PLAYED_ONLY}
    most = {"max_value": F.max("value"), "max_selected": F.max("selected")}
    # all sums in one hash aggregation; club and position come from counts, which are narrow
    total = app.groupBy("name", "season").agg(
        *[c.alias(n) for n, c in sums.items() if n != "appearances"], *[c.alias(n) for n, c in most.items()], sums["appearances"].alias("appearances"),
        *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in own.items()],
    )
    for c in ("team", "position"):
        total = match_keys(total, most_common(app, ["name", "season"], c, c), ["name", "season"])
    return total


def team_matches(app: DataFrame) -> DataFrame:
    """One row per team and match: goals and expected goals for and against."""
    played = app.filter(F.col("team_h_score").isNotNull())
    own = played.groupBy("season", "fixture", "team").agg(
        F.min("kickoff_time").alias("kickoff_time"),
        F.min("GW").alias("GW"),
        F.bool_or("was_home").alias("was_home"),
        F.min("team_h_score").alias("__h"),
        F.min("team_a_score").alias("__a"),
        F.sum("expected_goals").alias("xgf"),
    )
    home = F.col("was_home")
    own = own.withColumn("gf", F.when(home, F.col("__h")).otherwise(F.col("__a"))).withColumn(
        "ga", F.when(home, F.col("__a")).otherwise(F.col("__h"))
    )
    # a match has two teams, so the other side is a window over at most two rows
    match = Window.partitionBy("season", "fixture").orderBy("team")
    other = F.coalesce(F.lead("xgf").over(match), F.lag("xgf").over(match))
    return own.withColumn("xga", other).drop("__h", "__a")


def opponents(app: DataFrame) -> DataFrame:
    """(season, fixture, team, opponent) from the distinct teams of each match."""
    pairs = app.select("season", "fixture", "team").distinct()
    match = Window.partitionBy("season", "fixture").orderBy("team")
    other = F.coalesce(F.lead("team").over(match), F.lag("team").over(match))
    return pairs.withColumn("opponent", other).filter(F.col("opponent").isNotNull())


def team_season_estimates(app: DataFrame) -> DataFrame:
    """Rough club season record from player rows: a clean sheet counts as a win."""
    per_gw = app.groupBy("season", "team", "GW").agg(
        F.sum("goals_scored").alias("g"),
        F.max(F.when(F.col("position") == "DEF", F.col("clean_sheets"))).alias("cs"),
    )
    t = per_gw.groupBy("season", "team").agg(
        F.count(F.lit(1)).alias("matches_played"),
        F.sum("g").alias("goals_scored"),
        F.coalesce(F.sum("cs"), F.lit(0)).alias("clean_sheets"),
        F.count("cs").alias("__def"),
    )
    m, cs = F.col("matches_played"), F.col("clean_sheets")
    lost = F.greatest(F.lit(0), m - cs - F.floor((m - cs) / 3))
    t = (
        t.withColumn("goals_conceded", F.when(F.col("__def") > 0, m - cs).otherwise(F.lit(0)))
        .withColumn("wins_est", cs)
        .withColumn("losses_est", lost)
        .withColumn("draws_est", m - cs - F.col("losses_est"))
        .withColumn("points", cs * 3 + F.col("draws_est"))
        .withColumn("goal_difference", F.col("goals_scored") - F.col("goals_conceded"))
        .drop("__def")
    )
    return t.select(
        "*",
        (F.col("goals_scored") / m).alias("goals_per_game"),
        (F.col("goals_conceded") / m).alias("conceded_per_game"),
        (F.col("points") / m).alias("points_per_game"),
    )


def gameweek_actuals(app: DataFrame) -> DataFrame:
    """Points and minutes per player and gameweek, double gameweeks summed."""
    return app.groupBy("season", "GW", "element").agg(
        F.sum("total_points").alias("points"), F.sum("minutes").alias("minutes")
    )


def player_identity(app: DataFrame, codes: DataFrame) -> DataFrame:
    """(season, element, name, player_key): the newest name of a code, marked with the code when
    two codes share it; rows without a code keep their name."""
    rows = app.select("season", "element", "name").distinct()
    keyed = rows.join(codes.select("season", "element", "code"), ["season", "element"], "left")
    newest = (
        keyed.filter(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.max_by("name", F.struct("season", "name")).alias("__name"))
    )
    shared = newest.groupBy("__name").agg(F.count(F.lit(1)).alias("__m"))
    labels = newest.join(shared, "__name").select(
        "code",
        F.when(F.col("__m") > 1, F.concat_ws(" #", "__name", F.col("code").cast("string")))
        .otherwise(F.col("__name"))
        .alias("__label"),
    )
    return keyed.join(labels, "code", "left").select(
        "season", "element", "name", F.coalesce("__label", "name").alias("player_key")
    )


def fixtures_per_gameweek(app: DataFrame) -> DataFrame:
    """How many matches a team has in a gameweek."""
    return (
        app.select("season", "GW", "team", "fixture")
        .distinct()
        .groupBy("season", "GW", "team")
        .agg(F.count(F.lit(1)).alias("fixtures_in_gw"))
    )


def weighted_rates(df: DataFrame, keys: Sequence[str], weight: str, stats: dict[str, str]) -> DataFrame:
    """Weighted mean of each stat per key; a row without the stat gives it no weight."""
    aggs = []
    for out, src in stats.items():
        w = F.when(F.col(src).isNotNull(), F.col(weight)).otherwise(F.lit(0))
        num, den = F.sum(F.coalesce(F.col(src), F.lit(0.0)) * w), F.sum(w)
        aggs.append(F.when(den > 0, num / den).alias(out))
    return df.groupBy(*keys).agg(F.sum(weight).alias("weight_total"), *aggs)


def merge_stat_tables(
    base: DataFrame, others: dict[str, DataFrame], keys: Sequence[str], keepers: DataFrame | None = None,
    position: str = "position", keeper_code: str = "GK",
) -> DataFrame:
    """Left join stat tables on ``keys``; clashing columns get the table's name as suffix and
    keeper columns are filled for keepers only. Each table must hold a key once."""
    out = base
    for table, df in others.items():
        out = match_keys(out, _suffixed(df, out.columns, keys, table), keys)
    if keepers is not None:
        k = _suffixed(keepers, out.columns, keys, "keeper")
        extra = [c for c in k.columns if c not in keys]
        out = match_keys(out, k, keys)
        is_gk = F.col(position) == keeper_code
        out = out.select(*[c for c in out.columns if c not in extra], *[F.when(is_gk, F.col(c)).alias(c) for c in extra])
    return out


def _suffixed(df: DataFrame, taken: Sequence[str], keys: Sequence[str], table: str) -> DataFrame:
    return df.select(
        *[F.col(c).alias(c if c in keys or c not in taken else f"{c}_{table}") for c in df.columns]
    )


def coerce_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns to double: thousands commas removed, unreadable text becomes null."""
    clean = {c: F.regexp_replace(F.col(c), ",", "").try_cast("double") for c in cols}
    return df.withColumns(clean)


def coercion_report(df: DataFrame, cols: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Per column, how many texts a cast to number loses, in one pass over the table."""
    lost = [
        F.count_if(F.col(c).isNotNull() & F.regexp_replace(F.col(c), ",", "").try_cast("double").isNull()).alias(c)
        for c in cols
    ]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *lost)
    long = one.unpivot(["rows"], list(cols), "column_name", "new_nulls")
    share = F.col("new_nulls") / F.greatest(F.col("rows"), F.lit(1))
    return long.select(
        "column_name", "new_nulls", "rows", F.when(share > limit, "review").when(share > 0, "minor").otherwise("ok").alias("state")
    )


def map_names(df: DataFrame, col: str, mapping: DataFrame, out: str) -> DataFrame:
    """Replace names found in ``mapping`` (source, target); others stay."""
    m = mapping.select(F.col("source").alias("__src"), F.col("target").alias("__dst"))
    return df.join(m, df[col] == m["__src"], "left").withColumn(out, F.coalesce("__dst", col)).drop("__src", "__dst")


def drop_redundant_columns(df: DataFrame, suffixes: Sequence[str] = ("_shoot", "_playtime", "_misc")) -> DataFrame:
    """Drop a suffixed column when the plain one exists."""
    gone = [c for c in df.columns for s in suffixes if c.endswith(s) and c[: -len(s)] in df.columns]
    return df.drop(*gone)


def split_flag(df: DataFrame, position: str = "position", keeper_code: str = "GK") -> DataFrame:
    """Mark the output a row belongs to; written with ``partitionBy('is_gk')`` this splits the files."""
    return df.withColumn("is_gk", F.coalesce(F.col(position) == keeper_code, F.lit(False)))


# Primary positions of the statistics site and ours
POSITION_MAP = {
    "GK": "GK",
    "DF": "DEF", "DF,MF": "DEF", "DF,FW": "DEF",
    "MF": "MID", "MF,DF": "MID", "MF,FW": "MID",
    "FW": "FWD", "FW,MF": "FWD", "FW,DF": "FWD",
}


def clean_player_stats(df: DataFrame, pos: str, numeric: Sequence[str]) -> DataFrame:
    """Snake-case names, mapped position (unknown -> MID), zero-filled numbers, no repeats."""
    renamed = df.toDF(*[c.lower().replace(" ", "_").replace("-", "_") for c in df.columns])
    pos = pos.lower().replace(" ", "_")
    lookup = F.create_map(*[F.lit(x) for kv in POSITION_MAP.items() for x in kv])
    out = renamed.withColumn("position", F.coalesce(F.try_element_at(lookup, F.col(pos)), F.lit("MID")))
    return out.fillna(0, [n.lower().replace(" ", "_").replace("-", "_") for n in numeric]).distinct()


def promoted_flags(df: DataFrame, promoted: DataFrame, season: str = "season", squad: str = "squad") -> DataFrame:
    """Flag rows whose squad name contains a club promoted that season (last match wins).
    ``promoted`` holds (season, club, finish_position): three rows per season."""
    p = promoted.select(F.col("season").alias("__s"), F.lower("club").alias("__c"), F.col("finish_position").alias("__f"))
    squads = df.select(season, squad).distinct()
    hit = squads.join(p, (squads[season] == p["__s"]) & F.contains(F.lower(squads[squad]), F.col("__c")))
    hit = hit.groupBy(season, squad).agg(F.max("__f").alias("__f"))
    return match_keys(df, hit, [season, squad]).select(
        *df.columns,
        F.col("__f").isNotNull().alias("was_promoted"),
        F.coalesce("__f", F.lit(0)).alias("team_finish_position"),
    )


def match_promoted_players(lower: DataFrame, top: DataFrame, min_minutes: int = 900) -> DataFrame:
    """Promoted players with their totals in the next season of the top tier, both sides with
    enough minutes. ``lower``: player, season_no, minutes, was_promoted; ``top``: name, season_no,
    points, minutes, goals. Names match when the top-tier name contains the other one; a name that
    contains another also holds its first letters, so pairs meet on those."""
    low = lower.filter(F.col("was_promoted") & (F.col("minutes") >= min_minutes)).select(
        F.col("player"), (F.col("season_no") + 1).alias("season_no"), F.col("minutes").alias("lower_minutes"), "squad"
    )
    totals = top.groupBy("name", "season_no").agg(
        F.sum("total_points").alias("top_points"), F.sum("minutes").alias("top_minutes"), F.sum("goals_scored").alias("top_goals")
    )
    words = totals.select("*", F.explode(short_grams(F.lower("name"))).alias("__w"))
    low = low.withColumn("__w", lead_gram(F.lower("player")))
    hit = (
        low.join(words, ["season_no", "__w"])
        .filter(F.contains(F.lower("name"), F.lower("player")))
        .groupBy("player", "squad", "season_no", "lower_minutes")
        .agg(F.min(F.struct("name", "top_points", "top_minutes", "top_goals")).alias("t"))
    )
    return hit.select("player", "squad", "season_no", "lower_minutes", "t.*").filter(F.col("top_minutes") >= min_minutes).withColumn(
        "top_points_per_90", F.col("top_points") / (F.col("top_minutes") / 90)
    )


def team_translation_sums(players: DataFrame) -> DataFrame:
    """Club sums over its promoted players and the per-player rates."""
    t = players.groupBy("team", "season").agg(
        F.sum(F.col("goals_per_90") * F.col("minutes") / 90).alias("lower_goals"),
        F.sum(F.col("top_goals_per_90") * F.col("top_minutes") / 90).alias("top_goals"),
        F.sum("minutes").alias("lower_minutes"),
        F.sum("top_minutes").alias("top_minutes"),
        F.sum("top_points").alias("top_points"),
        F.count(F.lit(1)).alias("player_count"),
    )
    n = F.col("player_count")
    return t.select(
        "*",
        (F.col("lower_goals") / n).alias("lower_goals_per_match"),
        (F.col("top_goals") / n).alias("top_goals_per_match"),
        (F.col("top_points") / n).alias("top_points_per_player"),
    )


def trajectories(df: DataFrame, min_seasons: int = 2) -> DataFrame:
    """Players seen in several seasons, with the seasons in which their club was promoted."""
    per = df.groupBy("name", "season").agg(F.max("was_promoted").alias("__p"), F.sum("minutes").alias("__m"))
    out = per.groupBy("name").agg(
        F.count(F.lit(1)).alias("seasons"),
        F.sum("__m").alias("minutes"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("__p"), F.col("season")))), ",").alias("promoted_seasons"),
    )
    return out.filter((F.col("seasons") >= min_seasons) & (F.col("promoted_seasons") != ""))


def _best_votes(games: DataFrame, ours: DataFrame) -> DataFrame:
    """(club_id, team, votes): for every club and block of teams the first team with the most votes. ``games``: date,
    club_id, __g; ``ours``: date, team, __o. Every club is compared with every team, but a pair never leaves the task:
    clubs and teams are cut into blocks of VOTE_BLOCK, a block's dates come packed, and two blocks are one product
    of matrices, added up over VOTE_DATES dates at a time."""
    day = F.unix_date("date").alias("d")
    pack = lambda df, key, n: df.groupBy(key).agg(F.collect_list(F.struct(day, F.col(n).alias("n"))).alias("l")).select(key, "l.d", "l.n")
    a = written(pack(games.filter(F.col("club_id").isNotNull()), "club_id", "__g"), "clubs")
    b = written(pack(ours, "team", "__o"), "teams")
    a_blocks, b_blocks = (max(1, math.ceil(df.count() / VOTE_BLOCK)) for df in (a, b))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.withColumn("i", block("club_id", a_blocks)).withColumn("j", every(b_blocks))
    b = b.withColumn("j", block("team", b_blocks)).withColumn("i", every(a_blocks))

    def spread(rows: pd.DataFrame) -> tuple:
        at = np.repeat(np.arange(len(rows)), rows["d"].map(len))
        return at, np.concatenate(rows["d"].to_list()), np.concatenate(rows["n"].to_list())

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"club_id": a["club_id"][:0], "team": pd.Series(dtype="object"), "votes": pd.Series(dtype="int64")})
        b = b.sort_values("team", na_position="first", kind="stable")
        (ai, ad, an), (bi, bd, bn) = spread(a), spread(b)
        days = np.intersect1d(ad, bd)
        total = np.zeros((len(a), len(b)))
        for first in range(0, len(days), VOTE_DATES):
            part = days[first : first + VOTE_DATES]
            sides = []
            for size, at, d, n in ((len(a), ai, ad, an), (len(b), bi, bd, bn)):
                m, ok = np.zeros((size, len(part))), np.isin(d, part)
                m[at[ok], np.searchsorted(part, d[ok])] = n[ok]
                sides.append(m)
            total += sides[0] @ sides[1].T
        best = total.argmax(axis=1)  # the first of as many
        out = pd.DataFrame({"club_id": a["club_id"].to_numpy(), "team": b["team"].to_numpy()[best], "votes": total.max(axis=1).astype("int64")})
        return out[out["votes"] > 0]

    kind = dict(games.dtypes)["club_id"]
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(product, f"club_id {kind}, team string, votes long")


def club_votes(games: DataFrame, ours: DataFrame, min_share: float = 0.8) -> DataFrame:
    """Map clubs of another source to ours by shared home dates. ``games``: date, club_id;
    ``ours``: date, team. The best team must cover most of the club's home dates, and a team
    claimed by two clubs is marked."""
    dates = ours.select("date").distinct()
    home = games.join(dates, "date", "left_semi")
    # many clubs are at home on one date: count per date first on both sides, then match
    g = home.groupBy("date", "club_id").agg(F.count(F.lit(1)).alias("__g"))
    o = ours.filter(F.col("date").isNotNull()).groupBy("date", "team").agg(F.count(F.lit(1)).alias("__o"))
    votes = _best_votes(g, o)
    homes = home.groupBy("club_id").agg(F.count(F.lit(1)).alias("homes"))
    best = top_n(votes, ["club_id"], [F.col("votes").desc(), F.col("team")], 1).drop("rank_no")
    ok = best.join(homes, "club_id").filter(F.col("votes") >= F.lit(min_share) * F.col("homes"))
    claims = ok.groupBy("team").agg(F.count(F.lit(1)).alias("__c"))
    return ok.join(claims, "team").select("club_id", "team", "votes", "homes", (F.col("__c") > 1).alias("is_duplicate"))


def link_promoted_squads(lower: DataFrame, top: DataFrame, promoted: DataFrame) -> DataFrame:
    """Second-tier players linked by club and name key to the promoted club's next season."""
    clubs = promoted.select(F.col("season_no"), F.col("club").alias("squad"))
    low = lower.join(clubs, ["season_no", "squad"], "left_semi").select(
        (F.col("season_no") + 1).alias("season_no"),
        F.col("squad").alias("team"),
        normalize_name(F.col("player")).alias("name_key"),
        F.col("minutes").alias("lower_minutes"),
    )
    totals = top.groupBy("season_no", "team", normalize_name(F.col("name")).alias("name_key")).agg(
        F.sum("minutes").alias("top_minutes"), F.sum("total_points").alias("top_points"), F.count(F.lit(1)).alias("top_games")
    )
    return low.join(totals, ["season_no", "team", "name_key"])
