"""Stored tables: building dimensions, merging updates, writing.

A merge returns the new contents of a table; ``write_partitions`` then replaces the partitions it
covers, so running a load twice gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.ordered import top_n
from touchline.functions.words import normalize_name

# Words in the news that say a player has gone
GONE_WORDS = (
    "has joined", "joined", "on loan", "loan", "has departed", "departed", "has left", "left the club", "released",
    "returned to", "has returned", "transferred", "permanently", "contract terminated", "mutual consent",
)
LEFT_CLUB = r"(?i)\b(" + "|".join(GONE_WORDS) + r")\b"


# ------------------------------------------------------------------ building

def player_dimension(app: DataFrame) -> DataFrame:
    """Each player's newest row, with a flag for players of the newest season."""
    newest = app.groupBy("name").agg(F.max_by(F.struct("position", "team", "element", "season"), F.struct("season", "GW", "kickoff_time", "fixture", "line")).alias("p"))
    last = app.agg(F.max("season").alias("__last"))
    d = newest.select("name", normalize_name(F.col("name")).alias("name_normalized"), "p.position", "p.team", "p.element", F.col("p.season").alias("last_season"))
    # one row: the newest season
    return d.join(last, d["last_season"] == last["__last"], "left").withColumn("is_current", F.col("__last").isNotNull()).drop("__last")


def small_dimensions(app: DataFrame) -> DataFrame:
    """Distinct teams, seasons and gameweeks as (kind, id)."""
    kinds = F.array(
        F.struct(F.lit("team").alias("kind"), F.col("home_team").alias("id")), F.struct(F.lit("team").alias("kind"), F.col("away_team").alias("id")),
        F.struct(F.lit("season").alias("kind"), F.col("season").alias("id")),
        F.struct(F.lit("gameweek").alias("kind"), F.concat(F.col("season"), F.lit("-GW"), F.col("GW").cast("string")).alias("id")),
    )
    base = app.select("season", "GW", "home_team", "away_team").distinct()
    return base.select(F.explode(kinds).alias("k")).select("k.*").distinct()


def fixture_dimension(app: DataFrame) -> DataFrame:
    """One row per match of a season."""
    return app.groupBy("season", "fixture").agg(
        F.first("GW").alias("GW"), F.first("home_team").alias("home_team"), F.first("away_team").alias("away_team"),
        F.max("team_h_score").alias("team_h_score"), F.max("team_a_score").alias("team_a_score"),
    ).withColumn("id", F.concat_ws("-", F.col("fixture").cast("string"), "season"))


# ------------------------------------------------------------------ merging

def keeps_club(status: str = "status", news: str = "news") -> Column:
    """Only an unavailable player whose news says so has left the club."""
    return ~(F.coalesce(F.col(status) == "u", F.lit(False)) & F.coalesce(F.col(news), F.lit("")).rlike(LEFT_CLUB))


def player_updates(status: DataFrame, season_rows: DataFrame) -> DataFrame:
    """Rows for the player merge: everyone in the status file, and players only in the season's
    matches (from their latest one, without a current club)."""
    s = status.select("name", "element", "position", "team", keeps_club().alias("plays_for"))
    latest = season_rows.groupBy("name").agg(F.max_by(F.struct("element", "position", "team"), F.struct("GW", "kickoff_time", "fixture", "line")).alias("p"))
    gone = latest.join(s, "name", "left_anti").select("name", "p.*", F.lit(False).alias("plays_for"))
    return s.unionByName(gone.select(s.columns))


def merge_players(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert: updated players get the new position and club (or none), others stay."""
    u = updates.select("name", F.col("position").alias("__p"), F.when(F.col("plays_for"), F.col("team")).alias("__t"), F.lit(True).alias("__u"))
    hit = F.coalesce("__u", F.lit(False))
    return current.join(u, "name", "full").select(
        "name", F.when(hit, F.col("__p")).otherwise(F.col("position")).alias("position"), F.when(hit, F.col("__t")).otherwise(F.col("team")).alias("team")
    )


def drop_stale_clubs(dimension: DataFrame, listed: DataFrame) -> DataFrame:
    """Players no longer listed keep their row and lose their club."""
    names = listed.select("name").distinct().withColumn("__in", F.lit(True))
    return dimension.join(names, "name", "left").withColumn("team", F.when(F.col("__in"), F.col("team"))).drop("__in")


def merge_fixtures(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by id: a moved match takes its new gameweek and loses the old one; the preliminary
    schedule of a season goes once official rows for it exist."""
    seasons = updates.select("season").distinct().withColumn("__has", F.lit(True))
    kept = current.join(updates.select("id"), "id", "left_anti").join(seasons, "season", "left")
    kept = kept.filter(~(F.coalesce("__has", F.lit(False)) & (F.col("source") == "csv"))).drop("__has")
    return kept.unionByName(updates.select(kept.columns))


def last_forecasts(captures: DataFrame) -> DataFrame:
    """The forecast of a player for a gameweek: the last capture before its deadline."""
    ok = captures.filter(F.col("captured_at") < F.col("deadline"))
    return ok.groupBy("season", "element", "GW").agg(F.max_by("xP", F.struct("captured_at", "capture_id")).alias("xP"))


def before_deadline(captures: DataFrame) -> DataFrame:
    """Captures taken before their gameweek's deadline."""
    return captures.filter(F.col("captured_at") < F.col("deadline"))


def prediction_output(players: DataFrame, points: DataFrame, opponents: DataFrame) -> DataFrame:
    """One row per current player: points (a blank gameweek gives 0) and the opponents joined with " & "."""
    return players.join(points.select("element", "predicted_points"), "element", "left").join(opponents.select("team", F.regexp_replace("opponents", ", ", " & ").alias("opponent")), "team", "left").select(
        "element", "name", "team", "position", F.round(F.coalesce("predicted_points", F.lit(0.0)), 3).alias("predicted_points"),
        F.coalesce("opponent", F.lit("No fixture")).alias("opponent"),
    )


def label_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the stored tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("label"), "n") for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def promoted_clubs(listed: DataFrame, known: DataFrame, lower: DataFrame) -> DataFrame:
    """Listed clubs we do not know that match a second-tier squad exactly or by a leading
    ``name + ' '``; the first squad in file order wins."""
    new = listed.join(known, "team", "left_anti")
    # a squad's whole name and its beginnings that end before a space: clubs meet on these, not on the first letters
    words = F.split("squad", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    cand = new.select("team").join(lower.select("squad", "row_no", F.explode(starts).alias("team")).hint("merge"), "team")
    return top_n(cand, ["team"], [F.col("row_no"), F.col("squad")], 1).select("team", "squad")


# ------------------------------------------------------------------ writing

def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("season",)) -> None:
    """Replace exactly the partitions present in ``df``; the rest of the table stays. Rows are
    spread by partition and a hash of the row, so one large season is written by many tasks."""
    spread = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    spread.repartition(*by, "__s").drop("__s").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_rows(df: DataFrame, path: str, by: Sequence[str] = ("season", "GW")) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
