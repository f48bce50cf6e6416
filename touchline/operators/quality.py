"""Data-quality checks: one pass per table where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.ordered import match_keys, previous_row

# Fixed value: traces of text decoded with the wrong character set
MOJIBAKE = "Ã|Â|â€"


def table_checks(df: DataFrame, name: str, key: str, min_columns: int = 5) -> DataFrame:
    """Column count, left-over header rows, wrongly decoded names, missing keys."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(name) == F.lit(name)).alias("header_rows"), F.count_if(F.col(name).rlike(MOJIBAKE)).alias("garbled_names"),
        F.count_if(F.col(key).isNull() | (F.col(key) == "")).alias("missing_keys"),
    )
    return one.withColumns({"columns": F.lit(len(df.columns)), "ok": (F.lit(len(df.columns)) >= min_columns) & (F.col("header_rows") == 0) & (F.col("garbled_names") == 0) & (F.col("missing_keys") < F.col("rows"))})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def two_squads(df: DataFrame, keys: Sequence[str], squad: str) -> DataFrame:
    """Players with more than one squad in a season."""
    s = df.select(*keys, squad).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("squads"))
    return s.filter(F.col("squads") > 1)


def completeness(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Known values per group and column."""
    one = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in cols])
    return one.unpivot([group, "rows"], list(cols), "metric", "known").withColumn("share", F.col("known") / F.col("rows"))


def seasons_per_player(df: DataFrame) -> DataFrame:
    per = df.select("name", "season").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("seasons"))
    return per.groupBy("seasons").agg(F.count(F.lit(1)).alias("players"))


def missing_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one table without a partner in the other."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def fixture_sides(sides: DataFrame) -> DataFrame:
    """Each match must have exactly one home and one away club, and they must differ."""
    t = sides.groupBy("fixture").agg(
        F.count_if(F.col("side") == "home").alias("homes"), F.count_if(F.col("side") == "away").alias("aways"),
        F.min(F.when(F.col("side") == "home", F.col("team"))).alias("__h"), F.min(F.when(F.col("side") == "away", F.col("team"))).alias("__a"),
    )
    ok = (F.col("homes") == 1) & (F.col("aways") == 1) & (F.col("__h") != F.col("__a"))
    return t.select("fixture", "homes", "aways", F.coalesce(ok, F.lit(False)).alias("valid"))


def rolling_leaks(app: DataFrame, features: DataFrame, col: str, value: str, window: int, key: str = "element") -> DataFrame:
    """Rows whose rolling feature is not the mean of earlier gameweeks' rows. The expected value
    is rebuilt with a plain join-free window over each player's matches of earlier gameweeks."""
    from touchline.functions.ordered import rolling_before_period

    want = rolling_before_period(app, [key], ["season", "GW"], "kickoff_time", ["fixture", "line"], [value], (window,), name="__want")
    j = match_keys(features.select(key, "season", "GW", F.col(col).alias("__got")), want, [key, "season", "GW"])
    same = F.coalesce(F.abs(F.col("__got") - F.col("__want")) <= 1e-9, F.col("__got").isNull() & F.col("__want").isNull())
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("leaks"))


def lag_correlation(app: DataFrame, value: str, key: str = "element") -> DataFrame:
    """Correlation of a value with its own previous match: a copy of the outcome shows as 1."""
    p = previous_row(app, [key], "kickoff_time", ["fixture", "line"], {"before": value})
    return p.filter(F.col("before").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.corr("before", value).alias("correlation"))


def target_correlations(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.8) -> DataFrame:
    """Correlation of every feature with the target; suspiciously high ones are marked."""
    one = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    return one.unpivot([], list(features), "feature", "correlation").withColumn("suspicious", F.abs("correlation") > limit)
