"""Streams: page views, captures before a deadline, latest live state; and their batch follow-ups.

Every stream reads a folder or table source, keeps no state but its source's progress, and writes
micro-batches with their number to the shared folder. Running one again from its checkpoint adds
nothing twice, because a batch overwrites its own partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.ordered import match_keys, top_n
from touchline.session import shared_folder

# Limits and overflow names of the page-view counters
MAX_KEYS, MAX_PATH, MAX_HOST = 200, 64, 100
OTHER_PATH, OTHER_REFERRER, UNKNOWN_ZONE = "/other", "other", "unknown"


# ------------------------------------------------------------------ normalisation

def normalize_path(raw: str | Column) -> Column:
    """Route to count: no query or hash, lower case, no trailing slash, plain short paths only."""
    col = F.col(raw) if isinstance(raw, str) else raw
    p = F.lower(F.trim(F.regexp_extract(col, r"^([^#?]*)", 1)))
    p = F.when(F.length(p) > 1, F.coalesce(F.nullif(F.regexp_replace(p, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(p)
    ok = col.isNotNull() & (F.length(p) <= MAX_PATH) & p.rlike("^/[a-z0-9\\-/]*$")
    return F.when(ok, p).otherwise(OTHER_PATH)


def bare_host(value: Column) -> Column:
    """Host of a URL in lower case without user, port and www."""
    rest = F.regexp_extract(value, r"//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(rest), r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", ""), F.lit(""))


def referrer_host(raw: str, own: str | None = None) -> Column:
    """External host that sent a visitor; null for none, a relative one or our own."""
    h = bare_host(F.col(raw))
    ok = F.contains(F.col(raw), F.lit("//")) & h.rlike("^[a-z0-9.\\-]+$")
    if own is not None:
        ok = ok & (h != own)
    return F.when(ok, F.substring(h, 1, MAX_HOST))


# ------------------------------------------------------------------ page views

def view_counters(views: DataFrame) -> DataFrame:
    """Counter increments of each view. ``views``: ts, path, referrer, zone, consented,
    first_today, new_visitor, owner, view."""
    c = lambda f: F.coalesce(F.col(f), F.lit(False))
    public = ~c("owner")
    one = lambda cond, kind, key: F.when(cond, F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    none = F.lit("")
    visitor = public & c("consented") & (c("first_today") | c("new_visitor"))
    bumps = F.filter(F.array(
        one(c("owner") & c("view"), "owner_views", none), one(public & c("view"), "path", F.col("path")),
        one(public & c("view") & F.col("referrer").isNotNull(), "referrer", F.col("referrer")),
        one(public & c("consented") & c("view"), "consented_views", none), one(visitor, "visitors", none),
        one(visitor, "zone", F.coalesce("zone", F.lit(UNKNOWN_ZONE))), one(public & c("consented") & c("new_visitor"), "new_visitors", none),
    ), lambda x: x.isNotNull())
    return views.select("ts", F.explode(bumps).alias("b")).select("ts", "b.kind", "b.key")


def daily_counts(views: DataFrame) -> DataFrame:
    """Counts per UTC day, kind and key of a table, or of one batch of a stream."""
    rows = view_counters(views)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen")).select(
        F.to_date("w.start").alias("day"), "kind", "key", "n", "first_seen")


def cap_keys(counts: DataFrame, cap: int = MAX_KEYS) -> DataFrame:
    """Per day and kind the first ``cap`` keys seen keep their name, the rest are pooled."""
    first = top_n(counts.select("day", "kind", "key", "first_seen"), ["day", "kind"], [F.col("first_seen"), F.col("key")], cap, "__r").select("day", "kind", "key", F.lit(True).alias("__in"))
    other = F.when(F.col("kind") == "path", OTHER_PATH).when(F.col("kind") == "referrer", OTHER_REFERRER).otherwise(UNKNOWN_ZONE)
    c = match_keys(counts, first, ["day", "kind", "key"])
    return c.withColumn("key", F.when(F.col("__in"), F.col("key")).otherwise(other)).groupBy("day", "kind", "key").agg(F.sum("n").alias("n"))


def view_summary(counts: DataFrame, last_day: str, days: int = 30) -> DataFrame:
    """Views, visitors and owner views of each of the last days, days without any as zeros."""
    spark = counts.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last_day).cast("date"), days - 1), F.lit(last_day).cast("date"))).alias("day"))
    per = counts.groupBy("day").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(o) for k, o in (("path", "views"), ("visitors", "visitors"), ("owner_views", "owner_views"))])
    return spine.join(per, "day", "left").fillna(0, ["views", "visitors", "owner_views"])


def top_keys(counts: DataFrame, last_day: str, days: int = 30, n: int = 20, countries: DataFrame | None = None) -> DataFrame:
    """Most frequent paths, referrers, zones and countries of the last days."""
    end = F.lit(last_day).cast("date")
    t = counts.filter(F.col("day").between(F.date_sub(end, days - 1), end) & F.col("kind").isin("path", "referrer", "zone")).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    if countries is not None:
        c = t.filter(F.col("kind") == "zone").join(countries.select(F.col("zone").alias("key"), "country"), "key", "left")
        c = c.groupBy(F.lit("country").alias("kind"), F.coalesce("country", F.lit("Unknown")).alias("key")).agg(F.sum("n").alias("n"))
        t = t.unionByName(c)
    return top_n(t, ["kind"], [F.col("n").desc(), F.col("key")], n)


# ------------------------------------------------------------------ running a stream

def run_available(stream: DataFrame, mode: str, name: str, each: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> str:
    """Process what is available, one partition per micro-batch after ``each``, and return the folder. A
    batch that runs again replaces its own partition."""
    base = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return f"{base}/out"


def latest_batches(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Update-mode output read back: the newest row of each key."""
    d = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def page_view_stream(views: DataFrame) -> DataFrame:
    """Run the page-view counters over a stream of views. Every batch leaves its own increments, which are
    added up on reading, so a view counts however late it arrives."""
    path = run_available(views, "append", "page-views", daily_counts)
    parts = views.sparkSession.read.option("basePath", path).parquet(path)
    return parts.groupBy("day", "kind", "key").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def capture_stream(captures: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Captures before their gameweek's deadline; of repeats, also in different batches, the first one."""
    ok = captures.join(deadlines.select("season", "GW", "deadline"), ["season", "GW"]).filter(F.col("captured_at") < F.col("deadline"))
    path = run_available(ok, "append", "captures")
    rest = [c for c in ok.columns if c not in ("capture_id", "element", "captured_at")]
    rows = captures.sparkSession.read.option("basePath", path).parquet(path)
    first = rows.groupBy("capture_id", "element").agg(F.min(F.struct("captured_at", *rest)).alias("r"))
    return first.select("capture_id", "element", "r.*").select(*ok.columns)


def latest_state_stream(feed: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Newest state of each key, in update mode."""
    agg = feed.groupBy(*keys).agg(F.max(F.struct(at, *values)).alias("s")).select(*keys, "s.*")
    return latest_batches(feed.sparkSession, run_available(agg, "update", "live"), keys)
