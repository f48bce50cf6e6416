"""Queries for the streams and their batch follow-ups (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import temporal as X
from touchline.plans import roles
from touchline.plans.features import match_events
from touchline.plans.registry import add
from touchline.plans.roles import CTES, ctes
from touchline.streaming import feeds as S

cap = roles.captures


def stream(s, d, name):
    """A table of the folder as a stream of files."""
    schema = roles.table(s, d, name).schema
    return s.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def views(s, d, live: bool):
    """Events as page views: the page comes from the event's number, the flags from its id."""
    e = stream(s, d, "events") if live else roles.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    pages = roles.table(s, d, "pages").select(F.col("page_id").alias("k"), "url")
    v = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k")).join(pages, "k", "left")
    i = F.col("event_id")
    return v.select(
        "ts", S.normalize_path(F.regexp_replace("url", "^https?://[^/]+", "")).alias("path"), S.referrer_host("url", "example.com").alias("referrer"),
        F.when(i % 3 == 0, F.concat(F.lit("Zone/"), (F.col("user_id") % 7).cast("string"))).alias("zone"), (i % 2 == 0).alias("consented"),
        (i % 4 == 0).alias("first_today"), (i % 16 == 0).alias("new_visitor"), (F.col("user_id") % 50 == 0).alias("owner"), (F.col("event_type") != "error").alias("view"),
    )


_PATH = "regexp_replace(url, '^https?://[^/]+', '')"
_NP = f"lower(trim(regexp_extract({_PATH}, '^([^#?]*)', 1)))"
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', '')"
CTES["vw"] = (
    f"SELECT ts, CASE WHEN url IS NOT NULL AND length(p) <= 64 AND regexp_full_match(p, '/[a-z0-9\\-/]*') THEN p ELSE '/other' END AS path, CASE WHEN contains(url, '//') AND regexp_full_match(h, '[a-z0-9.\\-]+') AND h <> 'example.com' THEN h END AS referrer, CASE WHEN event_id % 3 = 0 THEN 'Zone/' || CAST(user_id % 7 AS STRING) END AS zone, event_id % 2 = 0 AS consented, event_id % 4 = 0 AS first_today, event_id % 16 = 0 AS new_visitor, user_id % 50 = 0 AS owner, event_type <> 'error' AS vv "
    f"FROM (SELECT e.*, url, CASE WHEN length({_NP}) > 1 THEN coalesce(nullif(regexp_replace({_NP}, '/+$', ''), ''), '/') ELSE {_NP} END AS p, {_HOST} AS h FROM events e LEFT JOIN pages ON page_id = CAST(json_extract_string(props, '$.k') AS BIGINT))", ())
CTES["vc"] = (
    "SELECT CAST(ts AS DATE) AS day, kind, key, count(*) AS n, min(ts) AS fs FROM (SELECT ts, 'owner_views' AS kind, '' AS key FROM vw WHERE owner AND vv UNION ALL SELECT ts, 'path', path FROM vw WHERE NOT owner AND vv UNION ALL SELECT ts, 'referrer', referrer FROM vw WHERE NOT owner AND vv AND referrer IS NOT NULL "
    "UNION ALL SELECT ts, 'consented_views', '' FROM vw WHERE NOT owner AND consented AND vv UNION ALL SELECT ts, 'visitors', '' FROM vw WHERE NOT owner AND consented AND (first_today OR new_visitor) UNION ALL SELECT ts, 'zone', coalesce(zone, 'unknown') FROM vw WHERE NOT owner AND consented AND (first_today OR new_visitor) UNION ALL SELECT ts, 'new_visitors', '' FROM vw WHERE NOT owner AND consented AND new_visitor) GROUP BY 1, 2, 3", ("vw",))
add("X1_page_view_stream", lambda s, d: S.page_view_stream(views(s, d, True)).select("day", "kind", "key", "n"), ctes("vc") + "SELECT day, kind, key, n FROM vc")
add("X1_page_view_batch", lambda s, d: S.daily_counts(views(s, d, False)).select("day", "kind", "key", "n"), ctes("vc") + "SELECT day, kind, key, n FROM vc")
add("X2_view_summary", lambda s, d: S.view_summary(S.daily_counts(views(s, d, False)), "2024-02-03", 30),
    ctes("vc") + "SELECT CAST(r.day AS DATE) AS day, CAST(coalesce(sum(n) FILTER (WHERE kind = 'path'), 0) AS BIGINT) AS views, CAST(coalesce(sum(n) FILTER (WHERE kind = 'visitors'), 0) AS BIGINT) AS visitors, CAST(coalesce(sum(n) FILTER (WHERE kind = 'owner_views'), 0) AS BIGINT) AS owner_views FROM (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-02-03', INTERVAL 1 DAY)) AS day) r LEFT JOIN vc ON vc.day = CAST(r.day AS DATE) GROUP BY r.day")


def _countries(s, d):
    return roles.table(s, d, "region").select(F.concat(F.lit("Zone/"), F.col("r_regionkey").cast("string")).alias("zone"), F.col("r_name").alias("country"))


add("X2_top_keys", lambda s, d: S.top_keys(S.daily_counts(views(s, d, False)), "2024-01-31", 20, 10, _countries(s, d)),
    ctes("vc", extra={"t": "SELECT kind, key, CAST(sum(n) AS BIGINT) AS n FROM vc WHERE kind IN ('path', 'referrer', 'zone') AND day BETWEEN DATE '2024-01-12' AND DATE '2024-01-31' GROUP BY kind, key",
        "u": "SELECT * FROM t UNION ALL SELECT 'country', coalesce(r_name, 'Unknown'), CAST(sum(n) AS BIGINT) FROM t LEFT JOIN region ON key = 'Zone/' || CAST(r_regionkey AS STRING) WHERE kind = 'zone' GROUP BY 1, 2"})
    + "SELECT kind, key, n, CAST(rn AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS rn FROM u) WHERE rn <= 10")


def _cap_stream(s, d):
    e = stream(s, d, "events").selectExpr(*[f"{v} AS {k}" for k, v in roles.CAPTURE.items()]).filter("kind = 'view'").select("season", "GW", "element", "capture_id", "captured_at", "value")
    return e.unionByName(e)


add("X3_capture_stream", lambda s, d: S.capture_stream(_cap_stream(s, d), X.deadlines(match_events(s, d)).withColumn("deadline", F.col("deadline") + F.expr("INTERVAL 12 HOURS"))).select("season", "GW", "element", "capture_id", "value"),
    ctes("dl") + "SELECT cap.season, cap.GW, element, capture_id, value FROM cap JOIN dl USING (season, GW) WHERE kind = 'view' AND captured_at < deadline + INTERVAL 12 HOUR")
add("X4_latest_state_stream", lambda s, d: S.latest_state_stream(stream(s, d, "events").select(F.col("user_id").alias("element"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"), "value", "event_id"), ["element", "kind"], "at", ["value", "event_id"]).select("element", "kind", "value", "event_id"),
    "SELECT user_id AS element, event_type AS kind, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id DESC) AS k FROM events) WHERE k = 1")
add("X5_normalize", lambda s, d: views(s, d, False).groupBy("path", "referrer").agg(F.count("*").alias("n")), ctes("vw") + "SELECT path, referrer, count(*) AS n FROM vw GROUP BY path, referrer")
add("X6_cap_keys", lambda s, d: S.cap_keys(S.daily_counts(views(s, d, False)), 20),
    ctes("vc", extra={"k": "SELECT *, row_number() OVER (PARTITION BY day, kind ORDER BY fs, key) AS r FROM vc"}) + "SELECT day, kind, CASE WHEN r <= 20 THEN key WHEN kind = 'path' THEN '/other' WHEN kind = 'referrer' THEN 'other' ELSE 'unknown' END AS key, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1, 2, 3")
