"""The driver's tables seen as match data.

Every frame is described once, as select expressions that read the same in Spark SQL and in
ANSI SQL, so a query and its SQL check start from the same rows and differ only in how the
operator itself is written. ``frame(spark, sf_dir, name)`` gives the Spark side and ``ctes``
the SQL side.

Stand-ins: a line item is a player's appearance in a match (its order), a part is the player, a
supplier the club, the order date the kick-off, year and month the season and gameweek. Events
are captures, deadlines and page views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CURRENT = "2001-02"

SEASON = "CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS STRING), 2, '0')"
POSITION = (
    "CASE p_type WHEN 'PROMO' THEN 'GK' WHEN 'ECONOMY' THEN 'DEF' WHEN 'STANDARD' THEN 'DEF' "
    "WHEN 'SMALL' THEN 'MID' WHEN 'MEDIUM' THEN 'MID' ELSE 'FWD' END"
)
Q = "CAST(l_quantity AS INT)"
D = "CAST(round(l_discount * 100) AS INT)"
T = "CAST(round(l_tax * 100) AS INT)"
PART = "(l_linenumber * 7 + l_partkey) % 6"
MINUTES = f"CASE {PART} WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 61 ELSE 90 END"

APPEARANCE = {
    "season": SEASON,
    "GW": "CAST(month(o_orderdate) AS INT)",
    "name": "p_name || ' ' || CAST(l_partkey AS STRING)",
    "element": "l_partkey",
    "position": POSITION,
    "team": "'Club ' || CAST(l_suppkey AS STRING)",
    "fixture": "l_orderkey",
    "line": "CAST(round(l_extendedprice * 100) AS BIGINT) * 1000000 + l_suppkey * 10 + l_linenumber",
    "kickoff_time": "CAST(o_orderdate AS TIMESTAMP)",
    "minutes": MINUTES,
    "starts": f"CASE WHEN year(o_orderdate) < 1997 THEN NULL WHEN {PART} > 1 THEN 1 ELSE 0 END",
    "total_points": f"{Q} % 17 - 1",
    "goals_scored": f"CASE WHEN {Q} > 47 THEN 2 WHEN {Q} > 42 THEN 1 ELSE 0 END",
    "assists": f"CASE WHEN {D} >= 9 THEN 1 ELSE 0 END",
    "clean_sheets": "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END",
    "goals_conceded": f"{T} % 5",
    "saves": f"CASE WHEN p_type = 'PROMO' THEN {D} ELSE 0 END",
    "own_goals": f"CASE WHEN {Q} = 1 THEN 1 ELSE 0 END",
    "penalties_saved": f"CASE WHEN p_type = 'PROMO' AND {Q} = 13 THEN 1 ELSE 0 END",
    "penalties_missed": f"CASE WHEN {Q} = 7 THEN 1 ELSE 0 END",
    "yellow_cards": f"CASE WHEN {T} = 3 THEN 1 ELSE 0 END",
    "red_cards": f"CASE WHEN {T} = 8 AND {D} = 0 THEN 1 ELSE 0 END",
    "bonus": f"{T} % 4",
    "bps": f"{Q} + {T} % 4",
    "value": "CAST(40 + (l_suppkey + l_partkey) % 90 AS INT)",
    "selected": "CAST(floor(l_extendedprice) AS BIGINT)",
    "transfers_in": f"CASE WHEN {D} = 5 THEN NULL ELSE CAST({Q} * 100 + l_linenumber AS BIGINT) END",
    "transfers_out": f"CASE WHEN {D} = 5 THEN NULL ELSE CAST({Q} * 70 + {T} AS BIGINT) END",
    "influence": "round(l_extendedprice / 1000, 1)",
    "creativity": "round(l_discount * 300, 1)",
    "threat": "round(l_tax * 400, 1)",
    "ict_index": "round(l_extendedprice / 10000, 1)",
    "expected_goals": "CASE WHEN year(o_orderdate) < 1996 THEN NULL ELSE round(l_discount * 3, 2) END",
    "expected_assists": "CASE WHEN year(o_orderdate) < 1996 THEN NULL ELSE round(l_tax * 2, 2) END",
    "expected_goals_conceded": "CASE WHEN year(o_orderdate) < 1996 THEN NULL ELSE round(l_tax * 20, 2) END",
    "defensive_contribution": f"CASE WHEN year(o_orderdate) < 1998 THEN NULL ELSE CAST({Q} % 16 AS DOUBLE) END",
    "predicted_points": "round(l_extendedprice / 10000, 3)",
}

# one row per order: the two clubs are its lowest and highest supplier
FIXTURE = {
    "id": "l_orderkey",
    "season": SEASON,
    "gameweek": "CAST(month(o_orderdate) AS INT)",
    "kickoff_time": "CAST(o_orderdate AS TIMESTAMP)",
    "home_team": "'Club ' || CAST(h AS STRING)",
    "away_team": "'Club ' || CAST(a AS STRING)",
    "status": (
        "CASE WHEN o_orderdate >= DATE '2001-07-01' THEN 'scheduled' "
        "WHEN o_orderdate >= DATE '2001-06-15' THEN 'in_progress' ELSE 'finished' END"
    ),
    "home_score": "CASE WHEN o_orderdate >= DATE '2001-07-01' THEN NULL ELSE hs END",
    "away_score": "CASE WHEN o_orderdate >= DATE '2001-07-01' THEN NULL ELSE as_ END",
    "home_difficulty": "CAST(2 + a % 4 AS INT)",
    "away_difficulty": "CAST(2 + h % 4 AS INT)",
    "total_price": "o_totalprice",
    "source": "CASE o_orderstatus WHEN 'P' THEN 'csv' ELSE 'api' END",
}

PLAYER = {
    "element": "p_partkey",
    "code": "p_partkey + 1000",
    "name": "p_name || ' ' || CAST(p_partkey AS STRING)",
    "web_name": "p_name",
    "team": "'Club ' || CAST(p_partkey % 10 AS STRING)",
    "position": POSITION,
    "status": "CASE p_size % 7 WHEN 0 THEN 'i' WHEN 1 THEN 'd' WHEN 2 THEN 'u' WHEN 3 THEN 's' ELSE 'a' END",
    "chance_next": "CAST(CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 50 WHEN 3 THEN 75 END AS DOUBLE)",
    "news": (
        "CASE p_size % 7 WHEN 0 THEN 'Knee injury' WHEN 1 THEN 'Knock' WHEN 2 THEN "
        "(CASE WHEN p_size % 2 = 0 THEN 'Left the club' ELSE 'Not in squad' END) WHEN 3 THEN 'Suspended' ELSE '' END"
    ),
    "news_added": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size * 37 % 1000 AS BIGINT) END",
    "now_cost": "CAST(40 + p_partkey % 90 AS INT)",
    "selected_by_percent": "(p_partkey * 37 % 1000) / CAST(10 AS DOUBLE)",
    "form": "CAST(p_size % 10 AS DOUBLE)",
    "ep_next": "p_retailprice / 500",
    "transfers_in_event": "CAST(p_partkey * 13 % 5000 AS BIGINT)",
    "transfers_out_event": "CAST(p_partkey * 29 % 5000 AS BIGINT)",
    "cost_change_event": "CAST(p_partkey % 7 - 3 AS INT)",
    "penalties_order": "CASE WHEN p_partkey % 31 < 3 THEN CAST(1 + p_partkey % 31 AS INT) END",
    "corners_order": "CASE WHEN p_partkey % 29 < 4 THEN CAST(1 + p_partkey % 29 AS INT) END",
    "freekicks_order": "CASE WHEN p_partkey % 23 < 3 THEN CAST(1 + p_partkey % 23 AS INT) END",
}

# events: one user is one player, days are gameweeks
CAPTURE = {
    "capture_id": "event_id",
    "element": "user_id",
    "captured_at": "CAST(ts AS TIMESTAMP)",
    "season": "'2023-24'",
    "GW": "CAST(day(ts) AS INT)",
    "kind": "event_type",
    "value": "value",
    "status": "CASE WHEN value < 5 THEN 'i' WHEN value < 15 THEN 'd' WHEN value < 20 THEN 'u' ELSE 'a' END",
    "chance": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id % 5 - 1) * 25 AS DOUBLE) END",
    "news_flag": "CASE WHEN value < 20 THEN 1 ELSE 0 END",
    "penalties_order": "CASE WHEN event_id % 11 < 3 THEN CAST(1 + event_id % 11 AS INT) END",
    "props": "props",
}


def _select(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "app": (
        f"SELECT {_select(APPEARANCE)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN part ON l_partkey = p_partkey",
        (),
    ),
    "sides": (
        f"SELECT l_orderkey, l_suppkey, CAST(sum(CASE WHEN {Q} > 25 THEN 1 ELSE 0 END) AS INT) AS score "
        "FROM lineitem GROUP BY l_orderkey, l_suppkey",
        (),
    ),
    "ends": (
        "SELECT l_orderkey, min(l_suppkey) AS h, max(l_suppkey) AS a, min_by(score, l_suppkey) AS hs, "
        "max_by(score, l_suppkey) AS as_ FROM sides GROUP BY l_orderkey HAVING min(l_suppkey) < max(l_suppkey)",
        ("sides",),
    ),
    "fx": (f"SELECT {_select(FIXTURE)} FROM ends JOIN orders ON l_orderkey = o_orderkey", ("ends",)),
    "pl": (f"SELECT {_select(PLAYER)} FROM part", ()),
    "cap": (f"SELECT {_select(CAPTURE)} FROM events", ()),
}


def ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH ...`` text holding the named frames and what they need, then ``extra`` frames."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        if n in done:
            return
        body, needs = CTES[n]
        for m in needs:
            add(m)
        done[n] = body

    for n in names:
        add(n)
    done.update(extra or {})
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in done.items()) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exprs(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player per match."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
    return joined.selectExpr(*_exprs(APPEARANCE))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match between two clubs."""
    li = table(spark, sf_dir, "lineitem")
    sides = li.groupBy("l_orderkey", "l_suppkey").agg(_sum_score())
    ends = (
        sides.groupBy("l_orderkey")
        .agg(*[e for e in _ends()])
        .filter("h < a")
    )
    orders = table(spark, sf_dir, "orders")
    return ends.join(orders, ends.l_orderkey == orders.o_orderkey).selectExpr(*_exprs(FIXTURE))


def _sum_score():
    from pyspark.sql import functions as F

    return F.expr(f"CAST(sum(CASE WHEN {Q} > 25 THEN 1 ELSE 0 END) AS INT)").alias("score")


def _ends():
    from pyspark.sql import functions as F

    return [
        F.min("l_suppkey").alias("h"),
        F.max("l_suppkey").alias("a"),
        F.min_by("score", "l_suppkey").alias("hs"),
        F.max_by("score", "l_suppkey").alias("as_"),
    ]


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of each player."""
    return table(spark, sf_dir, "part").selectExpr(*_exprs(PLAYER))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamped captures and deadlines, one row per event."""
    return table(spark, sf_dir, "events").selectExpr(*_exprs(CAPTURE))


def sided_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearances of the two clubs of a match, with side and score."""
    from pyspark.sql import functions as F

    a = appearances(spark, sf_dir)
    f = fixtures(spark, sf_dir).select(
        F.col("id").alias("fid"), "home_team", "away_team", "home_score", "away_score", "status"
    )
    return (
        a.join(f, (a.fixture == f.fid) & ((a.team == f.home_team) | (a.team == f.away_team)))
        .withColumn("was_home", F.col("team") == F.col("home_team"))
        .withColumnRenamed("home_score", "team_h_score")
        .withColumnRenamed("away_score", "team_a_score")
        .drop("fid")
    )


CTES["sided"] = (
    "SELECT app.*, fx.home_team, fx.away_team, fx.status, team = fx.home_team AS was_home, "
    "fx.home_score AS team_h_score, fx.away_score AS team_a_score "
    "FROM app JOIN fx ON app.fixture = fx.id AND app.team IN (fx.home_team, fx.away_team)",
    ("app", "fx"),
)
CTES["ss"] = (
    """SELECT a.*, t.team, p.position FROM (
    SELECT name, season, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(goals_scored) AS BIGINT) AS goals,
      CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(clean_sheets) AS BIGINT) AS clean_sheets,
      CAST(sum(bonus) AS BIGINT) AS bonus, CAST(sum(bps) AS BIGINT) AS bps, CAST(sum(minutes) AS BIGINT) AS minutes,
      CAST(sum(saves) AS BIGINT) AS saves, CAST(sum(goals_conceded) AS BIGINT) AS goals_conceded,
      CAST(sum(yellow_cards) AS BIGINT) AS yellow_cards, CAST(sum(red_cards) AS BIGINT) AS red_cards,
      sum(ict_index) AS ict_sum, sum(influence) AS influence_sum, sum(creativity) AS creativity_sum,
      sum(threat) AS threat_sum, CAST(sum(value) AS BIGINT) AS value_sum, count(*) AS games,
      max(value) AS max_value, max(selected) AS max_selected,
      count(*) FILTER (WHERE minutes > 0) AS appearances,
      coalesce(sum(ict_index) FILTER (WHERE minutes > 0), 0) AS ict_played_sum,
      coalesce(sum(influence) FILTER (WHERE minutes > 0), 0) AS influence_played_sum,
      coalesce(sum(creativity) FILTER (WHERE minutes > 0), 0) AS creativity_played_sum,
      coalesce(sum(threat) FILTER (WHERE minutes > 0), 0) AS threat_played_sum
    FROM app GROUP BY name, season) a
    JOIN (SELECT name, season, team FROM (SELECT name, season, team, row_number() OVER (PARTITION BY name, season
      ORDER BY count(*) DESC, team) AS rn FROM app GROUP BY name, season, team) WHERE rn = 1) t USING (name, season)
    JOIN (SELECT name, season, position FROM (SELECT name, season, position, row_number() OVER (PARTITION BY name, season
      ORDER BY count(*) DESC, position) AS rn FROM app GROUP BY name, season, position) WHERE rn = 1) p USING (name, season)""",
    ("app",),
)
CTES["tm"] = (
    """SELECT f.season, f.fixture, f.team, f.kickoff_time, f.GW, f.was_home,
      CASE WHEN f.was_home THEN f.hs ELSE f.as_ END AS gf, CASE WHEN f.was_home THEN f.as_ ELSE f.hs END AS ga,
      f.xgf, o.xgf AS xga
    FROM (SELECT season, fixture, team, min(kickoff_time) AS kickoff_time, min(GW) AS GW, bool_or(was_home) AS was_home,
        min(team_h_score) AS hs, min(team_a_score) AS as_, sum(expected_goals) AS xgf
      FROM sided WHERE team_h_score IS NOT NULL GROUP BY season, fixture, team) f
    LEFT JOIN (SELECT season, fixture, team, sum(expected_goals) AS xgf FROM sided WHERE team_h_score IS NOT NULL
      GROUP BY season, fixture, team) o ON f.season = o.season AND f.fixture = o.fixture AND f.team <> o.team""",
    ("sided",),
)
