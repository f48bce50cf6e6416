"""Steps whose disk or memory must not grow faster than their input."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from touchline.functions import ordered as O
from touchline.operators import derived as D
from touchline.operators import evaluation as E
from touchline.operators import models as M
from touchline.operators import temporal as X
from touchline.operators import text as T
from touchline.plans import learn

FOLDER = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prediction_rows_are_made_once(spark):
    r = learn.rows(spark, FOLDER, "minutes", "name")
    assert "Join" not in _plan(r) and "Window" not in _plan(r)
    assert r.columns == ["season", "GW", "minutes", "name", "y", *learn.COLS]


def _week(week: int, pairs) -> list[tuple]:
    start = dt.datetime(2000, 1, 1) + dt.timedelta(days=7 * week)
    season = "2000-01" if week < 4 else "2001-02"
    out = []
    for i, (a, b) in enumerate(pairs):
        fixture = week * 100 + i
        out += [("L", season, week, fixture, a, True, start, 2.0, 1.5), ("L", season, week, fixture, b, False, start, 1.0, None)]
    return out


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_ratings_pass_in_batches(spark, batch):
    schema = "division string, season string, GW int, fixture long, team string, was_home boolean, kickoff_time timestamp, gf double, xgf double"
    df = spark.createDataFrame([r for w in range(1, 7) for r in _week(w, [("a", "b"), ("c", "d" if w < 3 else "e"), ("f", "g")])], schema)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        steps = X.rating_steps(df)
        assert "FlatMapCoGroups" not in _plan(steps)  # no league is held whole
        got = {(r["season"], r["fixture"], r["team"]): (r["att"], r["dfn"]) for r in X.fixture_ratings(df).collect()}
        end = {r["team"]: (r["att"], r["dfn"]) for r in steps.filter("was_home IS NULL").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    level, season = {}, "2000-01"
    for w in range(1, 7):
        rows = [r for r in df.collect() if r["GW"] == w]
        if rows[0]["season"] != season:
            season, level = rows[0]["season"], {t: (a * 0.7, d * 0.7) for t, (a, d) in level.items()}
        for r in rows:
            level.setdefault(r["team"], (0.0, 0.0) if season == "2000-01" else (-0.15, -0.15))
        before = dict(level)
        for r in rows:
            other = next(x["team"] for x in rows if x["fixture"] == r["fixture"] and x["team"] != r["team"])
            assert got[r["season"], r["fixture"], r["team"]] == pytest.approx(before[r["team"]])
            y = r["gf"] if r["xgf"] is None else 0.7 * r["xgf"] + 0.3 * r["gf"]
            gap = 0.05 * (y - 1.35 * 2.718281828459045 ** (before[r["team"]][0] - before[other][1]) * (1.08 if r["was_home"] else 1 / 1.08))
            level[r["team"]] = (level[r["team"]][0] + gap, level[r["team"]][1])
            level[other] = (level[other][0], level[other][1] - gap)
    assert end.keys() == level.keys() and all(end[t] == pytest.approx(level[t]) for t in level)


def test_squads_are_compared_only_where_a_link_is_possible(spark):
    players = [(f"Jo Smith {i}", i) for i in range(40)]
    day = lambda i, k: dt.date(2000, 1, 1 + (i + k) % 28)
    other = [("s", "t", i, n, day(i, k), 60 + i) for n, i in players for k in range(3)] + [("s", "t", 99, "Al Undated", None, 5)]
    ours = [("s", "t", n, day(i, k), 60 + i) for n, i in players for k in range(3)] + [("s", "t", "Al Undated", day(1, 1), 80)]
    got = T.link_players(spark.createDataFrame(other, "season string, team string, player_id int, player_name string, date date, minutes int"),
                         spark.createDataFrame(ours, "season string, team string, name string, date date, minutes int"))
    assert {(r["player_id"], r["name"], r["kind"]) for r in got.collect()} == {(i, n, 1) for n, i in players} | {(99, "Al Undated", 0)}
    # the names of a pair are not normalised again with every pair, and no list is walked by a fold
    assert "aggregate(" not in _plan(got)


def test_clubs_with_one_beginning_do_not_meet(spark):
    teams = spark.createDataFrame([(f"Supplier#{i:06d}",) for i in range(300)], "team string")
    source = spark.createDataFrame([(f"Supplier#{i:06d} United",) for i in range(300)] + [("plier 000007",), ("",)], "source string")
    got = T.match_clubs(source, teams, spark.createDataFrame([], "alias string, team string"))
    assert {(r["source"], r["team"], r["tier"]) for r in got.collect()} == {(f"Supplier#{i:06d} United", f"Supplier#{i:06d}", 3) for i in range(300)} | {("plier 000007", "Supplier#000007", 3)}
    assert T._pieces(teams, "team", teams, "team").count() == 300


def test_names_are_searched_without_all_pairs(spark):
    words = ["large", "ring", "hot", "bolt"]
    names = [(i, f"{words[i % 4]} {words[i // 4 % 4]} {i}", float(i * 37 % 101)) for i in range(400)] + [(500, "ring large", 1.0)]
    asked = [(1, "large ring 17"), (2, "la ri"), (3, "rin"), (4, "ring zzz"), (5, "large bolt zzz"), (6, "la ri"), (7, "ring ring"), (8, "zzz"), (9, "ring large"), (10, "16")]
    entries = spark.createDataFrame(names, "entry_id int, name string, popularity double")
    got = T.resolve_names(spark.createDataFrame(asked, "query_id int, query string"), entries)
    want = set()
    for q, text in asked:
        qt, found = text.split(), []
        for e, name, popularity in names:
            nt = name.split()
            n = sum(any(t.startswith(w) or (len(w) >= 3 and w in t) for t in nt) for w in qt)
            at = 0
            for w in qt:
                at = next((i + 1 for i, t in enumerate(nt) if i >= at and t.startswith(w)), -1) if at >= 0 else -1
            if n:
                tier = 4 if name == text else 3 if at > 0 else 2 if n == len(qt) else 1
                found.append((-tier, -n, -popularity, e, name))
        most = max((-f[0] for f in found), default=0)
        found = sorted(f for f in found if most < 2 or f[0] <= -2)[:10]
        want |= {(q, e, name, -t, -m, k + 1) for k, (t, m, _, e, name) in enumerate(found)}
    assert {tuple(r[c] for c in ("query_id", "entry_id", "name", "tier", "matched", "rank_no")) for r in got.collect()} == want
    frequent = T.resolve_names(spark.createDataFrame([(i, "ring zzz") for i in range(50)], "query_id int, query string"), entries)
    assert frequent.count() == 500


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_votes_of_clubs_meet_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(D, "VOTE_BLOCK", block)
    monkeypatch.setattr(D, "VOTE_DATES", 2)
    day = lambda k: dt.date(2000, 1, 1 + k)
    games = spark.createDataFrame([(day(k), c) for c in (1, 2, 3) for k in range(c, c + 5)] + [(None, 1), (day(1), 4), (day(9), 4)], "date date, club_id int")
    ours = spark.createDataFrame([(day(k), t) for t, f in (("b", 1), ("a", 1), ("c", 2), ("d", 9)) for k in range(f, f + 5)] + [(day(9), "d"), (None, "a")], "date date, team string")
    got = D.club_votes(games, ours)
    # nobody of ours is at home on club 3's last date, so it does not count
    assert {tuple(r) for r in got.collect()} == {(1, "a", 5, 5, False), (2, "c", 5, 5, True), (3, "c", 4, 4, True), (4, "d", 2, 2, False)}


def test_methods_are_made_once(spark):
    assert "Join" not in _plan(learn._methods(spark, FOLDER)) and "Window" not in _plan(learn._methods(spark, FOLDER))


def test_vectors_are_written_before_they_are_clustered(spark):
    df = spark.range(200).selectExpr("id % 40 AS name", "CAST(id * 7 % 13 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b").groupBy("name").agg({"a": "sum", "b": "max"}).toDF("name", "v_a", "v_b")
    out, score = M.cluster(df, ["a", "b"], 3)
    assert "Aggregate" not in _plan(out) and out.columns == ["name", "v_a", "v_b", "cluster"] and out.count() == 40 and -1 <= score <= 1


def test_values_of_few_groups_meet_their_edges_in_parts(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], -1)
    spark.conf.set(names[1], -1)
    spark.conf.set(names[2], False)
    try:
        df = spark.range(4000).selectExpr("'a' AS g", "CAST(id AS DOUBLE) AS v").unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0)], "g string, v double"))
        tasks = lambda d: d.groupBy(F.spark_partition_id()).count().collect()
        out = O.value_ranges(df, ["g"], "v", "r")
        assert len(tasks(out)) > 2
        r = out.filter("g = 'a'").groupBy("r").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("r").collect()
        assert len(r) == O.RANGES and max(x["n"] for x in r) < 40 and all(x["hi"] < y["lo"] for x, y in zip(r, r[1:]))
        half = df.withColumnsRenamed({"v": "x"}).filter("g = 'a'")
        got = {x["feature"]: x["psi"] for x in E.drift(half, half.filter("x < 2000"), ["x"]).collect()}
        want = sum((c + 1e-10 - 0.1 - 1e-10) * math.log((c + 1e-10) / (0.1 + 1e-10)) for c in [0.2] * 5 + [0.0] * 5)
        assert got["x"] == pytest.approx(want, abs=0.02)
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_ratings_are_fitted_in_blocks_of_pairings(monkeypatch):
    rng = np.random.default_rng(3)
    home, away = (x.astype(np.int32) for x in np.nonzero(~np.eye(6, dtype=bool)))
    sums = [np.ones(len(home)), rng.poisson(1.5, len(home)).astype(float), rng.poisson(1.1, len(home)).astype(float)]
    fit = lambda: M._fit_ratings(home, away, sums, np.zeros(6), np.zeros(6), M.DEFAULT_LEVEL, M.DEFAULT_EDGE, M.FIRST_SD)
    whole = fit()
    monkeypatch.setattr(M, "PAIRS", 7)
    for a, b in zip(whole, fit()):
        assert np.allclose(a, b, atol=1e-8)
    a, d, mu, h = whole
    over = sums[1] - np.exp(mu + h + a[home] - d[away])
    other = sums[2] - np.exp(mu + a[away] - d[home])
    slope = np.bincount(home, over, 6) + np.bincount(away, other, 6) - a / M.FIRST_SD**2
    assert np.abs(slope).max() < 1e-6


def test_every_name_asks(spark):
    import __spark_entry__ as entry
    from oracle import compare, connect

    found = entry.queries()["T3_resolve_names"](spark, FOLDER)
    asked = {r["p_partkey"] for r in spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey").collect()}
    assert {r["query_id"] // 10 for r in found.select("query_id").distinct().collect()} == asked
    compare(found, connect(FOLDER), entry.oracle_sql()["T3_resolve_names"])


def test_an_id_that_asks_twice_is_ranked_as_one(spark):
    names = spark.createDataFrame([(1, "red ring", 5.0), (2, "red bolt", 4.0), (3, "blue bolt", 3.0)], "entry_id long, name string, popularity double")
    asked = spark.createDataFrame([(7, "red"), (7, "bolt"), (8, "blue bolt"), (9, "bolt zzz"), (9, "blue"), (None, "red")], "query_id long, query string")
    got = sorted((r["query_id"], r["rank_no"], r["entry_id"], r["tier"]) for r in T.resolve_names(asked, names, 3).collect())
    assert got == [(7, 1, 1, 3), (7, 2, 2, 3), (7, 3, 2, 3), (8, 1, 3, 4), (9, 1, 3, 3)]


def test_exploded_words_are_not_sent_to_every_task(spark):
    from touchline.operators import mentions as W

    v = spark.range(1000000, 1020000).select(F.col("id").cast("string").alias("v"))
    w = spark.createDataFrame([("1000001",), ("1000x05",), ("100",)], "word string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        got = {r["word"]: (r["corrected"], r["ratio"]) for r in W.closest(W.similar_words(w, v, 0.8)).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got["1000001"] == ("1000001", 1.0) and got["1000x05"][0] == "1000005"


def test_promoted_clubs_meet_on_whole_beginnings(spark):
    from touchline.sources import tables as K

    listed = spark.createDataFrame([(f"Club {k}",) for k in range(40)] + [("AB",), ("Club",), (None,)], "team string")
    lower = spark.createDataFrame([(f"Club {k} Town" if k % 2 else f"Club {k}", k) for k in range(40)] + [("AB Town", 90), ("AB", 91), ("Club 1Town", 92)], "squad string, row_no long")
    out = K.promoted_clubs(listed, listed.filter("team = 'Club 3'"), lower)
    want = {f"Club {k}": f"Club {k} Town" if k % 2 else f"Club {k}" for k in range(40) if k != 3} | {"AB": "AB Town", "Club": "Club 0"}
    assert {r["team"]: r["squad"] for r in out.collect()} == want
    assert "startswith" not in _plan(out).lower()  # no pairs are formed that are thrown away


def test_gameweek_frames_are_written_once(spark, monkeypatch):
    import __spark_entry__ as entry
    from touchline.plans import features

    made, whole = [], E.written
    monkeypatch.setattr(E, "written", lambda df, name: made.append(name) or whole(df, name))
    monkeypatch.setattr(features, "written", lambda df, name: made.append((name, len(df.columns))) or whole(df, name))
    for name, want in (("E17_double_gameweeks", ["rows", "team-gameweeks", "player-gameweeks"]), ("E19_gameweek_table", ["player-gameweeks"]), ("F41_congestion", [("appearances", 7)])):
        made.clear()
        plan = _plan(entry.queries()[name](spark, FOLDER))
        assert made == want and plan.count("l_discount") <= 3
