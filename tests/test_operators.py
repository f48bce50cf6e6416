"""Operators that SQL cannot say, against brute force; readers; rules; leak checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from touchline.functions.words import ACCENTED, PLAIN, normalize_name, slugify
from touchline.operators import evaluation as E
from touchline.operators import league as L
from touchline.operators import mentions as W
from touchline.operators import models as M
from touchline.operators import neighbours as N
from touchline.operators import players as P
from touchline.operators import temporal as X
from touchline.operators import text as T
from touchline.sources import readers as S
from touchline.sources import tables as K


def test_names(spark):
    assert len(ACCENTED) == len(PLAIN)
    df = spark.createDataFrame([("Martin Ødegaard",), ("N'Golo Kanté",), ("  Ángel--Di María ",)], "n string")
    assert [r[0] for r in df.select(normalize_name(F.col("n"))).collect()] == ["martin odegaard", "n golo kante", "angel di maria"]
    assert spark.createDataFrame([("Nott'm Forest",)], "n string").select(slugify(F.col("n"))).first()[0] == "nottm-forest"


def test_bonus_ties(spark):
    def award(*bps):
        df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bps)], "fixture int, element int, bps int")
        return [r["award"] for r in rows(L.bonus_awards(df), "element")]

    assert award(30, 30, 20, 10) == [3, 3, 1, 0]
    assert award(30, 20, 20, 10) == [3, 2, 2, 0]
    assert award(30, 20, 10, 10) == [3, 2, 1, 1]
    assert award(30, 30, 30, 10) == [3, 3, 3, 0]


def test_chance_and_factor(spark):
    df = spark.createDataFrame([("u", 75.0), ("a", None), ("i", None), ("d", 75.0), (None, None), ("s", 50.0)], "status string, chance_next double")
    got = [r[0] for r in df.select(L.chance_of_playing()).collect()]
    assert got == [0.0, 1.0, 0.0, 0.75, 1.0, 0.5]
    f = [r[0] for r in df.select(X.points_factor(L.chance_of_playing())).collect()]
    assert f == pytest.approx([0.0, 1.0, 0.0, 0.91, 1.0, 0.77])


def _matches(rng, teams, gws, seasons):
    out = []
    fid = 0
    for s in seasons:
        for gw in range(1, gws + 1):
            order = rng.permutation(teams)
            for h, a in zip(order[::2], order[1::2]):
                fid += 1
                k = pd.Timestamp(f"{s[:4]}-01-01") + pd.Timedelta(days=7 * gw)
                gh, ga = rng.poisson(1.5), rng.poisson(1.1)
                for t, home, gf, g2 in ((h, True, gh, ga), (a, False, ga, gh)):
                    out.append(("L", s, fid, str(t), k, gw, home, float(gf), float(g2), float(gf) + 0.2 if s > "2001" else None, None))
    return pd.DataFrame(out, columns=["division", "season", "fixture", "team", "kickoff_time", "GW", "was_home", "gf", "ga", "xgf", "xga"])


def test_team_ratings_follow_the_recursion(spark):
    tm = _matches(np.random.default_rng(2), [f"T{i}" for i in range(6)], 8, ["2001-02", "2002-03"])
    schema = "division string, season string, fixture int, team string, kickoff_time timestamp, GW int, was_home boolean, gf double, ga double, xgf double, xga double"
    clean = [tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if x != x else x for x in r) for r in tm.itertuples(index=False, name=None)]
    df = spark.createDataFrame(clean, schema)
    got = {(r["season"], r["GW"], r["team"]): (r["att"], r["dfn"]) for r in X.team_ratings(df).collect()}
    att, dfn, last = {}, {}, None
    opp = tm.merge(tm[["fixture", "team"]].rename(columns={"team": "opp"}), on="fixture").query("team != opp")
    for (s, gw), b in opp.groupby(["season", "GW"]):
        if last and s != last:
            att, dfn = {k: v * 0.7 for k, v in att.items()}, {k: v * 0.7 for k, v in dfn.items()}
        last = s
        for t in b["team"]:
            att.setdefault(t, 0.0 if s == "2001-02" else -0.15)
            dfn.setdefault(t, 0.0 if s == "2001-02" else -0.15)
        before = (dict(att), dict(dfn))
        for r in b.itertuples():
            assert got[(s, gw, r.team)] == pytest.approx((before[0][r.team], before[1][r.team]))
            y = 0.7 * r.xgf + 0.3 * r.gf if r.xgf == r.xgf and r.xgf is not None else r.gf
            e = y - 1.35 * math.exp(before[0][r.team] - before[1][r.opp] + (1 if r.was_home else -1) * math.log(1.08))
            att[r.team] += 0.05 * e
            dfn[r.opp] -= 0.05 * e


def test_team_ratings_resumed_equal_one_pass(spark):
    tm = _matches(np.random.default_rng(4), [f"T{i}" for i in range(6)], 5, ["2001-02", "2002-03", "2003-04"])
    schema = "division string, season string, fixture int, team string, kickoff_time timestamp, GW int, was_home boolean, gf double, ga double, xgf double, xga double"
    clean = [tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if x != x else x for x in r) for r in tm.itertuples(index=False, name=None)]
    df = spark.createDataFrame([r for r in clean if not (r[1] == "2001-02" and r[3] == "T5")], schema)  # T5 comes up later
    rows = lambda f, *o: {tuple(r[c] for c in o): (r["att"], r["dfn"]) for r in f.collect()}
    whole, end = rows(X.fixture_ratings(df), "season", "fixture", "team"), rows(X.latest_ratings(df), "season", "team")
    state, got = None, {}
    for part in ("season = '2001-02' AND GW <= 3", "season = '2001-02' AND GW > 3", "season = '2002-03'", "season = '2003-04'"):
        now = df.filter(part)
        got |= rows(X.fixture_ratings(now, state=state), "season", "fixture", "team")
        state = spark.createDataFrame(X.latest_ratings(now, state=state).collect(), "division string, season string, team string, att double, dfn double")
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in whole)
    assert all(rows(state, "season", "team")[k] == pytest.approx(end[k]) for k in end)
    ahead = spark.createDataFrame([("L", "2003-04", "T1", "T2"), ("L", "2004-05", "T1", "new")], "division string, season string, team string, opponent string")
    same, new = X.upcoming_ratings(ahead, state).orderBy("season").collect()
    assert (same.att, same.dfn) == pytest.approx(end["2003-04", "T1"]) and (same.opp_att, same.opp_dfn) == pytest.approx(end["2003-04", "T2"])
    assert new.att == pytest.approx(0.7 * end["2003-04", "T1"][0]) and new.opp_att == new.opp_dfn == -0.15


def _absence_by_hand(minutes, started, points):
    counted, waiting, away, back, regular, out = [], [], 0, 10, False, []
    for i, m in enumerate(minutes):
        seen = (counted[-6:] + waiting)[-6:]
        part = [points[j] for j in seen[-3:]]
        out.append((sum(part) / len(part) if part else None, away, back))
        back = min(back + 1, 10)
        if m > 0:
            if away:
                away, back = 0, 1
            counted, waiting = counted + waiting + [i], []
        elif away:
            away += 1
        else:
            if not waiting:
                regular = bool(counted) and sum(started[j] for j in counted[-3:]) >= 2
            waiting.append(i)
            if regular and len(waiting) >= 3:
                away, waiting = len(waiting), []
    return out


@pytest.mark.parametrize("slot_rows", [3, 40, 5000])
@pytest.mark.parametrize("batch", [10, 10000])
def test_absence_form_in_slots_equals_one_pass(spark, slot_rows, batch):
    rng = np.random.default_rng(5)
    data = []
    for el, n in ((1, 400), (2, 60), (3, 9)):
        on = True
        for i in range(n):
            on = on if rng.random() > 0.07 else not on
            m = int(90 if on and rng.random() > 0.05 else 0)
            k = pd.Timestamp("2000-01-01") + pd.Timedelta(days=5 * i)
            data.append((el, str(k.year), i, i, 1, k, m, int(m > 0), int(rng.integers(0, 12))))
    pdf = pd.DataFrame(data, columns=["element", "season", "GW", "fixture", "line", "kickoff_time", "minutes", "starts", "total_points"])
    got = X.absence_form(spark.createDataFrame(pdf).withColumn("GW", F.col("GW").cast("int")), ("total_points",), slot_rows=slot_rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(size)
    spark.conf.set(size, str(batch))
    try:
        got = {(r["element"], r["GW"]): r for r in got.collect()}
    finally:
        spark.conf.set(size, given)
    assert len(got) == len(pdf)
    for el, g in pdf.groupby("element"):
        want = _absence_by_hand(g["minutes"].tolist(), g["starts"].tolist(), g["total_points"].tolist())
        for gw, w in zip(g["GW"], want):
            r = got[(el, gw)]
            assert r["absent_run"] == w[1] and r["since_return"] == w[2]
            assert (r["total_points_r3_a"] is None) == (w[0] is None) and (w[0] is None or r["total_points_r3_a"] == pytest.approx(w[0]))


def test_goal_expectations_fit_their_prices(spark):
    df = spark.createDataFrame([(0.5, 0.25, 0.55), (0.2, 0.6, 0.4), (None, 0.3, 0.5)], "p_home double, p_away double, p_over double")
    r = [x.asDict() for x in X.goal_expectations(df).collect()]
    assert r[2]["lam_h"] is None
    for x in r[:2]:
        h, a = x["lam_h"], x["lam_a"]
        t = h + a
        assert 1 - math.exp(-t) * (1 + t + t * t / 2) == pytest.approx(x["p_over"], abs=1e-6)
        pmf = lambda l: [math.exp(-l) * l**k / math.factorial(k) for k in range(16)]
        ph, pa = pmf(h), pmf(a)
        diff = sum(ph[i] * pa[j] * ((i > j) - (i < j)) for i in range(16) for j in range(16))
        assert diff == pytest.approx(x["p_home"] - x["p_away"], abs=1e-4)


def _squad(points, minutes):
    pos = ["GK", "DEF", "DEF", "DEF", "MID", "MID", "MID", "MID", "FWD", "FWD", "FWD", "GK", "DEF", "DEF", "MID"]
    sq = [(1, 1, i, p, "starter" if i < 11 else "bench", i if i < 11 else i - 11, i == 4, i == 8) for i, p in enumerate(pos)]
    act = [(1, 1, i, points[i], minutes[i]) for i in range(15)]
    return sq, act


def test_squad_scores(spark):
    schema = "season int, GW int, element int, position string, role string, slot int, is_captain boolean, is_vice boolean"
    points, minutes = list(range(1, 16)), [90] * 15

    def score(points, minutes):
        sq, act = _squad(points, minutes)
        a = spark.createDataFrame(act, "season int, GW int, element int, points int, minutes int")
        return L.score_squads(spark.createDataFrame(sq, schema), a, ["season", "GW"]).first()

    assert score(points, minutes)["points"] == sum(points[:11]) + points[4]
    # the captain is out: the vice counts twice, and the first bench player who fits comes in
    out = list(minutes)
    out[4] = 0
    r = score([0 if m == 0 else p for p, m in zip(points, out)], out)
    assert r["points"] == sum(points[:11]) - points[4] + points[12] + points[8] and r["auto_subs"] == 1
    # a missing defender of a back three can only be replaced by a defender
    out = list(minutes)
    out[1] = out[12] = 0
    r = score([0 if m == 0 else p for p, m in zip(points, out)], out)
    assert r["points"] == sum(points[:11]) - points[1] + points[13] + points[4]
    # goalkeepers only replace goalkeepers
    out = list(minutes)
    out[0] = out[11] = 0
    r = score([0 if m == 0 else p for p, m in zip(points, out)], out)
    assert r["auto_subs"] == 0


def test_template_squad_is_the_full_greedy_choice(spark):
    rng = np.random.default_rng(3)
    pos = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}
    data = [(1, i, rng.choice(list(pos)), f"C{0 if rng.random() < 0.5 else rng.integers(1, 9)}", float(rng.integers(0, 500)) / 10, float(rng.integers(0, 90)) / 10) for i in range(400)]
    data = [(g, i, str(p), t, o, x) for g, i, p, t, o, x in data]
    df = spark.createDataFrame(data, "GW int, element int, position string, team string, ownership double, points double")
    got = {r["element"] for r in L.template_squad(df, ["GW"]).collect()}
    clubs, want = {}, set()
    for p, n in pos.items():
        taken = 0
        for r in sorted((d for d in data if d[2] == p), key=lambda d: (-d[4], -d[5], d[1])):
            if taken < n and clubs.get(r[3], 0) < 3:
                want.add(r[1])
                clubs[r[3]] = clubs.get(r[3], 0) + 1
                taken += 1
    assert got == want


def test_link_players(spark):
    a = [("S", "T", i, n, f"2020-01-{d:02d}", 90 - i) for i, n in ((1, "Joao Silva"), (2, "P. Jones")) for d in range(1, 7)]
    b = [("S", "T", n, f"2020-01-{d:02d}", m) for n, m in (("João Silva", 89), ("Phil Jones", 88)) for d in range(1, 7)]
    o = spark.createDataFrame(a, "season string, team string, player_id int, player_name string, date string, minutes int")
    u = spark.createDataFrame(b, "season string, team string, name string, date string, minutes int")
    assert {r["player_id"]: r["name"] for r in T.link_players(o, u).collect()} == {1: "João Silva", 2: "Phil Jones"}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = N.nearest(df.filter("id < 7"), df.filter("id >= 7"), "id", "v", 4, probes=2)
    got = {k: list(g.sort_values("rank_no")["item_id"]) for k, g in got.toPandas().groupby("query_id")}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(7):
        s = np.round(u[7:] @ u[i], 6)
        assert got[i] == list(np.lexsort((np.arange(7, 60), -s))[:4] + 7)


def test_expected_points_keep_the_level(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({
        "season": "2024-25", "position": rng.choice(["GK", "DEF", "MID", "FWD"], n), "minutes": rng.choice([0, 30, 90], n), "total_points": rng.integers(0, 12, n), "goals_scored": rng.integers(0, 2, n),
        "assists": rng.integers(0, 2, n), "clean_sheets": rng.integers(0, 2, n), "goals_conceded": rng.integers(0, 4, n), "saves": rng.integers(0, 7, n), "bonus": rng.integers(0, 4, n),
        "expected_goals": rng.random(n), "expected_assists": rng.random(n), "expected_goals_conceded": rng.random(n) * 2, "defensive_contribution": rng.integers(0, 16, n).astype(float), "id": np.arange(n)})
    got = M.expected_points(spark.createDataFrame(pdf), 50).toPandas().set_index("id").sort_index()
    assert len(got) == n and (got.loc[pdf["minutes"] == 0, "xpts"] == 0).all()
    on = pdf["minutes"] > 0
    lam = pdf["expected_goals_conceded"].to_numpy()
    pen = sum((k // 2) * np.exp(-lam) * lam**k / math.factorial(k) for k in range(1, 21))
    for p, g in pdf[on].groupby("position"):
        gp, cp, thr = P.GOAL_POINTS[p], P.CLEAN_SHEET_POINTS[p], P.DC_THRESHOLD.get(p, 1e9)
        full = (g["minutes"] >= 60).to_numpy()
        exp = {"g": g["expected_goals"] * gp, "a": g["expected_assists"] * 3, "c": full * cp * np.exp(-g["expected_goals_conceded"]), "k": -pen[g.index] * (p in ("GK", "DEF"))}
        act = {"g": g["goals_scored"] * gp, "a": g["assists"] * 3, "c": g["clean_sheets"] * cp, "k": -(g["goals_conceded"] // 2) * (p in ("GK", "DEF"))}
        s = {t: np.asarray(e) * (np.sum(act[t]) / np.sum(e) if abs(np.sum(e)) > 1e-9 else 1) for t, e in exp.items()}
        app, sav, dfn = np.where(full, 2.0, 1.0), (g["saves"] // 3 if p == "GK" else g["saves"] * 0).to_numpy(float), np.where(g["defensive_contribution"] >= thr, 2.0, 0.0)
        x = np.column_stack([np.ones(len(g)), s["g"], s["a"], s["c"], sav, dfn, full.astype(float)])
        bonus = np.clip(x @ np.linalg.lstsq(x, g["bonus"].to_numpy(float), rcond=None)[0], 0, 3)
        rest = (g["total_points"] - app - sav - dfn - g["bonus"] - sum(act.values())).mean()
        np.testing.assert_allclose(got.loc[g.index, "xpts"].to_numpy(), app + sav + dfn + sum(s.values()) + bonus + rest, atol=1e-6)


def test_features_ignore_later_outcomes(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame([("2024-25", gw, el, el * 100 + gw, 1, pd.Timestamp("2024-08-01") + pd.Timedelta(days=7 * gw), int(rng.integers(0, 15)), 90) for el in range(60) for gw in range(1, 12)],
                       columns=["season", "GW", "element", "fixture", "line", "kickoff_time", "total_points", "minutes"])
    df = spark.createDataFrame(pdf).withColumn("GW", F.col("GW").cast("int"))
    build = lambda a: X.rolling_before_period(a, ["element"], X.PERIOD, "kickoff_time", X.TIE, ["total_points"], (3, 6))
    r = E.lookahead_audit(df, build, ["total_points"], "2024-25", 6, ["element", "season", "GW"], ["element", "fixture", "line"]).first()
    assert r["changed_up_to_gw"] == 0 and r["rows_up_to_gw"] == 360 and r["changed_next_gw"] > 30
    assert X.attach(df, build(df), ["element", "season", "GW"]).count() == len(pdf)


def test_sign_test(spark):
    got = spark.range(1).select(E.sign_test(F.lit(9).cast("long"), F.lit(2).cast("long")).alias("p")).first()["p"]
    assert got == pytest.approx(2 * sum(math.comb(11, i) for i in range(3)) / 2**11)


def test_match_probabilities(spark):
    r = M.match_probabilities(spark.createDataFrame([(1, 1.6, 1.1)], "id int, lam_h double, lam_a double")).first()
    assert r["home_win"] + r["draw"] + r["away_win"] == pytest.approx(1.0)
    assert r["likeliest"].split(",")[0] == "1-1" and r["clean_sheet_home"] == pytest.approx(math.exp(-1.1))


def test_readers(spark, tmp_path):
    (tmp_path / "h.csv").write_text("season_x,team_x,name,position,kickoff_time,fixture,GW,total_points,minutes,was_home\n2020-21,A,Bo,GKP,2020-09-12T11:30:00Z,1,1,5,90,True\n2020-21,A,Co,AM,2020-09-12T11:30:00Z,1,1,5,90,True\n")
    r = S.read_history(spark, str(tmp_path / "h.csv")).collect()
    assert len(r) == 1 and r[0]["position"] == "GK" and r[0]["xP"] is None and str(r[0]["kickoff_time"]) == "2020-09-12 11:30:00"
    (tmp_path / "s.csv").write_text("Matchday,Date,Time,Home Team,Away Team\n1,15/08/2026,15:00,Leeds United,Spurs\n20,02/01/2027,15:00,Spurs,Leeds United\n")
    k = [str(x["kickoff_time"]) for x in rows(S.read_schedule(spark, str(tmp_path / "s.csv"), "2026-27"), "gameweek")]
    assert k == ["2026-08-15 14:00:00", "2027-01-02 15:00:00"]
    d = tmp_path / "T-2020-2021"
    d.mkdir()
    (d / "2020-2021_Standard_Teams.txt").write_text("x")
    f = S.discover_files(spark, str(tmp_path)).collect()
    assert [(x["season"], x["table_type"]) for x in f] == [("2020-2021", "standard")]


def test_partition_overwrite_replaces_one_season(spark, tmp_path):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "season string, n int")
    path = str(tmp_path / "t")
    K.write_partitions(a, path)
    K.write_partitions(spark.createDataFrame([("b", 9)], "season string, n int"), path)
    assert {(r["season"], r["n"]) for r in K.read_back(spark, path).collect()} == {("a", 1), ("b", 9)}


def test_mentions_of_any_length(spark):
    texts = spark.createDataFrame([(1, "So Ana Maria de la Cruz met Ana, and maria"), (2, None), (3, "")], "doc_id long, text string")
    names = spark.createDataFrame([("Ana Maria de la Cruz", 1), ("Ana", 5), ("Maria", 2), ("Maria de la", 1)], "name string, popularity long")
    got = sorted((r["doc_id"], r["at"], r["words"], r["name"]) for r in W.mentions(texts, names, "doc_id").collect())
    # a full name counts where it first stands; words of three letters mean nobody on their own
    assert got == [(1, 1, 5, "Ana Maria de la Cruz"), (1, 9, 1, "Maria")]
    assert W.mentions(texts, names.limit(0), "doc_id").count() == 0


def test_links_by_an_unambiguous_name_alone(spark):
    other = [("s", "A", 1, "Luis Ortega", None, None), ("s", "A", 2, "Gabriel", None, None), ("s", "A", 3, "Tom Reed", "2024-01-01", 90), ("s", "A", 3, "Tom Reed", "2024-01-08", 90)]
    ours = [("s", "A", n, d, m) for n, d, m in (("Luis Ortega", "2024-01-01", 0), ("Gabriel", "2024-01-01", 30), ("Paulo Gabriel", "2024-01-01", 20), ("Tom Reed", "2024-01-01", 10), ("Tom Reed", "2024-01-08", 20))]
    o = spark.createDataFrame(other, "season string, team string, player_id long, player_name string, date string, minutes int").withColumn("date", F.to_date("date"))
    u = spark.createDataFrame(ours, "season string, team string, name string, date string, minutes int").withColumn("date", F.to_date("date"))
    # a full name wins over a shared surname; minutes that contradict the name are no link
    assert {r["player_id"]: r["name"] for r in T.link_players(o, u).collect()} == {1: "Luis Ortega", 2: "Gabriel"}
    twins = u.withColumn("name", F.regexp_replace("name", "^Gabriel$", "Marco Gabriel"))
    assert {r["player_id"]: r["name"] for r in T.link_players(o, twins).collect()} == {1: "Luis Ortega"}


def test_streams_take_late_and_repeated_rows(spark, tmp_path):
    from touchline.streaming import feeds

    views = "ts string, path string, referrer string, zone string, consented boolean, first_today boolean, new_visitor boolean, owner boolean, view boolean"
    folder = tmp_path / "views"
    for i, day in enumerate(("2024-03-20", "2024-03-21", "2024-03-08", "2024-03-20")):
        one = spark.createDataFrame([(f"{day} 10:00:0{i}", "/a", None, "Z/1", True, True, False, False, True)], views).withColumn("ts", F.to_timestamp("ts"))
        one.coalesce(1).write.mode("append").parquet(str(folder))
    table = spark.read.parquet(str(folder))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    cols = ["day", "kind", "key", "n", "first_seen"]
    assert sorted(map(tuple, feeds.page_view_stream(stream).select(cols).collect())) == sorted(map(tuple, feeds.daily_counts(table).select(cols).collect()))

    caps = tmp_path / "caps"
    for at, c in (("2024-03-20 10:00:00", 1), ("2024-03-01 09:00:00", 2), ("2024-03-20 10:00:00", 1), ("2024-03-21 12:30:00", 3), ("2024-03-19 08:00:00", 1)):
        one = spark.createDataFrame([("s", 1, 7, c, at)], "season string, GW int, element long, capture_id long, captured_at string").withColumn("captured_at", F.to_timestamp("captured_at"))
        one.coalesce(1).write.mode("append").parquet(str(caps))
    deadlines = spark.createDataFrame([("s", 1, "2024-03-21 12:00:00")], "season string, GW int, deadline string").withColumn("deadline", F.to_timestamp("deadline"))
    stream = spark.readStream.schema(spark.read.parquet(str(caps)).schema).option("maxFilesPerTrigger", 1).parquet(str(caps))
    got = sorted((r["capture_id"], str(r["captured_at"])) for r in feeds.capture_stream(stream, deadlines).collect())
    assert got == [(1, "2024-03-19 08:00:00"), (2, "2024-03-01 09:00:00")]


def test_leave_one_out_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(f"t{i % 9}", float(a), float(b), float(2 * a - b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(30, 3)))]
    df = spark.createDataFrame(rows, "team string, a double, b double, y double")
    got = {(r["team"], r["a"]): r["predicted"] for r in M.leave_one_out(df, ["a", "b"], "y").collect()}
    for team in {r[0] for r in rows}:
        rest = np.array([r[1:] for r in rows if r[0] != team])
        x, y = rest[:, :2], rest[:, 2]
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
        for r in rows:
            if r[0] == team:
                assert abs(got[team, r[1]] - (y.mean() + ((np.array(r[1:3]) - x.mean(0)) / x.std(0)) @ w)) < 1e-9


def test_team_translation_of_several_inputs_and_targets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4)) * [1, 1, 900, 5]
    y = np.column_stack([x @ [1, 0, 0.001, 0], x @ [0, 2, 0, 0.1], rng.normal(size=40)])
    rows = [(f"t{i % 11}", *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))]
    cols, targets = ["i0", "i1", "i2", "i3"], ["y0", "y1", "y2"]
    df = spark.createDataFrame(rows, "team string, " + ", ".join(f"{c} double" for c in cols + targets))
    for r in M.team_translation(df, cols, targets).collect():
        rest = np.array([int(q[0][1:]) != int(r["team"][1:]) for q in rows])
        mean, sd = x[rest].mean(0), x[rest].std(0)
        z = (x[rest] - mean) / sd
        for k, t in enumerate(targets):
            w = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y[rest, k] - y[rest, k].mean()))
            assert r[f"{t}_predicted"] == pytest.approx(y[rest, k].mean() + ((np.array([r[c] for c in cols]) - mean) / sd) @ w, abs=1e-8)


def test_typos_leave_beginnings_alone(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("haaland", "salah", "bruno", "saka")], "word string")
    words = spark.createDataFrame([(w,) for w in ("haalan", "haland", "salahh", "brun", "bruns", "sak", "xxxx", None)], "word string")
    got = {r["word"]: r["corrected"] for r in W.correct_typos(words, vocabulary).collect()}
    assert got == {"haland": "haaland", "salahh": "salah", "bruns": "bruno"}


def test_poisson_ratings_are_the_optimum(spark):
    rng = np.random.default_rng(4)
    clubs = [f"c{i}" for i in range(6)]
    rows, k = [], 0
    for season, own in (("2020-21", clubs), ("2021-22", clubs[:5] + ["new"])):
        strength = {c: 0.5 - 0.2 * i for i, c in enumerate(own)}
        for gw in range(1, 11):
            for i, h in enumerate(own):
                a = own[(i + gw) % 6]
                if a != h:
                    played = season == "2020-21" or gw < 9
                    g = [int(rng.poisson(np.exp(0.2 + s))) for s in (0.2 + strength[h] - strength[a], strength[a] - strength[h])]
                    rows.append((k, season, gw, f"{season[:4]}-08-{gw + 1:02d}", "finished" if played else "scheduled", h, a, *(g if played else (None, None))))
                    k += 1
    df = spark.createDataFrame(rows, "id long, season string, gameweek int, kickoff_time string, status string, home_team string, away_team string, home_score int, away_score int").withColumn("kickoff_time", F.to_timestamp("kickoff_time"))
    got = {(r["season"], r["team"]): r for r in M.poisson_ratings(df).collect()}
    assert len(got) == 12 and [t for (s, t), r in got.items() if r["promoted"]] == ["new"]
    order = sorted(clubs, key=lambda c: -got["2020-21", c]["attack"] - got["2020-21", c]["defence"])
    assert order[0] in clubs[:2] and order[-1] in clubs[-2:]
    # at the optimum of the first season the penalised score is zero: each club's missing goals equal the pull to the prior
    season = [r for r in rows if r[1] == "2020-21"]
    for c in clubs:
        pull, keep = 0.0, 0.0
        for _, _, gw, _, _, h, a, hg, ag in season:
            w, R = 0.5 ** ((10 - gw) / 20.0), {x: got["2020-21", x] for x in (h, a)}
            lam_h = np.exp(R[h]["level"] + R[h]["home_edge"] + R[h]["attack"] - R[a]["defence"])
            lam_a = np.exp(R[h]["level"] + R[a]["attack"] - R[h]["defence"])
            pull += w * ((hg - lam_h) * (c == h) + (ag - lam_a) * (c == a))
            keep += w * ((lam_a - ag) * (c == h) + (lam_h - hg) * (c == a))
        assert abs(pull - got["2020-21", c]["attack"] / 0.3**2) < 1e-6
        assert abs(keep - got["2020-21", c]["defence"] / 0.3**2) < 1e-6
    lam = M.expected_goals(M.poisson_ratings(df), df.filter("status = 'scheduled'")).collect()
    assert len(lam) == sum(r[4] == "scheduled" for r in rows) and all(r["lam_h"] > 0 and r["lam_a"] > 0 for r in lam)


def test_trees_are_added_until_the_next_ones_stop_helping(spark, monkeypatch):
    from touchline.plans import learn

    assert M.stopping_tree([5, 4, 3, 3.5, 3.2, 3.1, 1], 3) == (3, True)
    assert M.stopping_tree([5, 4, 3, 3.5, 2.9, 3.1], 3) == (5, False)
    df = spark.range(2000).select((F.rand(1) * 6).alias("a"), (F.rand(2) < 0.5).alias("later")).withColumn("y", 10 * F.sin("a") + F.randn(4))
    train, valid = df.filter("not later"), df.filter("later")
    small = {"most": 12, "patience": 3, "depth": 2, "rate": 0.3, "leaf": 5}
    got = M.fit_stopped(train, valid, ["a"], "y", **small)
    few = M.fit_points(train, valid, ["a"], "y", learn.TREES, 3)
    error = lambda m: m.predict(valid).agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0]
    assert got.members[0].stages[-1].getNumTrees > learn.TREES and error(got) < error(few)
    tree = got.members[0]
    judged = M.impute(valid, ["a"])[0].withColumn("label", F.col("y"))
    spark_says = tree.stages[-1].evaluateEachIteration(tree.stages[0].transform(judged), "squared")
    assert np.allclose(M.errors_by_trees(tree, judged) / valid.count(), spark_says)
    assert (M.MOST_TREES, M.PATIENCE, M.DEPTH, M.RATE) == (3000, 100, 8, 0.03)
    # the query asks for no smaller search
    calls, whole = [], M.fit_stopped
    monkeypatch.setattr(M, "fit_stopped", lambda *a, **b: calls.append((len(a), b)) or whole(*a, **small))
    assert learn._m1(spark, "/root/testdata/sf0.001").count() > 0
    assert calls == [(4, {})]
