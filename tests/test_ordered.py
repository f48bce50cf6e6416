"""The order-dependent helpers against plain pandas, with one key holding most rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n))
    t = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 900, n), unit="D")
    pdf = pd.DataFrame({"k": key, "t": t, "fixture": np.arange(n), "line": 1, "v": rng.integers(0, 9, n).astype(float)})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    pdf["season"] = pdf["t"].dt.year.astype(str)
    pdf["GW"] = pdf["t"].dt.month
    sdf = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).repartition(5)
    return pdf.sort_values(["k", "t", "fixture"]).reset_index(drop=True), sdf


def test_time_positions(skewed):
    pdf, sdf = skewed
    got = O.time_positions(sdf, ["k"], "t", ["fixture"], "p").select("fixture", "p").toPandas().set_index("fixture")["p"]
    want = pdf.groupby("k").cumcount() + 1
    assert (got.reindex(pdf["fixture"]).to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("chunk", [7, 50, 100_000])
def test_rolling_rows_do_not_depend_on_chunks(skewed, chunk):
    pdf, sdf = skewed
    got = O.rolling_rows(sdf, ["k"], "t", ["fixture"], {"m": ("avg", "v", 5)}, chunk=chunk).toPandas().set_index("fixture")["m"]
    want = pdf.groupby("k")["v"].transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean())
    np.testing.assert_allclose(got.reindex(pdf["fixture"]).to_numpy(), want.to_numpy(), equal_nan=True)


def test_rolling_before_period_is_frozen(skewed):
    pdf, sdf = skewed
    got = O.rolling_before_period(sdf, ["k"], ["season", "GW"], "t", ["fixture"], ["v"], (3, 6)).toPandas().set_index(["k", "season", "GW"])
    for w in (3, 6):
        pdf[f"w{w}"] = pdf.groupby("k")["v"].transform(lambda s, w=w: s.shift(1).rolling(w, min_periods=1).mean())
        first = pdf.groupby(["k", "season", "GW"]).head(1).set_index(["k", "season", "GW"])[f"w{w}"]
        np.testing.assert_allclose(got[f"v_{w}"].reindex(first.index).to_numpy(), first.to_numpy(), equal_nan=True)
    assert len(got) == len(first)


def test_percent_rank_uses_average_ties(skewed):
    pdf, sdf = skewed
    got = O.percent_rank_average(sdf, ["season"], "v", "p").toPandas().set_index("fixture")["p"]
    want = pdf.groupby("season")["v"].rank(pct=True)
    np.testing.assert_allclose(got.reindex(pdf["fixture"]).to_numpy(), want.to_numpy(), equal_nan=True)


def test_value_positions(skewed):
    pdf, sdf = skewed
    known = pdf.dropna(subset=["v"])
    got = O.value_positions(sdf.filter("v IS NOT NULL"), ["season"], "v", False, ["fixture"], O.value_bin("fixture"), "p").toPandas().set_index("fixture")["p"]
    want = known.sort_values(["v", "fixture"], ascending=[False, True]).groupby("season").cumcount() + 1
    assert (got.reindex(known["fixture"]).to_numpy() == want.reindex(known.index).to_numpy()).all()


def test_exact_quantiles(skewed):
    pdf, sdf = skewed
    got = O.exact_quantiles(sdf, ["season"], "v", [0.0, 0.25, 0.9, 1.0]).toPandas().set_index(["season", "q"])["v"]
    for (s, q), v in got.items():
        assert v == pytest.approx(np.nanquantile(pdf.loc[pdf["season"] == s, "v"], q))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_join(skewed, spark, direction, strict):
    pdf, sdf = skewed
    right = pdf[pdf["fixture"] % 3 == 0][["k", "t", "v"]].dropna().drop_duplicates(["k", "t"])
    rs = spark.createDataFrame(right.rename(columns={"v": "hit"}))
    got = O.asof_join(sdf.select("k", "t", "fixture"), rs, "t", ["k"], ["hit"], direction, strict, tie=["hit"]).toPandas().set_index("fixture")["hit"]
    want = pd.merge_asof(pdf.sort_values("t"), right.rename(columns={"v": "hit"}).sort_values("t"), on="t", by="k", direction=direction, allow_exact_matches=not strict).set_index("fixture")["hit"]
    np.testing.assert_allclose(got.reindex(want.index).to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True)


def test_previous_row_and_last_known(skewed):
    pdf, sdf = skewed
    prev = O.previous_row(sdf, ["k"], "t", ["fixture"], {"b": "fixture"}).toPandas().set_index("fixture")["b"]
    want = pdf.groupby("k")["fixture"].shift(1)
    np.testing.assert_allclose(prev.reindex(pdf["fixture"]).to_numpy(dtype=float), want.to_numpy(), equal_nan=True)
    last = O.last_known(sdf, ["k"], "t", ["fixture"], {"c": "v"}).toPandas().set_index("fixture")["c"]
    np.testing.assert_allclose(last.reindex(pdf["fixture"]).to_numpy(dtype=float), pdf.groupby("k")["v"].ffill().to_numpy(), equal_nan=True)


def test_sums_before(skewed):
    pdf, sdf = skewed
    got = O.sums_before(sdf.select("k", "t", "fixture"), sdf.select("k", "t", "v"), "t", ["k"], {"s": F.col("v"), "n": F.lit(1)}).toPandas().set_index("fixture")
    for f in pdf["fixture"].sample(60, random_state=0):
        me = pdf[pdf["fixture"] == f].iloc[0]
        before = pdf[(pdf["k"] == me["k"]) & (pdf["t"] < me["t"])]
        assert got.loc[f, "n"] == len(before) and got.loc[f, "s"] == pytest.approx(before["v"].sum())


def test_trailing_run(skewed):
    pdf, sdf = skewed
    got = O.trailing_run(sdf, ["k"], ["t", "fixture"], F.col("v") > 2, "run").toPandas().set_index("k")["run"]
    for k, g in pdf.groupby("k"):
        run = 0
        for v in reversed(g["v"].tolist()):
            if not v > 2:
                break
            run += 1
        assert got[k] == run


def test_ranges_hold_about_as_many_values_whatever_they_are(spark):
    """A million distinct values between 0 and 1, and as many spread over eighteen powers of ten."""
    df = spark.range(1_000_000).selectExpr("id", "(id * 7919 % 1000003) / 1000003D AS v").selectExpr("id % 2 AS k", "IF(id % 2 = 0, v, pow(10, 18 * v - 9)) AS v")
    sizes = O.value_ranges(df, ["k"], "v", "r").groupBy("k", "r").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "r").toPandas()
    for _, part in sizes.groupby("k"):
        assert len(part) > 0.95 * O.RANGES and part["n"].max() < 2.5 * 500_000 / O.RANGES
        assert (part["lo"].to_numpy()[1:] > part["hi"].to_numpy()[:-1]).all()


def test_ranks_of_few_values_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), (None, 2.0), ("b", None)], "k string, v double")
    got = {(r.k, r.v): (r.r_lt, r.r_eq, r.r_n) for r in O.value_ranks(df, ["k"], "v").collect()}
    assert got == {("a", 1.0): (0, 2, 3), ("a", 3.0): (2, 1, 3), (None, 2.0): (0, 1, 1), ("b", None): (None, None, None)}
    assert O.value_ranks(df.limit(0), ["k"], "v").count() == 0
    whole = {r.v: (r.lt, r.eq, r.n) for r in O.ranked_values(df, [], "v").collect()}
    assert whole == {1.0: (0, 2, 4), 2.0: (2, 1, 4), 3.0: (3, 1, 4)}
