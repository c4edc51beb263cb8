"""Order statistics, ranks and splits against sorting everything."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from origo.operators import compare, leakage, selection


def made(seed=1, n=3000):
    dice = random.Random(seed)
    kinds = [lambda: dice.gauss(0, 1), lambda: float(dice.randint(0, 3)), lambda: 7.0, lambda: dice.expovariate(1) ** 4, lambda: None]
    return [(i, g, kinds[g % 5]() if g < 9 else (float(i) if i % 2 else None)) for i in range(n) for g in [dice.randint(0, 10)]] + [(n, 99, 5.0)]


def test_quantiles(spark):
    rows = made()
    df = spark.createDataFrame(rows, "i long, g int, v double").repartition(4)
    shares = {"low": 0.0, "odd": 0.137, "mid": 0.5, "high": 0.999, "top": 1.0}
    for by in ([], ["g"]):
        got = {r["g"] if by else None: r for r in selection.quantiles(df, "v", shares, by).collect()}
        groups = {g: [v for _, x, v in rows if v is not None and (not by or x == g)] for g in ({x for _, x, _ in rows} if by else {None})}
        groups = {g: v for g, v in groups.items() if v}
        assert set(got) == set(groups)
        for g, values in groups.items():
            assert got[g]["n"] == len(values)
            for name, q in shares.items():
                assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)
    assert selection.medians(df.limit(0), "v").collect() == [] or selection.medians(df.limit(0), "v").first()["median"] is None
    assert selection.medians(df.limit(0), "v", ["g"]).count() == 0


def test_plan_has_no_percentile_of_all_values(spark):
    df = spark.createDataFrame(made(), "i long, g int, v double")
    plan = selection.medians(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


@pytest.mark.parametrize("n", [0, 1, 5, 4000])
def test_ranks(spark, n):
    dice = random.Random(n)
    rows = [(i, dice.choice([0.5, 0.5, dice.random()])) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, p double").repartition(5)
    found = selection.ranked(df, [-F.col("p"), F.col("i")], "place")
    want = {i: k for k, (_, i) in enumerate(sorted((-p, i) for i, p in rows), 1)}
    assert {r["i"]: r["place"] for r in found.collect()} == want and found.columns == ["i", "p", "place"]


def test_rank_plan_is_spread(spark):
    df = spark.range(100).selectExpr("id", "id * 37 % 100 / 100.0D as p", "id * 11 % 100 / 100.0D as q")
    told = compare.rank_differences(df, "p", "q", "id", 10)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "rank" not in plan.lower().split("window", 1)[0]
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("_r#" in line for line in windows)
    rank = lambda c: {r["id"]: k for k, r in enumerate(sorted(df.collect(), key=lambda r: (-r[c], r["id"])), 1)}
    a, b = rank("p"), rank("q")
    assert tuple(told.first()) == (sum(a[i] != b[i] for i in a), sum(a[i] <= 10 < b[i] for i in a))


@pytest.mark.parametrize("share", [0.0, 0.2, 0.35, 1.0])
def test_stratified_split_is_exact(spark, share):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1000)] + [(5000, 2)], "i long, y int").repartition(3)
    split = leakage.stratified_split(df, "y", ["i"], share, 5)
    told = {r["y"]: (r["n"], r["t"]) for r in split.groupBy("y").agg(F.count("i").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == math.floor(share * n) for n, t in told.values()) and len(told) == 3
    again = leakage.stratified_split(df.repartition(7), "y", ["i"], share, 5).filter("is_test")
    assert sorted(r["i"] for r in again.collect()) == sorted(r["i"] for r in split.filter("is_test").collect())
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "percent_rank" not in plan
