"""Fingerprints, draws, monotone maps, and tables of results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from origo.functions import normal, uniform
from origo.operators import calibration, compare


def frame(spark, rows, schema="k int, s string, x double"):
    return spark.createDataFrame(rows, schema)


def test_fingerprints(spark):
    rows = [(1, "a", 1.5), (2, None, float("nan")), (2, "null", None), (None, "", 0.0), (1, "a", 1.5)]
    base = compare.fingerprint(frame(spark, rows)).first()
    assert base["n"] == 5 and len(base["fingerprint"]) == 32
    same = [frame(spark, rows[::-1]).repartition(3), frame(spark, rows).select("x", "k", "s"), frame(spark, [*rows[:3], (None, "", -0.0), rows[4]])]
    assert all(compare.fingerprint(df).first() == base for df in same)
    other = [rows[:4], [*rows[:4], (2, None, float("nan"))], [(1, "a", 1.5), (2, "null", float("nan")), (2, None, None), *rows[3:]], [*rows[:1], (2, None, None), (2, "null", float("nan")), *rows[3:]], [*rows[:3], (None, None, 0.0), rows[4]]]
    assert all(compare.fingerprint(frame(spark, r)).first()["fingerprint"] != base["fingerprint"] for r in other)
    assert compare.fingerprint(frame(spark, rows).withColumnRenamed("x", "y")).first() != base
    # Swapped values of two columns, and values that run into the next column.
    two = lambda r: compare.fingerprint(frame(spark, r, "a string, b string")).first()
    assert two([("x", "y"), ("u", "v")]) != two([("x", "v"), ("u", "y")]) and two([("a|b=v1:c", "d")]) != two([("a", "b=v1:c|d")])
    assert compare.fingerprint(frame(spark, [])).first() == (0, "0" * 32)
    nested = spark.createDataFrame([([1, None], {"a": 1}, bytearray(b"\x00"))], "l array<int>, m map<string,int>, b binary")
    assert compare.fingerprint(nested).first() != compare.fingerprint(nested.withColumn("l", F.array(F.lit(1)))).first()


def test_a_run_that_differs_is_told(spark):
    df = frame(spark, [(1, "a", 1.0)])
    saved = compare.fingerprint(df).first().asDict()
    compare.assert_reproduced(df, saved)
    with pytest.raises(ValueError):
        compare.assert_reproduced(df.withColumn("x", F.lit(1.0 + 1e-12)), saved)
    assert compare.same_rows(df, df.select("x", "s", "k")) and not compare.same_rows(df, df.unionByName(df))


def test_draws(spark):
    df = spark.range(40_000).select("id", uniform(7, "id").alias("u"), normal(7, "id").alias("z"), uniform(8, "id").alias("v"))
    rows = df.collect()
    u, z, v = (np.array([r[c] for r in rows]) for c in "uzv")
    assert ((u >= 0) & (u < 1)).all() and np.isfinite(z).all() and len(set(u)) == len(u)
    counts = np.bincount((u * 50).astype(int), minlength=50)
    assert ((counts - 800) ** 2 / 800).sum() < 110  # chi-squared of 49 degrees, one in a million
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(u, v)[0, 1]) < 0.03 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.03
    again = {r["id"]: (r["u"], r["z"]) for r in df.repartition(13).collect()}
    assert all(again[r["id"]] == (r["u"], r["z"]) for r in rows)


def brute_isotonic(y, p, at):
    """By min-max over all ranges of distinct scores, linear between them."""
    xs = sorted(set(p))
    s, w = [sum(a for a, b in zip(y, p) if b == x) for x in xs], [sum(b == x for b in p) for x in xs]
    mean = lambda j, k: sum(s[j : k + 1]) / sum(w[j : k + 1])
    fit = [max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]
    return np.interp(at, xs, fit)


@pytest.mark.parametrize("seed", range(4))
def test_isotonic(spark, seed):
    dice = np.random.default_rng(seed)
    p = np.round(dice.random(120), [1, 2, 6, 6][seed])
    y = (dice.random(120) < [p, 1 - p, p**2, np.ones(120)][seed]).astype(int)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double").repartition(4)
    at = [-1.0, 0.0, *sorted(dice.random(30)), *p[:10], 1.0, 2.0]
    asked = spark.createDataFrame([(i, float(x)) for i, x in enumerate(at)] + [(-1, None)], "i int, p double")
    got = {r["i"]: r["calibrated"] for r in calibration.Isotonic.fit(df).transform(asked).collect()}
    assert got.pop(-1) is None
    assert np.allclose([got[i] for i in range(len(at))], brute_isotonic(y.tolist(), p.tolist(), at), atol=1e-12)


def test_isotonic_of_nothing(spark):
    none = spark.createDataFrame([], "y int, p double")
    assert calibration.Isotonic.fit(none).transform(spark.createDataFrame([(0.5,)], "p double")).first()["calibrated"] is None


def test_tables(spark):
    rows = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 5.0), ("b", "y", None)]
    df = spark.createDataFrame(rows, "g string, v string, n double")
    assert sorted(map(tuple, compare.pivoted_means(df, "g", "v", ["x", "y"], "n").collect())) == [("a", 2.0, 5.0), ("b", None, None)]
    wide = spark.createDataFrame([(1, 10, 0.5), (2, 20, None)], "i int, n int, r double")
    assert sorted(map(tuple, compare.transposed(wide, "i", ["n", "r"], [1, 2, 3], total="all").collect())) == [("n", 10.0, 20.0, None, 30.0), ("r", 0.5, None, None, 0.5)]
    told = compare.looked_up(df, "v", {"x": 7}, "code", 0)
    assert sorted(r["code"] for r in told.collect()) == [0, 0, 7, 7] and "Join" not in told._jdf.queryExecution().executedPlan().toString()
    assert {r["code"] for r in compare.looked_up(df, "v", {"x": 7}, "code").collect()} == {7, None} and compare.looked_up(df, "v", {}, "code").filter("code is not null").count() == 0
    spread = compare.summary(df, "n", ["g"]).orderBy("g").collect()
    assert spread[0][1:] == (3.0, 2.0, 1.0, 5.0) and spread[1][1:] == (None, None, None, None) and math.isclose(spread[0]["std"], 2.0)
