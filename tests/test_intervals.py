"""Interval joins against all pairs, and plans without nested loops."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from origo.operators import activity, subscription
from origo.operators.intervals import interval_join, width_for
from origo.operators.windows import Window, in_gap, in_label, in_past

T0 = datetime(1969, 12, 28)


def at(hours):
    return T0 + timedelta(hours=hours, microseconds=hours % 3)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, at(i * 7 % 400)) for i in range(150)] + [(1000, None)]
    return spark.createDataFrame(rows, "i long, t timestamp_ntz")


@pytest.fixture(scope="module")
def intervals(spark):
    """That overlap, touch, leave gaps, are empty, are reversed, and have no bounds."""
    rows = [(k, at(k * 10), at(k * 10 + w)) for k, w in enumerate([10, 10, 10, 25, 3, 0, 40, 200, 1, 9])] + [(20, at(50), at(40)), (21, None, at(9)), (22, at(9), None), (23, at(-500), at(900))]
    return spark.createDataFrame(rows, "k long, a timestamp_ntz, b timestamp_ntz")


@pytest.mark.parametrize("hours", [1, 5, 10, 10_000])
@pytest.mark.parametrize("right", [False, True])
def test_pairs(points, intervals, hours, right):
    p, q = points.collect(), intervals.collect()
    want = sorted((x["i"], y["k"]) for x in p for y in q if None not in (x["t"], y["a"], y["b"]) and (y["a"] < x["t"] <= y["b"] if right else y["a"] <= x["t"] < y["b"]))
    for small in (None, points, intervals):
        got = interval_join(points, intervals, "t", "a", "b", timedelta(hours=hours), right_closed=right, small=small)
        assert got.columns == ["i", "t", "k", "a", "b"] and sorted((r["i"], r["k"]) for r in got.collect()) == want


def test_names_must_differ(points, intervals):
    with pytest.raises(ValueError):
        interval_join(points, intervals.withColumnRenamed("k", "i"), "t", "a", "b", timedelta(hours=1))


def test_width():
    assert width_for([]) == timedelta(hours=6) and width_for([timedelta(0)]) == timedelta(hours=1) and width_for([timedelta(days=8)] * 3) == timedelta(days=2)


def windows(n=5):
    return [Window(T0 + timedelta(days=3 * i), gap, 2) for i, gap in enumerate([1, 0, 4, 2, 1][:n])]


def test_windows(points):
    rows, w = points.collect(), windows()

    def pairs(df):
        return sorted((r["i"], r["as_of"]) for r in df.collect())

    def brute(a, b):
        return sorted((r["i"], x.as_of) for r in rows for x in w if r["t"] and a(x) <= r["t"] < b(x))

    assert pairs(in_past(points, w, "t", 4)) == brute(lambda x: x.as_of - timedelta(days=4), lambda x: x.as_of)
    assert pairs(in_label(points, w, "t")) == brute(lambda x: x.label_start, lambda x: x.label_end)
    assert pairs(in_gap(points, w, "t")) == brute(lambda x: x.as_of, lambda x: x.label_start)
    assert in_past(points, [], "t", 4).count() == 0


def test_counts_before(points):
    tx, w = points.withColumn("c", F.col("i") % 7).filter("t is not null"), windows()
    got = sorted(tuple(r) for r in activity.counts_before(tx, w, "n", key="c", time_col="t").collect())
    rows = tx.collect()
    want = [(x.as_of, c, sum(r["c"] == c and r["t"] < x.as_of for r in rows)) for x in w for c in range(7)]
    assert got == sorted(r for r in want if r[2])


def test_asof_join_bounds(spark, points):
    """Bounds of a row leave out just the origins outside of them."""
    rows, w = points.filter("t is not null").dropDuplicates(["t"]).withColumn("c", F.lit(1)), windows()
    whole = subscription.asof_join(rows, w, key="c", time_col="t")
    last = {x.as_of: max((r["t"] for r in rows.collect() if r["t"] < x.as_of), default=None) for x in w}
    assert sorted((r["as_of"], r["t"]) for r in whole.collect()) == sorted((a, t) for a, t in last.items() if t)
    near = subscription.asof_join(rows, w, key="c", time_col="t", until=F.col("t") + F.expr("interval 2 hours"))
    assert sorted((r["as_of"], r["t"]) for r in near.collect()) == sorted((a, t) for a, t in last.items() if t and a <= t + timedelta(hours=2))
    assert subscription.asof_join(rows, [], key="c", time_col="t").count() == 0


@pytest.mark.parametrize("name", ["eligible_counts", "lookback_counts", "subscription_panel", "person_period_panel", "gap_effect"])
def test_no_nested_loops(spark, name):
    from origo.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
