"""Fits, splits and metrics that read counts of cells in place of rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from origo.operators import backtest, compare, hazard, leakage, metrics, model
from origo.operators.windows import Window

AB = ["a", "b"]
OFFER = {"offer_cost": 2.5, "saved_margin": 16.0, "save_rate": 0.25}


@pytest.fixture(scope="module")
def panel(spark):
    w = [Window(datetime(2020, 1, 1) + timedelta(days=40 * i), 7, 30) for i in range(4)]
    dice = np.random.default_rng(5)
    rows = [(k, x.as_of, float(v), None if k % 9 == 0 else float("nan") if k % 9 == 1 else float(k % 5), int(dice.random() < (0.2 if v < 0 else 0.7))) for x in w for k, v in enumerate(dice.normal(size=150))]
    return w, spark.createDataFrame(rows, "customer_id long, as_of timestamp_ntz, a double, b double, churned int").repartition(3).persist()


def plan(df):
    return df._jdf.queryExecution().toString()


def close(a, b, keys):
    a, b = (sorted((r.asDict() for r in df.collect()), key=lambda r: [r[k] for k in keys]) for df in (a, b))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x.keys() == y.keys() and all(x[c] == y[c] if not isinstance(y[c], float) else abs(x[c] - y[c]) < 1e-12 for c in y)


def test_bins_are_compiled_and_count_cuts_below(panel, spark):
    _, df = panel
    edges = (-1.5, 0.0, 0.0, 2.0, 7.0)
    values = [None, float("nan"), -9.0, -1.5, -0.0, 0.0, 1e-9, 2.0, 2.1, 7.0, 8.0, float("inf")]
    got = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(model.bin_of_value(F.col("v"), edges).alias("x")).collect()]
    assert got == [6 if v is None or v != v else sum(e < v for e in edges) for v in values]
    assert "lambda" not in plan(model.cells(df, AB, "churned", (edges, edges), []))


def test_a_backtest_scores_cells(panel):
    w, df = panel
    per_origin, predictions = backtest.rolling_origin_backtest(df, w, AB, trees=3, depth=2)
    close(per_origin, metrics.score(predictions, "churned", "p", ["as_of"]), ["as_of"])
    assert "customer_id" not in plan(per_origin).split("== Optimized Logical Plan ==")[1].split("InMemoryRelation")[0]
    frozen, rows = backtest.frozen_model_backtest(df, w, AB, trees=3, depth=2)
    close(frozen.drop("origins_since_training"), metrics.score(rows, "churned", "p", ["as_of"]), ["as_of"])
    swept = compare.sliding_sweep(df, w, AB, [40, 100], trees=3, depth=2)
    for r in swept.collect():
        _, told = backtest.rolling_origin_backtest(df, w, AB, max_lookback_days=r["lookback_days"], trees=3, depth=2)
        close(swept.filter(F.col("lookback_days") == r["lookback_days"]).drop("lookback_days"), metrics.score(told, "churned", "p"), ["n"])
    assert swept.count() == 2


def test_a_hazard_backtest_scores_cells(panel):
    w, df = panel
    tx = df.select("customer_id", F.timestamp_add("DAY", (F.lit(7) + F.col("customer_id") % 30).cast("int"), F.col("as_of")).alias("t")).filter("customer_id % 3 = 0")
    per_origin, rows = backtest.hazard_rolling_origin_backtest(df, tx, w, AB, time_col="t", period_days=10, trees=3, depth=2)
    close(per_origin, metrics.score(rows, "churned", "p", ["as_of"]), ["as_of"])


def test_splits_of_several_seeds_in_one_pass(panel):
    _, df = panel
    edges = model.cut_points(df, AB)
    some = df.unionByName(df.filter("customer_id < 40")).withColumn("churned", F.when(F.col("customer_id") != 7, F.col("churned")))  # repeated ids, a class of nulls
    for share in (0.2, 0.001, 1.0):
        found = leakage.split_cells(some, AB, "churned", ["customer_id", "as_of"], share, [1, 2], edges)
        for i, seed in enumerate([1, 2]):
            split = leakage.stratified_split(some, "churned", ["customer_id", "as_of"], share, seed)
            said = model.cells(split, AB, "churned", edges, ["is_test"])
            mine = found.filter(F.col("_split") == i).select(*said.columns)
            told = lambda x: sorted(tuple(r)[:-1] + (r["positive"] or 0,) for r in x.collect())
            assert told(mine) == told(said)


def test_only_rows_that_reach_a_budget_are_sorted(spark):
    rows = [(g, i, (i * 7 % 10) / 10 if i % 11 else None, i % 2) for g, n in (("a", 400), ("b", 30), ("c", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, p double, y int").repartition(3)
    found = metrics.budget_value(df, [5, 29, 60], "i", by=["g"], **OFFER)
    for r in found.collect():
        order = sorted((x for x in rows if x[0] == r["g"]), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))[: r["budget"]]
        assert (r["n_targeted"], r["churners"], r["expected_value"]) == (len(order), sum(x[3] for x in order), 4.0 * sum(x[3] for x in order) - 2.5 * len(order))
    assert found.count() == 9 and "_cut" in plan(found)


def test_bins_of_many_cuts_are_no_longer_than_of_few(panel):
    _, df = panel
    few, many = (len(plan(model.cells(df, AB, "churned", (edges, edges), []))) for edges in ((0.5,), tuple(i / 10 for i in range(30))))
    assert many < few * 1.1  # one comparison a cut made a method that the JVM interprets


def test_cells_of_person_periods_without_a_row_for_each(panel):
    w, df = panel
    tx = df.select("customer_id", F.timestamp_add("DAY", (F.lit(7) + F.col("customer_id") % 35).cast("int"), F.col("as_of")).alias("t")).filter("customer_id % 3 = 0")
    tx = tx.unionByName(tx)  # repeated events
    edges = (*model.cut_points(df, AB), (1.0, 1.0, 2.0))
    counts = backtest._event_cells(df, tx, w, AB, edges, ["as_of"], "t", "customer_id", 10)
    found = backtest._period_cells(counts, ["as_of"], edges, 3)
    rows = model.cells(hazard.person_periods(tx, w, df, AB, time_col="t", period_days=10), [*AB, "period"], "event", edges, ["as_of"])
    told = lambda x: sorted(tuple(r) for r in x.select(*rows.columns).collect())
    assert told(found) == told(rows) and found.agg(F.sum("positive")).first()[0] > 0
    assert counts.agg(F.sum("n")).first()[0] == df.count()


def test_hazard_cut_points_are_of_all_mature_origins(panel):
    """And each model of the backtest is the one that is fitted at its origin."""
    w, df = panel
    moved = df.withColumn("a", F.col("a") + F.month("as_of")).persist()  # each origin has values of its own
    tx = df.select("customer_id", F.timestamp_add("DAY", (F.lit(7) + F.col("customer_id") % 35).cast("int"), F.col("as_of")).alias("t")).filter("customer_id % 3 = 0")
    options = dict(time_col="t", period_days=10, trees=3, depth=2)
    _, predictions = backtest.hazard_rolling_origin_backtest(moved, tx, w, AB, **options)
    for target in (1, 3):
        fitted, mature = backtest.fit_hazard_at_origin(moved, tx, w, target, AB, **options)
        assert len(mature) == target
        rows = hazard.person_periods(tx, mature, moved.filter(F.col("as_of") < F.lit(w[target].as_of)), AB, time_col="t", period_days=10).toPandas()
        bins = model.most_bins(3) - 1
        for c, cuts in zip([*AB, "period"], fitted.edges):
            values = rows[c].dropna().to_numpy(dtype=float)
            assert np.allclose(cuts, np.quantile(values, [i / bins for i in range(1, bins)]), atol=1e-12)
        last = moved.filter(F.col("as_of") == F.lit(w[target].as_of))
        both = backtest.predict_survival(fitted, last, AB, 3).join(predictions, ["as_of", "customer_id"])
        assert both.filter(F.abs(F.col("survival") - F.col("p")) < 1e-12).count() == last.count() == 150
    assert model.window_cut_points(moved.select("as_of", F.lit(0).alias("f"), F.lit(None).cast("double").alias("v"), F.lit(1).cast("long").alias("n")), {w[1].as_of: [w[0].as_of]}, 1) == {w[1].as_of: ((),)}
