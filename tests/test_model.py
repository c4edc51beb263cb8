"""Boosted trees over counts: additive over origins, whatever the order of rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from origo.operators import backtest, model
from origo.operators.windows import Window


def test_counts_are_all_that_a_fit_reads():
    """Cells with their counts, and the rows one by one, give the same trees."""
    dice = np.random.default_rng(1)
    bins = dice.integers(0, 4, (400, 2))
    y = (dice.random(400) < np.where(bins[:, 0] > 1, 0.8, 0.3)).astype(int)
    cells, of = np.unique(bins, axis=0, return_inverse=True)
    n, s = np.bincount(of), np.bincount(of, y)
    by_row = model.boosted(bins, np.ones(400), y, trees=4, depth=2)
    by_cell = model.boosted(cells, n, s, trees=4, depth=2)
    assert (by_row.feature == by_cell.feature).all() and (by_row.cut == by_cell.cut).all() and np.allclose(by_row.leaf, by_cell.leaf)
    turn = dice.permutation(len(cells))
    again = model.boosted(cells[turn], n[turn], s[turn], trees=4, depth=2)
    assert np.array_equal(again.leaf, by_cell.leaf)
    assert by_cell.feature[0][0] == 0 and by_cell.cut[0][0] == 1 and by_cell.gains[0] > by_cell.gains[1]


def test_first_split_is_the_best_of_all():
    dice = np.random.default_rng(2)
    bins, y = dice.integers(0, 6, (300, 3)), dice.integers(0, 2, 300)
    tree = model.boosted(bins, np.ones(300), y, trees=1, depth=1, rate=1.0)
    p = y.mean()

    def gain(f, c):
        left = bins[:, f] <= c
        return -np.inf if min(left.sum(), (~left).sum()) < model.LEAST_ROWS else sum((y[m] - p).sum() ** 2 / m.sum() for m in (left, ~left))

    best = max(((f, c) for f in range(3) for c in range(6)), key=lambda x: (round(gain(*x), 9), -x[0], -x[1]))
    assert (tree.feature[0][0], tree.cut[0][0]) == best


def test_depth_needs_both_features():
    """Which of two features matters depends on the other: one level can't tell."""
    bins = np.array([[a, b] for a in (0, 1) for b in (0, 1, 2)])
    n, s = np.full(6, 100), np.array([90, 10, 10, 10, 90, 90])
    deep = model.boosted(bins, n, s, trees=40, depth=2, rate=0.5)
    assert np.abs(deep.probability(bins) - s / n).max() < 0.02
    flat = model.boosted(bins, n, s, trees=40, depth=1, rate=0.5)
    assert np.abs(flat.probability(bins) - s / n).max() > 0.2


@pytest.fixture(scope="module")
def panel(spark):
    w = [Window(datetime(2020, 1, 1) + timedelta(days=40 * i), 7, 30) for i in range(5)]
    dice = np.random.default_rng(3)
    rows = [(k, x.as_of, float(v), None if k % 9 == 0 else float("nan") if k % 9 == 1 else float(k % 5), int(dice.random() < (0.2 if v < 0 else 0.7))) for x in w for k, v in enumerate(dice.normal(size=150))]
    return w, spark.createDataFrame(rows, "customer_id long, as_of timestamp_ntz, a double, b double, churned int").repartition(3)


def test_all_origins_at_once_is_each_alone(panel):
    w, df = panel
    plan = backtest.training_plan(w)
    edges = backtest._edges(df, w, ["a", "b"])
    models = model.fit_windows(df, plan, ["a", "b"], edges=edges, trees=3, depth=2)
    assert sorted(models) == [x.as_of for x in w[1:]]
    for i, x in enumerate(w[1:], 1):
        alone, mature = backtest.fit_at_origin(df.repartition(5), w, i, ["a", "b"], trees=3, depth=2)
        assert [m.as_of for m in mature] == plan[x.as_of] and np.array_equal(alone.trees.leaf, models[x.as_of].trees.leaf)
    told = model.predict_windows(models, df, ["a", "b"])
    one = model.predict(models[w[3].as_of], df.filter(F.col("as_of") == F.lit(w[3].as_of)), ["a", "b"])
    got = {r["customer_id"]: r["p"] for r in told.filter(F.col("as_of") == F.lit(w[3].as_of)).collect()}
    assert got == {r["customer_id"]: r["p"] for r in one.collect()} and told.filter(F.col("as_of") == F.lit(w[0].as_of)).count() == 0
    sliding = backtest.training_plan(w, max_lookback_days=40)
    assert all(len(v) == 1 for v in sliding.values()) and len(backtest.training_plan(w, purge=False)[w[4].as_of]) == 4


def test_missing_values_and_single_classes(spark, panel):
    w, df = panel
    edges = model.cut_points(df, ["a", "b"])
    counts = model.cells(df, ["a", "b"], "churned", edges, [])
    assert counts.agg(F.sum("n")).first()[0] == df.count() and counts.filter(F.col("_b1") == len(edges[1]) + 1).agg(F.sum("n")).first()[0] == sum(k % 9 < 2 for k in range(150)) * 5
    for label in (0, 1):
        fitted = model.fit(df.withColumn("churned", F.lit(label)), ["a"])
        assert {r["p"] for r in model.predict(fitted, df, ["a"]).collect()} == {float(label)} and fitted.importances(["a"]) == {"a": 0.0}
    assert model.fit_windows(df, {}, ["a"], edges=edges[:1]) == {} and model.predict_windows({}, df, ["a"]).count() == 0
    assert model.most_bins(1) == 32 and model.most_bins(4) == 32 and model.most_bins(6) == 10 and model.most_bins(6) ** 6 <= model.CELLS
