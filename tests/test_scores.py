from datetime import datetime as D
from datetime import timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from origo.operators import backtest, calibration, leakage, metrics, model
from origo.operators.windows import Window, origins_frame


def frame(spark, y, p):
    return spark.createDataFrame(list(zip(y, map(float, p))), "y int, p double")


def test_score(spark):
    r = metrics.score(frame(spark, [0, 1, 1, 0], [0.2, 0.8, 0.6, 0.4])).first()
    assert (r["n"], r["prevalence"], r["roc_auc"], r["pr_auc"], round(r["brier"], 9)) == (4, 0.5, 1.0, 1.0, 0.1)
    tied = metrics.score(frame(spark, [0, 1, 0, 1], [0.1, 0.5, 0.5, 0.9])).first()
    assert tied["roc_auc"] == 0.875 and round(tied["pr_auc"], 9) == round((1 + 2 / 3) / 2, 9)
    assert metrics.score(frame(spark, [1, 1], [0.1, 0.5])).first()["roc_auc"] is None
    with pytest.raises(ValueError):
        metrics.check_probabilities(frame(spark, [1], [1.5]), "p")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=40))
def test_score_against_pairs(spark, rows):
    y, p = [r[0] for r in rows], [r[1] / 20 for r in rows]
    r = metrics.score(frame(spark, y, p)).first()
    pairs = [(a > b) + (a == b) / 2 for a, i in zip(p, y) if i for b, j in zip(p, y) if not j]
    assert (r["roc_auc"] is None) == (not pairs)
    if pairs:
        assert abs(r["roc_auc"] - sum(pairs) / len(pairs)) < 1e-9


def test_values(spark):
    df = frame(spark, [1, 0, 1, 0], [0.9, 0.6, 0.5, 0.1])
    offer = {"offer_cost": 1.0, "saved_margin": 10.0, "save_rate": 0.5}
    assert (metrics.expected_value(df, 0.5, **offer), metrics.expected_value(df, 0.0, **offer)) == (7.0, 6.0)
    swept = metrics.sweep_expected_value(df, [0.95, 0.0, 0.5], **offer).orderBy("threshold").collect()
    assert [tuple(r) for r in swept] == [(0.0, 4, 6.0), (0.5, 3, 7.0), (0.95, 0, 0.0)]
    with pytest.raises(ValueError):
        metrics.expected_value(df, 0.5, offer_cost=1.0, saved_margin=1.0, save_rate=1.5)
    assert metrics.break_even_threshold(2.5, 16, 0.25) == 0.625


def test_reliability(spark):
    df = frame(spark, [0, 0, 1, 1, 1, 1, 0, 1], [0.25] * 4 + [0.75] * 4)
    bins = calibration.reliability_table(df, n_bins=2).orderBy("bin").collect()
    assert [tuple(b)[3:] for b in bins] == [(4, 0.25, 0.5), (4, 0.75, 0.75)]
    edge = calibration.reliability_table(frame(spark, [0, 1, 1], [0.0, 0.5, 1.0]), n_bins=2).orderBy("bin").collect()
    assert [(b["bin"], b["n"]) for b in edge] == [(0, 2), (1, 1)]
    d = calibration.brier_decomposition(df, n_bins=2).first()
    assert [round(x, 6) for x in d] == [0.03125, 0.015625, 0.234375, 0.25]


def test_maps(spark):
    df = frame(spark, [1, 0, 1], [0.1, 0.2, 0.3])
    fitted = calibration.Isotonic.fit(df).transform(frame(spark, [0] * 4, [0.1, 0.2, 0.3, 0.9]))
    assert [round(r["calibrated"], 6) for r in fitted.orderBy("p").collect()] == [0.5, 0.5, 1.0, 1.0]
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4])  # the other labels lie evenly around their middle
    rising = calibration.Platt.fit(df).transform(df).orderBy("p").collect()
    assert rising[0]["calibrated"] < rising[3]["calibrated"]


def test_leakage(spark):
    df = spark.createDataFrame([(0, 1.0, 9.0, 1.0), (0, 2.0, 8.0, 3.0), (1, 3.0, 7.0, 2.0), (1, 4.0, 6.0, 4.0)], "churned int, up double, down double, part double")
    assert {r[0]: r[1] for r in leakage.single_feature_auc(df, ["up", "down", "part"]).collect()} == {"up": 1.0, "down": 1.0, "part": 0.75}
    with pytest.raises(ValueError):
        leakage.assert_no_dominant_single_feature(df, ["up"])
    leakage.assert_no_dominant_single_feature(df, ["part"])
    a, b = spark.createDataFrame([(1,), (2,)], "customer_id int"), spark.createDataFrame([(2,), (3,), (4,)], "customer_id int")
    assert tuple(leakage.customer_overlap(a, b).first())[:3] == (2, 3, 1)


def windows(n, step=30, horizon=30):
    return [Window(D(2011, 1, 1) + timedelta(days=i * step), 7, horizon) for i in range(n)]


def panel(spark, ws, flip=()):
    rows = [(f"c{k}", w.as_of, k / 100 + i * 1e-4, int((k > 50) != (i in flip))) for i, w in enumerate(ws) for k in range(100)]
    return spark.createDataFrame(rows, "customer_id string, as_of timestamp_ntz, signal double, churned int")


def test_plan_is_one_rule(spark):
    ws = windows(6)
    plan = {r["test_as_of"]: r["n_train"] for r in backtest.origin_plan(origins_frame(spark, ws)).collect()}
    alone = {w.as_of: len(backtest.mature_origins(ws, w)) for w in ws[1:]}
    assert plan == {k: v for k, v in alone.items() if v}
    assert backtest.mature_origins(ws, ws[-1], max_lookback_days=20) == []


def test_maturity_skips(spark):
    ws = windows(3, 30, 50)  # labels end after 57 days: only the first is final at the third
    per_origin, predictions = backtest.rolling_origin_backtest(panel(spark, ws), ws, ["signal"], trees=2, depth=2)
    assert [r["as_of"] for r in per_origin.collect()] == [ws[2].as_of] and predictions.count() == 100
    empty, _ = backtest.rolling_origin_backtest(panel(spark, ws[:2]), ws[:2], ["signal"])
    assert empty.count() == 0
    with pytest.raises(ValueError):
        backtest.fit_at_origin(panel(spark, ws), ws, 1, ["signal"])


def test_frozen_model_meets_a_flip(spark):
    ws = windows(5, 40)
    per_origin, _ = backtest.frozen_model_backtest(panel(spark, ws, flip=(4,)), ws, ["signal"], trees=3, depth=2)
    found = {r["origins_since_training"]: r["roc_auc"] for r in per_origin.collect()}
    assert found[0] > 0.9 and found[3] < 0.1


def test_hazard_backtest(spark):
    ws = windows(3, 40)
    rows = panel(spark, ws)
    back = rows.filter("churned = 0").select("customer_id", F.timestamp_add("DAY", F.lit(10), F.col("as_of")).alias("t"))
    per_origin, predictions = backtest.hazard_rolling_origin_backtest(rows, back, ws, ["signal"], time_col="t", period_days=10, min_training_origins=2, trees=3, depth=2)
    one = per_origin.first()
    assert one["n"] == 100 and one["roc_auc"] > 0.9
    assert predictions.filter("p < 0 or p > 1").count() == 0


def test_ablation_and_adversary(spark):
    ws = windows(2, 40)
    rows = panel(spark, ws).withColumn("noise", F.rand(3))
    one = F.col("as_of") == F.lit(ws[0].as_of)
    found = leakage.ablation_auc(rows.filter(one), rows.filter(~one), ["signal", "noise"], seed=1)
    assert found["all features"] > 0.95 and found["drop noise"] > 0.95 and found["drop signal"] < 0.7
    apart, _ = leakage.adversarial_auc(rows.filter(one), rows.filter(one).withColumn("signal", F.col("signal") + 5), ["signal"], seed=1)
    alike, _ = leakage.adversarial_auc(rows.filter(one), rows.filter(~one), ["noise"], seed=1, group_col="customer_id")
    assert apart > 0.95 and alike < 0.8


def test_one_class_model(spark):
    fitted = model.fit(spark.createDataFrame([(1.0, 1)], "x double, churned int"), ["x"])
    assert model.predict(fitted, spark.createDataFrame([(2.0,)], "x double"), ["x"]).first()["p"] == 1.0
