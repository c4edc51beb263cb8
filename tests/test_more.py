"""Parts of the panel library that have no query of their own."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from origo import sources
from origo.operators import backtest, calibration, hazard, metrics
from origo.operators.windows import Window, rolling_origins


def test_scores_must_be_probabilities(spark):
    df = spark.createDataFrame([(1, 2.5), (0, -1.0)], "y int, p double")
    with pytest.raises(ValueError):
        metrics.score(df)
    with pytest.raises(ValueError):
        metrics.score(spark.createDataFrame([(1, None)], "y int, p double"))


def test_points_and_optimum(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.8), (1, 0.6), (0, 0.4)], "y int, p double")
    got = [tuple(round(x, 6) for x in r) for r in metrics.points(df).orderBy(F.desc("threshold")).collect()]
    assert got == [(0.8, 0.0, 0.5, 1.0), (0.6, 0.0, 1.0, 1.0), (0.4, 0.5, 1.0, round(2 / 3, 6)), (0.2, 1.0, 1.0, 0.5)]
    best = metrics.peeked_optimum(df, [0.0, 0.5, 0.9], offer_cost=1, saved_margin=10, save_rate=0.5).first()
    assert (best["threshold"], best["n_targeted"], best["expected_value"]) == (0.5, 2, 8.0)


def test_winner_by_bins(spark):
    rows = [("good", y, p) for y, p in [(0, 0.1), (0, 0.1), (1, 0.9), (1, 0.9)]] + [("bad", y, 0.9 - 0.8 * y) for y in (0, 0, 1, 1)]
    found = calibration.winner_by_bins(spark.createDataFrame(rows, "variant string, y int, p double"), "variant", (5, 10)).collect()
    assert {(r["n_bins"], r["winner"]) for r in found} == {(5, "good"), (10, "good")} and all(round(r["reliability"], 6) == 0.01 for r in found)


def test_hazard_events_leave_out_cancellations(spark):
    w = Window(datetime(2016, 6, 1), 0, 30)
    tx = spark.createDataFrame([("a", datetime(2016, 6, 5), 1), ("b", datetime(2016, 6, 5), 0)], "customer_id string, transaction_date timestamp_ntz, is_cancel int")
    found = hazard.first_event_period(hazard.renewals(tx), [w], time_col="transaction_date", period_days=10).collect()
    assert [(r["customer_id"], r["period"]) for r in found] == [("b", 1)]


def test_fit_hazard_at_origin_is_the_backtest(spark):
    windows = rolling_origins(datetime(2016, 1, 1), datetime(2016, 5, 1), gap_days=0, horizon_days=30, step_days=30)
    rows, tx = [], []
    for w in windows:
        for c in range(60):
            stays = c % 2
            rows.append((c, w.as_of, float(stays) + c / 1000, 1 - stays))
            if stays:
                tx.append((c, w.as_of + timedelta(days=5)))
    panel = spark.createDataFrame(rows, "customer_id int, as_of timestamp_ntz, signal double, churned int")
    events = spark.createDataFrame(tx, "customer_id int, event_date timestamp_ntz")
    options = dict(time_col="event_date", period_days=10, trees=3, depth=2)
    _, predictions = backtest.hazard_rolling_origin_backtest(panel, events, windows, ["signal"], min_training_origins=len(windows) - 1, **options)
    fitted, mature = backtest.fit_hazard_at_origin(panel, events, windows, len(windows) - 1, ["signal"], **options)
    last = panel.filter(F.col("as_of") == F.lit(windows[-1].as_of))
    same = backtest.predict_survival(fitted, last, ["signal"], 3).join(predictions, ["as_of", "customer_id"]).filter(F.abs(F.col("survival") - F.col("p")) < 1e-12).count()
    assert same == 60 and mature == windows[:-1]
    train, test = backtest.holdout_after(panel, windows)
    assert (train.count(), test.count()) == (60 * (len(windows) - 1), 60)
    with pytest.raises(ValueError):
        backtest.fit_hazard_at_origin(panel, events, windows, 0, ["signal"], **options)


def test_headline_and_sql(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no_gap"):
        sources.load_headline(str(tmp_path))
    for name, auc, brier in (("naive", 0.9, 0.1), ("no_gap", 0.8, 0.15), ("honest", 0.75, 0.2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"roc_auc": auc, "pr_auc": auc, "brier": brier}))
    (tmp_path / "calibration.json").write_text(json.dumps({"platt": {"brier_raw": 0.2}}))
    found = sources.load_headline(str(tmp_path))
    assert found["naive_auc_gap"] == pytest.approx(0.15) and found["no_gap_brier_worse"] == pytest.approx(1 / 3) and found["arms"]["honest"]["brier"] == 0.2
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert sources.sql_scalar(df, "some_rows", "SELECT sum(x) FROM some_rows") == 3
    with pytest.raises(ValueError):
        sources.sql_scalar(df, "some_rows", "SELECT x FROM some_rows")
