from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from origo.operators import activity, cleaning, hazard, subscription
from origo.operators.windows import Window

TX = "invoice string, customer_id long, invoice_date timestamp_ntz, revenue double"


def tx(spark, rows):
    return spark.createDataFrame(rows, TX)


def test_asof_rfm(spark):
    rows = [("A", 401, D(2011, 3, 1), 10.0), ("A", 401, D(2011, 3, 1), 5.0), ("B", 401, D(2011, 3, 20), 10.0), ("C", 401, D(2011, 4, 1), 99.0), ("D", 402, D(2011, 2, 1), 100.0)]
    found = activity.asof_features(tx(spark, rows), [Window(D(2011, 4, 1))]).orderBy("customer_id").collect()
    assert [tuple(r)[1:] for r in found] == [(401, 12, 2, 25.0), (402, 59, 1, 100.0)]


def test_running_state_equals_each_origin_alone(spark):
    rows = [(str(i // 2), i % 3, D(2011, 1 + i % 11, 1 + i % 27, i % 24), float(i)) for i in range(60)]
    many = [Window(D(2011, m, 15)) for m in (2, 5, 8, 11)]
    events = tx(spark, rows)
    got = {tuple(r) for r in activity.build_asof_panel(events, many, 90).collect()}
    want = set()
    for one in many:
        alone = events.filter(F.col("invoice_date") < F.lit(one.as_of)).groupBy("customer_id").agg(F.max("invoice_date").alias("m"), F.countDistinct("invoice"), F.sum("revenue"))
        label = {r[0] for r in events.filter((F.col("invoice_date") >= F.lit(one.label_start)) & (F.col("invoice_date") < F.lit(one.label_end))).select("customer_id").distinct().collect()}
        for c, m, n, s in alone.collect():
            if (one.as_of - m).total_seconds() <= 90 * 86400:
                want.add((c, one.as_of, (one.as_of - m).days, n, s, int(c not in label)))
    assert got == want


def test_panel_and_eligibility(spark):
    rows = [("A", 501, D(2011, 2, 1), 10.0), ("B", 501, D(2011, 3, 10), 5.0), ("C", 502, D(2011, 1, 5), 7.0), ("D", 503, D(2009, 1, 1), 7.0)]
    found = {r["customer_id"]: r for r in activity.build_asof_panel(tx(spark, rows), [Window(D(2011, 3, 1), 7, 30)]).collect()}
    assert {c: r["churned"] for c, r in found.items()} == {501: 0, 502: 1}
    assert (found[501]["frequency"], found[501]["monetary"]) == (1, 10.0)
    near = activity.eligible_customers(tx(spark, rows), [Window(D(2011, 3, 1))], 40)
    assert [r["customer_id"] for r in near.collect()] == [501]
    assert activity.build_asof_panel(tx(spark, rows), []).count() == 0


def test_naive_and_tautology(spark):
    end = D(2011, 12, 31)
    rows = [("A", 101, D(2011, 12, 15), 10.0), ("B", 101, D(2011, 12, 10), 20.0), ("C", 102, D(2011, 1, 1), 50.0), ("D", 104, end, 100.0)]
    found = {r[0]: tuple(r)[1:] for r in activity.naive_features(tx(spark, rows)).collect()}
    assert found == {101: (16, 2, 30.0), 102: (364, 1, 50.0), 104: (0, 1, 100.0)}
    assert {r[0]: r[1] for r in activity.tautological_label(tx(spark, rows), 30).collect()} == {101: 0, 102: 1, 104: 0}


SUB = "customer_id string, transaction_date timestamp_ntz, membership_expire_date timestamp_ntz, actual_amount_paid int, is_auto_renew int, is_cancel int"


def test_subscription_panel(spark):
    rows = [
        ("a", D(2016, 5, 1), D(2016, 6, 5), 149, 1, 0), ("a", D(2016, 4, 1), D(2016, 5, 1), 99, 1, 1), ("a", D(2016, 6, 10), D(2016, 7, 10), 149, 1, 0),
        ("b", D(2016, 4, 1), D(2016, 5, 1), 149, 0, 0), ("b", D(2016, 6, 12), D(2016, 6, 12), 149, 0, 1), ("c", D(2015, 1, 1), D(2015, 2, 1), 149, 0, 0),
        ("e", D(2015, 6, 1), D(2016, 6, 3), 10, 0, 0), ("t", D(2016, 5, 5), D(2016, 6, 1), 1, 0, 0), ("t", D(2016, 5, 5), D(2016, 6, 5), 199, 0, 0),
    ]
    events, one = spark.createDataFrame(rows, SUB), [Window(D(2016, 6, 1), 7, 30)]
    panel = subscription.build_subscription_panel(events, one)
    assert panel.columns == ["customer_id", "as_of", *subscription.FEATURES, "churned"]
    found = {r["customer_id"]: tuple(r)[2:] for r in panel.collect()}
    assert found == {"a": (4, 61, 149, 1, 2, 1, 0), "b": (-31, 61, 149, 0, 1, 0, 1), "e": (2, 366, 10, 0, 0, 0, 1), "t": (4, 27, 199, 0, 2, 0, 1)}
    pinned = subscription.build_subscription_panel(events, one, eligibility_gap_days=0)
    assert {r["customer_id"] for r in pinned.collect()} == {"b"}


def test_retail_cleaning(spark):
    rows = [
        ("1", "A", 1, 2.0, 7.0), ("C2", "A", 1, 2.0, 7.0), ("3", "POST", 1, 2.0, 7.0), ("4", "A", -1, 2.0, 7.0), ("5", "A", 1, float("nan"), 7.0),
        ("6", "A", 1, 2.0, None), ("7", "A", 1, 2.0, float("nan")), (None, "A", 3, 2.0, 8.0), ("1", "A", 1, 2.0, 7.0),
    ]
    raw = spark.createDataFrame(rows, "Invoice string, StockCode string, Quantity int, Price double, `Customer ID` double").withColumns({"InvoiceDate": F.lit(D(2011, 1, 1)), "Description": F.lit(""), "Country": F.lit("")})
    found = cleaning.clean_retail(raw).orderBy("customer_id").collect()
    assert [(r["invoice"], r["customer_id"], r["revenue"]) for r in found] == [("1", 7, 2.0), ("1", 7, 2.0), (None, 8, 6.0)]


def test_subscription_cleaning(spark):
    rows = [("A", 30, 20160101, 20160201, 0), ("A", 30, 20160101, 20160201, 0), ("B", 30, 20160101, 19700101, 0), ("C", 30, 20160101, 20151231, 0), ("D", 30, 20160101, 20151231, 1), ("E", 0, 20160101, 20160101, 0)]
    raw = spark.createDataFrame(rows, "msno string, payment_plan_days int, transaction_date int, membership_expire_date int, is_cancel int")
    raw = raw.withColumns({c: F.lit(1) for c in ("payment_method_id", "plan_list_price", "actual_amount_paid", "is_auto_renew")})
    assert sorted(r["customer_id"] for r in cleaning.clean_subscriptions(raw).collect()) == ["A", "D", "E"]
    told = cleaning.subscription_rows(raw)
    assert {r["reason"]: r["n"] for r in cleaning.drop_attribution(told).collect()} == {"duplicate": 1, "sentinel_expiry": 1, "inconsistent_expiry": 1, "kept": 3}
    assert tuple(cleaning.drop_counts(told).first()) == (1, 1, 2)  # a sentinel expiry is inconsistent too


def test_person_periods(spark):
    one = [Window(D(2011, 1, 1), 7, 90)]
    events = spark.createDataFrame([(501, D(2011, 1, 17)), (502, D(2011, 2, 17))], "customer_id long, invoice_date timestamp_ntz")
    panel = spark.createDataFrame([(501, D(2011, 1, 1), 1.0), (502, D(2011, 1, 1), 2.0), (503, D(2011, 1, 1), 3.0)], "customer_id long, as_of timestamp_ntz, x double")
    assert {r[1]: r[2] for r in hazard.first_event_period(events, one, time_col="invoice_date").collect()} == {501: 1, 502: 2}
    rows = hazard.person_periods(events, one, panel, ["x"], time_col="invoice_date").orderBy("customer_id", "period").collect()
    assert [(r[0], r["period"], r["event"]) for r in rows] == [(501, 1, 1), (502, 1, 0), (502, 2, 1), (503, 1, 0), (503, 2, 0), (503, 3, 0)]
    with pytest.raises(ValueError):
        hazard.first_event_period(events, one, time_col="invoice_date", period_days=40)
    with pytest.raises(ValueError):
        hazard.first_event_period(events, one, time_col="nothing")


def test_survival(spark):
    rows = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.3), (2, 1, 0.5), (2, 2, 0.5), (3, 1, 1.0)], "customer_id long, period int, hazard double")
    assert {r[0]: round(r[1], 9) for r in hazard.survival(rows).collect()} == {1: 0.504, 2: 0.25, 3: 0.0}
