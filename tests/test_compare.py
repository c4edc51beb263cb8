from datetime import datetime as D

from origo.operators import compare


def test_frames(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([("y", 2), ("x", 1)], "v string, k int")
    assert not compare.same_rows(a, b) and compare.same_rows(a, a) and compare.same_keys(a, b, ["k"])
    assert not compare.same_keys(a, b.filter("k = 1"), ["k"])


def test_samples(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as c")
    one, two = compare.simple_sample(df, 10, ["id"], 1), compare.simple_sample(df.repartition(7), 10, ["id"], 1)
    assert compare.same_rows(one, two) and not compare.same_rows(one, compare.simple_sample(df, 10, ["id"], 2))
    assert {r["c"]: r["count"] for r in compare.sample_per_category(df, "c", 5, ["id"], 1).groupBy("c").count().collect()} == {0: 5, 1: 5, 2: 5}


def test_cohorts_and_ranks(spark):
    tx = spark.createDataFrame([(i, D(2011, 1, 1 + i)) for i in range(5)], "customer_id int, invoice_date timestamp_ntz")
    assert [r["is_train"] for r in compare.cohort_split(tx, 0.5).orderBy("customer_id").collect()] == [True, True, False, False, False]
    df = spark.createDataFrame([(1, 0.9, 0.1), (2, 0.8, 0.2), (3, 0.7, 0.3)], "id int, p double, q double")
    assert tuple(compare.rank_differences(df, "p", "q", "id", 1).first()) == (2, 1)


def test_labels(spark):
    a = spark.createDataFrame([(1, 0, 5), (2, 1, 7)], "customer_id int, churned int, f int")
    b = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 0)], "customer_id int, churned int, f int")
    assert tuple(compare.label_agreement(a, b.withColumnRenamed("churned", "is_churn").drop("f")).first()) == (2, 0.5)
    assert {tuple(r) for r in compare.label_shift(a, b, ["customer_id"]).collect()} == {(0, 1, 1), (1, 1, 1)}
    assert {tuple(r) for r in compare.delta_by_class(a, b, "f", ["customer_id"]).collect()} == {(1, 2, 3.5)}
