"""Transaction tables made of the star schema, in DataFrames and in SQL.

The SQL is what an independent engine computes from the same files; every piece
is a named subquery.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from origo.functions import add_days
from origo.operators.windows import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").cast("string").alias("invoice"), F.col("o_orderdate").alias("invoice_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("revenue"),
    )


TX = """tx AS (SELECT o_custkey AS customer_id, CAST(o_orderkey AS VARCHAR) AS invoice, o_orderdate AS invoice_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS revenue FROM orders)"""


def subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    plan = (30 * (1 + key % 3)).cast("int")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("customer_id"), (key % 5).cast("int").alias("payment_method_id"), plan.alias("payment_plan_days"),
        F.floor("o_totalprice").cast("int").alias("plan_list_price"), F.floor("o_totalprice").cast("int").alias("actual_amount_paid"), (key % 2).cast("int").alias("is_auto_renew"),
        day.alias("transaction_date"), add_days(day, plan).alias("membership_expire_date"), (F.col("o_orderstatus") == "P").cast("int").alias("is_cancel"),
    )


SUB = """sub AS (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey % 5 AS INTEGER) AS payment_method_id,
  CAST(30 * (1 + o_orderkey % 3) AS INTEGER) AS payment_plan_days, CAST(floor(o_totalprice) AS INTEGER) AS plan_list_price,
  CAST(floor(o_totalprice) AS INTEGER) AS actual_amount_paid, CAST(o_orderkey % 2 AS INTEGER) AS is_auto_renew, o_orderdate AS transaction_date,
  o_orderdate + to_days(CAST(30 * (1 + o_orderkey % 3) AS INTEGER)) AS membership_expire_date, CAST(o_orderstatus = 'P' AS INTEGER) AS is_cancel FROM orders)"""


def raw_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With repeated rows, sentinel expiries, and expiries before transactions."""
    rows = subscription(spark, sf_dir).withColumn("k", F.col("plan_list_price"))
    expire = F.when(F.col("k") % 37 == 0, F.lit("1970-01-01").cast("timestamp_ntz")).when(F.col("k") % 23 == 0, add_days(F.col("transaction_date"), -5)).otherwise(F.col("membership_expire_date"))
    rows = rows.withColumn("membership_expire_date", expire)
    return rows.unionByName(rows.filter("k % 10 = 0")).drop("k")


RAW_SUB = (
    SUB
    + """, r0 AS (SELECT * REPLACE (CASE WHEN plan_list_price % 37 = 0 THEN TIMESTAMP '1970-01-01'
  WHEN plan_list_price % 23 = 0 THEN transaction_date - INTERVAL 5 DAY ELSE membership_expire_date END AS membership_expire_date) FROM sub),
raw AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE plan_list_price % 10 = 0)"""
)


def raw_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.concat(F.when(F.col("o_orderstatus") == "P", "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("Invoice"),
        F.when(F.col("l_partkey") % 50 == 0, "POST").otherwise(F.col("l_partkey").cast("string")).alias("StockCode"), F.lit(None).cast("string").alias("Description"),
        (F.col("l_quantity").cast("int") - 3).alias("Quantity"), F.col("o_orderdate").alias("InvoiceDate"), F.col("l_extendedprice").alias("Price"),
        F.when(F.col("o_custkey") % 17 != 0, F.col("o_custkey").cast("double")).alias("Customer ID"), F.lit("x").alias("Country"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("customer_id"), F.col("ts").alias("event_date"))


PURCHASES = "ev AS (SELECT user_id AS customer_id, ts AS event_date FROM events WHERE event_type = 'purchase')"


def windows(first: datetime, n: int, step: int, gap: int, horizon: int) -> list[Window]:
    return [Window(first + timedelta(days=i * step), gap, horizon) for i in range(n)]


def origins_sql(first: str, n: int, step: int, gap: int, horizon: int, eligibility_gap: int | None = None) -> str:
    at = f"TIMESTAMP '{first}' + to_days(CAST(i * {step} AS INTEGER))"
    return f"""o AS (SELECT CAST(i AS INTEGER) AS idx, {at} AS as_of, {at} + INTERVAL {gap} DAY AS label_start,
  {at} + INTERVAL {gap + horizon} DAY AS label_end, {gap if eligibility_gap is None else eligibility_gap} AS egap FROM range({n}) t(i))"""


def day(column: str = "as_of"):
    return F.date_format(column, "yyyy-MM-dd").alias("as_of")


DAY = "strftime(as_of, '%Y-%m-%d') AS as_of"
