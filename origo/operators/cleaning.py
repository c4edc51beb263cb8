"""Cleaning of two kinds of transaction tables, and accounts of what it drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from origo.functions import positive

# Columns of the raw retail table, and stock codes that are fees,
# postage or tests rather than goods.
RETAIL_NAMES = {
    "Invoice": "invoice", "StockCode": "stock_code", "Description": "description", "Quantity": "quantity",
    "InvoiceDate": "invoice_date", "Price": "price", "Customer ID": "customer_id", "Country": "country",
}
ADMINISTRATIVE = ("POST", "DOT", "M", "C2", "BANK CHARGES", "ADJUST", "ADJUST2", "D", "TEST001", "TEST002", "B")
RETAIL_RAW = "Invoice string, StockCode string, Description string, Quantity int, InvoiceDate timestamp_ntz, Price double, `Customer ID` double, Country string"
SUBSCRIPTION_RAW = "msno string, payment_method_id int, payment_plan_days int, plan_list_price int, actual_amount_paid int, is_auto_renew int, transaction_date int, membership_expire_date int, is_cancel int"
FIRST_EXPIRY = "2000-01-01 00:00:00"


def clean_retail(raw: DataFrame) -> DataFrame:
    """Named columns; no rows without customer, of cancellations, of fees, or of
    quantity or price that isn't positive; with `revenue`. Repeated rows stay."""
    df = raw.withColumnsRenamed(RETAIL_NAMES)
    customer = F.col("customer_id")
    df = df.filter(customer.isNotNull() & ~F.isnan(customer.cast("double")))
    df = df.withColumns({
        "customer_id": customer.cast("long"), "invoice": F.col("invoice").cast("string"), "stock_code": F.col("stock_code").cast("string"),
        "invoice_date": F.col("invoice_date").cast("timestamp_ntz"),
    })
    cancelled = F.coalesce(F.col("invoice").startswith("C"), F.lit(False))
    fee = F.coalesce(F.col("stock_code").isin(*ADMINISTRATIVE), F.lit(False))
    df = df.filter(~cancelled & ~fee & positive(F.col("quantity")) & positive(F.col("price")))
    return df.withColumn("revenue", F.col("quantity") * F.col("price"))


def _day(number: Column) -> Column:
    """yyyymmdd as an instant; anything else raises."""
    return F.to_timestamp_ntz(number.cast("string"), F.lit("yyyyMMdd"))


def subscription_rows(raw: DataFrame) -> DataFrame:
    """Named and typed columns, all rows."""
    return raw.select(
        F.col("msno").alias("customer_id"), "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew",
        _day(F.col("transaction_date")).alias("transaction_date"), _day(F.col("membership_expire_date")).alias("membership_expire_date"), "is_cancel",
    )


def _sentinel() -> Column:
    return F.col("membership_expire_date") < F.lit(FIRST_EXPIRY).cast("timestamp_ntz")


def _inconsistent() -> Column:
    return (F.col("membership_expire_date") < F.col("transaction_date")) & (F.col("is_cancel") == 0)


def clean_subscriptions(raw: DataFrame) -> DataFrame:
    """Distinct rows, without sentinel expiries, and without expiries before the
    transaction unless it is a cancellation. Cancellations, payments of zero and
    plans of zero days stay."""
    return subscription_rows(raw).distinct().filter(~_sentinel() & ~_inconsistent())


def drop_attribution(rows: DataFrame) -> DataFrame:
    """`reason, n`: each row under the first reason that drops it, or `kept`."""
    copy = F.row_number().over(W.partitionBy(*rows.columns).orderBy(F.lit(1)))
    reason = F.when(F.col("_copy") > 1, "duplicate").when(_sentinel(), "sentinel_expiry").when(_inconsistent(), "inconsistent_expiry").otherwise("kept")
    return rows.withColumn("_copy", copy).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def drop_counts(rows: DataFrame) -> DataFrame:
    """One row: how many rows each rule alone would drop."""
    copies = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.sum(F.col("_n") - 1).alias("duplicate"), F.sum(F.when(_sentinel(), F.col("_n")).otherwise(0)).alias("sentinel_expiry"),
        F.sum(F.when(_inconsistent(), F.col("_n")).otherwise(0)).alias("inconsistent_expiry"),
    )
