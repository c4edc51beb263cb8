"""Panels of customers who are eligible by activity: recency, frequency, monetary.

All origins are computed at once. Rows are first reduced to one for each customer
and interval between origins; running totals over these are an as-of state that
holds until the next one, so no row is repeated for every origin after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from origo.functions import add_days, elapsed_days
from origo.operators.windows import Window, in_label, in_past

ELIGIBILITY_DAYS = 365


def eligible_customers(tx: DataFrame, windows: list[Window], lookback_days: int = ELIGIBILITY_DAYS, *, key: str = "customer_id", time_col: str = "invoice_date") -> DataFrame:
    """`as_of, customer_id`: customers with an event in [as_of - lookback, as_of)."""
    return in_past(tx.select(key, time_col).distinct(), windows, time_col, lookback_days).select("as_of", key).distinct()


def asof_features(tx: DataFrame, windows: list[Window], *, key: str = "customer_id", time_col: str = "invoice_date", invoice_col: str = "invoice", revenue_col: str = "revenue", max_recency_days: int | None = None) -> DataFrame:
    """`as_of, customer_id, recency_days, frequency, monetary` from events
    strictly before as_of, for customers with any such event. With
    `max_recency_days` only those whose last event lies that near."""
    ordered = sorted(w.as_of for w in windows)
    spark = tx.sparkSession
    if not ordered:
        return tx.select(F.lit(None).cast("timestamp_ntz").alias("as_of"), key, F.lit(0).cast("long").alias("recency_days"), F.lit(0).cast("long").alias("frequency"), F.col(revenue_col).alias("monetary")).limit(0)
    instants = F.array(*[F.lit(t).cast("timestamp_ntz") for t in ordered])
    # The first origin that sees an event; events that none sees go.
    rows = tx.select(F.col(key).alias("k"), F.col(time_col).alias("t"), F.col(invoice_col).alias("i"), F.col(revenue_col).alias("r"))
    rows = rows.filter(F.col("t") < F.lit(ordered[-1]).cast("timestamp_ntz")).withColumn("at", F.size(F.filter(instants, lambda a: a <= F.col("t"))))
    sums = rows.groupBy("k", "at").agg(F.max("t").alias("last"), F.sum("r").alias("r"))
    firsts = rows.filter(F.col("i").isNotNull()).groupBy("k", "i").agg(F.min("at").alias("at")).groupBy("k", "at").agg(F.count(F.lit(1)).alias("n"))
    steps = sums.join(firsts, ["k", "at"], "left")
    past = W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    states = steps.select(
        "k", "at", F.max("last").over(past).alias("last"), F.sum(F.coalesce("n", F.lit(0).cast("long"))).over(past).alias("frequency"),
        F.sum("r").over(past).alias("monetary"), F.lead("at", 1, len(ordered)).over(W.partitionBy("k").orderBy("at")).alias("until"),
    )
    held = states.withColumn("idx", F.explode(F.sequence(F.col("at"), F.col("until") - 1))).withColumn("as_of", F.get(instants, F.col("idx")))
    if max_recency_days is not None:
        held = held.filter(F.col("last") >= add_days(F.col("as_of"), -max_recency_days))
    return held.select("as_of", F.col("k").alias(key), elapsed_days(F.col("as_of"), F.col("last")).alias("recency_days"), "frequency", "monetary")


asof_recency_frequency_monetary = asof_features


def counts_before(tx: DataFrame, windows: list[Window], out: str, *, key: str = "customer_id", time_col: str = "invoice_date") -> DataFrame:
    """`as_of, customer_id, <out>`: how many events lie strictly before as_of, for
    customers with any."""
    ordered = sorted(w.as_of for w in windows)
    instants = F.array(*[F.lit(t).cast("timestamp_ntz") for t in ordered])
    seen = tx.select(key, time_col).withColumn("at", F.size(F.filter(instants, lambda a: a <= F.col(time_col)))).filter(F.col("at") < len(ordered))
    steps = seen.groupBy(key, "at").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(key).orderBy("at")
    held = steps.select(key, "at", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)).alias(out), F.lead("at", 1, len(ordered)).over(order).alias("until"))
    return held.select(key, out, F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("_i")).select(F.get(instants, F.col("_i")).alias("as_of"), key, out)


def purchasers(tx: DataFrame, windows: list[Window], *, key: str = "customer_id", time_col: str = "invoice_date") -> DataFrame:
    """`as_of, customer_id` of those with an event in the label window."""
    return in_label(tx.select(key, time_col), windows, time_col).select("as_of", key).distinct()


def with_churn(panel: DataFrame, tx: DataFrame, windows: list[Window], *, key: str = "customer_id", time_col: str = "invoice_date") -> DataFrame:
    """`panel` with `churned`: 1 without an event in the label window."""
    bought = purchasers(tx, windows, key=key, time_col=time_col).withColumn("_bought", F.lit(1))
    return panel.join(bought, ["as_of", key], "left").withColumn("churned", F.when(F.col("_bought").isNull(), 1).otherwise(0)).drop("_bought")


def build_asof_panel(tx: DataFrame, windows: list[Window], lookback_days: int = ELIGIBILITY_DAYS, *, key: str = "customer_id", time_col: str = "invoice_date", invoice_col: str = "invoice", revenue_col: str = "revenue") -> DataFrame:
    """`customer_id, as_of, recency_days, frequency, monetary, churned` for all
    eligible customers. Eligible is whose last event before as_of lies in the
    lookback, so the features decide that too."""
    features = asof_features(tx, windows, key=key, time_col=time_col, invoice_col=invoice_col, revenue_col=revenue_col, max_recency_days=lookback_days)
    return with_churn(features, tx, windows, key=key, time_col=time_col).select(key, "as_of", "recency_days", "frequency", "monetary", "churned")


def naive_features(tx: DataFrame, *, key: str = "customer_id", time_col: str = "invoice_date", invoice_col: str = "invoice", revenue_col: str = "revenue") -> DataFrame:
    """The control arm, which is wrong on purpose: features over all of history,
    recency to the last event of the whole table."""
    end = F.broadcast(tx.agg(F.max(time_col).alias("_end")))  # one row
    own = tx.groupBy(key).agg(F.max(time_col).alias("_last"), F.countDistinct(invoice_col).alias("frequency"), F.sum(revenue_col).alias("monetary"))
    return own.join(end).select(key, elapsed_days(F.col("_end"), F.col("_last")).alias("recency_days"), "frequency", "monetary")


def build_naive_panel(tx: DataFrame, windows: list[Window], lookback_days: int = ELIGIBILITY_DAYS, **columns) -> DataFrame:
    """Eligible customers with naive features and the forward-looking label."""
    names = {k: v for k, v in columns.items() if k in ("key", "time_col")}
    key = names.get("key", "customer_id")
    panel = eligible_customers(tx, windows, lookback_days, **names).join(naive_features(tx, **columns), key)
    return with_churn(panel, tx, windows, **names).select(key, "as_of", "recency_days", "frequency", "monetary", "churned")


def tautological_label(tx: DataFrame, horizon_days: int, *, key: str = "customer_id", time_col: str = "invoice_date") -> DataFrame:
    """`customer_id, churned`: no event in the last `horizon_days` of the table."""
    end = F.broadcast(tx.agg(F.max(time_col).alias("_end")))  # one row
    own = tx.groupBy(key).agg(F.max(time_col).alias("_last")).join(end)
    return own.select(key, (F.col("_last") < add_days(F.col("_end"), -horizon_days)).cast("int").alias("churned"))
