"""Panels of customers who are eligible by the expiry of their subscription.

The as-of join is by validity intervals: a customer's transaction holds for all
instants after it up to, and with, the next one. Intervals and origins meet by bins
of time, so there is no grid of origins and customers, and no nested loop.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from origo.functions import add_days, calendar_days
from origo.operators.intervals import interval_join
from origo.operators.windows import Window, in_gap, in_label, in_past, origins_frame

ELIGIBILITY_DAYS, LOOKBACK_DAYS = 45, 180
FEATURES = ("days_until_expiry", "tenure_days", "current_plan_price", "is_auto_renew", "n_transactions_lookback", "n_cancellations_lookback")


def dedupe_for_asof_join(tx: DataFrame) -> DataFrame:
    """One row for each customer and day: the largest expiry, ties by all other
    columns in order."""
    rest = [c for c in tx.columns if c not in ("customer_id", "transaction_date", "membership_expire_date")]
    order = W.partitionBy("customer_id", "transaction_date").orderBy(F.desc("membership_expire_date"), *[F.desc(c) for c in rest])
    return tx.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def asof_join(rows: DataFrame, windows: list[Window], *, key: str, time_col: str, gap: int | None = None, after: Column | None = None, until: Column | None = None) -> DataFrame:
    """Each origin with each key's last row strictly before it; keys without one
    have no row. At most one row of a key may have an instant.

    `after` and `until` bound, for each row, the origins (after, until] that are
    wanted at all; what lies outside is never entered.
    """
    ordered = sorted(w.as_of for w in windows)
    origins = origins_frame(rows.sparkSession, windows, gap)
    if not ordered:
        return rows.join(origins).limit(0)
    # A row holds from its instant to the next one's, and as far as origins go.
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (ordered[0] - timedelta(days=1), ordered[-1]))
    later = F.lead(time_col).over(W.partitionBy(key).orderBy(time_col))
    held = rows.withColumn("_until", F.least(later, high, *([until] if until is not None else []))).withColumn("_after", F.greatest(F.col(time_col), low, *([after] if after is not None else [])))
    step = max(timedelta(days=1), (ordered[-1] - ordered[0]) / len(ordered))
    return interval_join(origins, held, "as_of", "_after", "_until", step, right_closed=True, small=origins).drop("_after", "_until")


def membership_state(tx: DataFrame, windows: list[Window], lookback_days: int = ELIGIBILITY_DAYS, eligibility_gap_days: int | None = None) -> DataFrame:
    """`as_of, customer_id, days_until_expiry, tenure_days, current_plan_price,
    is_auto_renew` of those whose membership expires in [as_of - lookback,
    as_of + gap)."""
    first = W.partitionBy("customer_id")
    rows = dedupe_for_asof_join(tx).withColumn("_first", F.min("transaction_date").over(first))
    expire, as_of = F.col("membership_expire_date"), F.col("as_of")
    widest = max([w.gap_days for w in windows], default=0) if eligibility_gap_days is None else eligibility_gap_days
    state = asof_join(rows, windows, key="customer_id", time_col="transaction_date", gap=eligibility_gap_days, after=add_days(expire, -widest), until=add_days(expire, lookback_days))
    due = (expire >= add_days(as_of, -lookback_days)) & (expire < add_days(as_of, F.col("eligibility_gap_days")))
    return state.filter(due).select(
        "as_of", "customer_id", calendar_days(expire, as_of).alias("days_until_expiry"), calendar_days(as_of, F.col("_first")).alias("tenure_days"),
        F.col("actual_amount_paid").alias("current_plan_price"), "is_auto_renew",
    )


def lookback_counts(tx: DataFrame, windows: list[Window], days: int = LOOKBACK_DAYS) -> DataFrame:
    """`as_of, customer_id, n_transactions_lookback, n_cancellations_lookback`
    over [as_of - days, as_of); customers without any have no row."""
    rows = tx.groupBy("customer_id", "transaction_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_cancel") == 1).alias("c"))
    seen = in_past(rows, windows, "transaction_date", days)
    return seen.groupBy("as_of", "customer_id").agg(F.sum("n").alias("n_transactions_lookback"), F.sum("c").alias("n_cancellations_lookback"))


def renewals(tx: DataFrame, windows: list[Window]) -> DataFrame:
    """`as_of, customer_id` of those with a transaction in the label window that
    is no cancellation."""
    rows = tx.filter("is_cancel = 0").select("customer_id", "transaction_date").distinct()
    return in_label(rows, windows, "transaction_date").select("as_of", "customer_id").distinct()


def with_label(panel: DataFrame, tx: DataFrame, windows: list[Window]) -> DataFrame:
    """`panel` with `churned`: 1 without a renewal in the label window."""
    renewed = renewals(tx, windows).withColumn("_renewed", F.lit(1))
    return panel.join(renewed, ["as_of", "customer_id"], "left").withColumn("churned", F.when(F.col("_renewed").isNull(), 1).otherwise(0)).drop("_renewed")


def build_subscription_panel(tx: DataFrame, windows: list[Window], *, eligibility_lookback_days: int = ELIGIBILITY_DAYS, feature_lookback_days: int = LOOKBACK_DAYS, eligibility_gap_days: int | None = None) -> DataFrame:
    """`customer_id, as_of`, FEATURES, `churned`. `eligibility_gap_days` parts the
    bound of eligibility from the gap before the label."""
    state = membership_state(tx, windows, eligibility_lookback_days, eligibility_gap_days)
    panel = with_label(state.join(lookback_counts(tx, windows, feature_lookback_days), ["as_of", "customer_id"], "left"), tx, windows)
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_transactions_lookback", "n_cancellations_lookback")}
    return panel.withColumns(zero).select("customer_id", "as_of", *FEATURES, "churned")


def naive_features(tx: DataFrame) -> DataFrame:
    """The control arm: each customer's last row of all, counts over all of
    history, days to the last day of the whole table."""
    end = F.broadcast(tx.agg(F.max("transaction_date").alias("_end")))  # one row
    rest = [c for c in tx.columns if c not in ("customer_id", "transaction_date", "membership_expire_date")]
    last = W.partitionBy("customer_id").orderBy(F.desc("transaction_date"), F.desc("membership_expire_date"), *[F.desc(c) for c in rest])
    rows = tx.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    own = tx.groupBy("customer_id").agg(F.min("transaction_date").alias("_first"), F.count(F.lit(1)).alias("n_transactions_lookback"), F.count_if(F.col("is_cancel") == 1).alias("n_cancellations_lookback"))
    return rows.join(own, "customer_id").join(end).select(
        "customer_id", calendar_days(F.col("membership_expire_date"), F.col("_end")).alias("days_until_expiry"),
        calendar_days(F.col("_end"), F.col("_first")).alias("tenure_days"), F.col("actual_amount_paid").alias("current_plan_price"), "is_auto_renew",
        "n_transactions_lookback", "n_cancellations_lookback",
    )


def build_naive_panel(panel: DataFrame, tx: DataFrame) -> DataFrame:
    """The rows and labels of `panel` with naive features."""
    return panel.select("customer_id", "as_of", "churned").join(naive_features(tx), "customer_id", "left").select("customer_id", "as_of", *FEATURES, "churned")


def gap_effect(tx: DataFrame, panel: DataFrame, windows: list[Window]) -> DataFrame:
    """`renewed_in_gap, n, churn_rate, share`: how a renewal in [as_of, as_of + gap)
    goes with the label."""
    rows = tx.filter("is_cancel = 0").select("customer_id", "transaction_date").distinct()
    gap = in_gap(rows, windows, "transaction_date").select("as_of", "customer_id").distinct()
    told = panel.join(gap.withColumn("_in", F.lit(1)), ["as_of", "customer_id"], "left").withColumn("renewed_in_gap", F.coalesce("_in", F.lit(0)))
    counts = told.groupBy("renewed_in_gap").agg(F.count(F.lit(1)).alias("n"), F.avg("churned").alias("churn_rate"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
