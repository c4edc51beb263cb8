"""Discrete-time hazards: person-period rows, survival, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from origo.functions import elapsed_days
from origo.operators import selection
from origo.operators.windows import Window, in_label

PERIOD_DAYS = 30


def n_periods(windows: list[Window], period_days: int) -> int:
    horizons = {w.horizon_days for w in windows}
    if len(horizons) > 1:
        raise ValueError("windows must share a horizon")
    horizon = horizons.pop() if horizons else period_days
    if period_days <= 0 or horizon % period_days:
        raise ValueError("the horizon must be a whole number of periods")
    return horizon // period_days


def first_event_period(tx: DataFrame, windows: list[Window], *, time_col: str, key: str = "customer_id", period_days: int = PERIOD_DAYS) -> DataFrame:
    """`as_of, customer_id, period`: when in the label window, counted from 1, the
    first event falls; those without one have no row."""
    n_periods(windows, period_days)
    if time_col not in tx.columns:
        raise ValueError(f"no column {time_col}")
    rows = in_label(tx.select(key, time_col), windows, time_col)
    first = rows.groupBy("as_of", "label_start", key).agg(F.min(time_col).alias("_first"))
    return first.select("as_of", key, (F.floor(elapsed_days(F.col("_first"), F.col("label_start")) / period_days) + 1).cast("int").alias("period"))


def person_periods(tx: DataFrame, windows: list[Window], panel: DataFrame, feature_cols: list[str], *, time_col: str, key: str = "customer_id", period_days: int = PERIOD_DAYS) -> DataFrame:
    """`customer_id, as_of, period, event`, features: a row for each period up to
    the event, or for all of them without one."""
    last = n_periods(windows, period_days)
    rows = with_events(tx, windows, panel, time_col=time_col, key=key, period_days=period_days).withColumn("period", F.explode(F.sequence(F.lit(1), F.coalesce("_event", F.lit(last)))))
    return rows.select(key, "as_of", "period", F.coalesce((F.col("period") == F.col("_event")).cast("int"), F.lit(0)).alias("event"), *feature_cols)


def with_events(tx: DataFrame, windows: list[Window], panel: DataFrame, *, time_col: str, key: str = "customer_id", period_days: int = PERIOD_DAYS) -> DataFrame:
    """`panel` with `_event`: the period of the first event, null without one."""
    events = first_event_period(tx, windows, time_col=time_col, key=key, period_days=period_days).withColumnRenamed("period", "_event")
    return panel.join(events, ["as_of", key], "left")


def renewals(tx: DataFrame) -> DataFrame:
    """The rows that count as events for hazards: a cancellation is none. Labels
    leave it out as well, so an event occurs just where a label is 0."""
    return tx.filter("is_cancel = 0")


def survival(hazards: DataFrame, *, key: str = "customer_id", hazard_col: str = "hazard") -> DataFrame:
    """`as_of, customer_id, survival`: the product of 1 - hazard."""
    by = [c for c in ("as_of", key) if c in hazards.columns]
    return hazards.groupBy(*by).agg(F.product(1 - F.col(hazard_col)).alias("survival"))


def cumulative_survival(hazards: DataFrame, *, key: str = "customer_id", hazard_col: str = "hazard") -> DataFrame:
    """The hazards with survival up to each period."""
    by = [c for c in ("as_of", key) if c in hazards.columns]
    return hazards.withColumn("survival", F.product(1 - F.col(hazard_col)).over(W.partitionBy(*by).orderBy("period").rowsBetween(W.unboundedPreceding, 0)))


def period_summary(hazards: DataFrame, *, key: str = "customer_id") -> DataFrame:
    """`period, mean_hazard, mean_survival, cumulative_hazard, survival_drop`."""
    means = cumulative_survival(hazards, key=key).groupBy("period").agg(F.avg("hazard").alias("mean_hazard"), F.avg("survival").alias("mean_survival"))
    before = F.lag("mean_survival", 1, 1.0).over(W.partitionBy().orderBy("period"))  # a row for each period
    return means.withColumns({"cumulative_hazard": -F.ln("mean_survival"), "survival_drop": before - F.col("mean_survival")})


def expand_periods(panel: DataFrame, periods: int) -> DataFrame:
    """Every row of the panel in every period."""
    return panel.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))


def late_returners(tx: DataFrame, panel: DataFrame, window: Window, *, key: str = "customer_id", time_col: str = "invoice_date") -> DataFrame:
    """One row about churned rows of one origin that return after its label window:
    `n_churned, n_returned, within_14, beyond_90, median_days`, and the days of
    tail after the window, which bound what can be seen."""
    churned = panel.filter((F.col("as_of") == F.lit(window.as_of)) & (F.col("churned") == 1)).select(key)
    end = F.lit(window.label_end).cast("timestamp_ntz")
    back = tx.filter(F.col(time_col) >= end).join(churned, key, "left_semi").groupBy(key).agg(elapsed_days(F.min(time_col), end).alias("d"))
    tail = F.broadcast(tx.agg(elapsed_days(F.max(time_col), end).alias("tail_days")))  # one row
    n = F.broadcast(churned.agg(F.count(F.lit(1)).alias("n_churned")))  # one row
    told = back.agg(F.count(F.lit(1)).alias("n_returned"), F.count_if(F.col("d") <= 14).alias("within_14"), F.count_if(F.col("d") > 90).alias("beyond_90"))
    middle = F.broadcast(selection.medians(back, "d", name="median_days").select("median_days"))  # one row
    return told.join(n).join(tail).join(middle, how="left").select("n_churned", "n_returned", "within_14", "beyond_90", "median_days", "tail_days")
