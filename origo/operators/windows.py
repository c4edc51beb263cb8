"""Scoring occasions: an as-of instant, a gap, and a half-open label window.

Features use events strictly before `as_of`; the label window is
[as_of + gap, as_of + gap + horizon). An origin whose label window ends after the
last event is dropped, never clipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from origo.functions import add_days
from origo.operators.intervals import interval_join, width_for

GAP_DAYS, HORIZON_DAYS, STEP_DAYS = 7, 30, 30
ORIGINS_SCHEMA = "idx int, as_of timestamp_ntz, gap_days int, eligibility_gap_days int, label_start timestamp_ntz, label_end timestamp_ntz"


@dataclass(frozen=True)
class Window:
    """One scoring occasion."""

    as_of: datetime
    gap_days: int = GAP_DAYS
    horizon_days: int = HORIZON_DAYS

    def __post_init__(self) -> None:
        if not isinstance(self.as_of, datetime):
            raise TypeError("as_of must be a datetime")
        if self.gap_days < 0:
            raise ValueError("the gap can't be negative")
        if self.horizon_days <= 0:
            raise ValueError("the horizon must be positive")

    @property
    def feature_end(self) -> datetime:
        return self.as_of

    @property
    def label_start(self) -> datetime:
        return self.as_of + timedelta(days=self.gap_days)

    @property
    def label_end(self) -> datetime:
        return self.label_start + timedelta(days=self.horizon_days)

    def describe(self) -> str:
        day = "%Y-%m-%d"
        return f"features < {self.as_of:{day}}; label [{self.label_start:{day}}, {self.label_end:{day}})"


def assert_no_leak(window: Window) -> None:
    """Raise unless a real gap parts features from labels."""
    if window.label_start < window.feature_end:
        raise ValueError("the label window begins before the features end")
    if window.gap_days == 0:
        raise ValueError("without a gap the label window begins where the features end")


def rolling_origins(first_as_of: datetime, last_event: datetime, *, gap_days: int = GAP_DAYS, horizon_days: int = HORIZON_DAYS, step_days: int = STEP_DAYS) -> list[Window]:
    """Every `step_days` a window, as long as its label is complete."""
    if step_days <= 0:
        raise ValueError("the step must be positive")
    found, at = [], Window(first_as_of, gap_days, horizon_days)
    while at.label_end <= last_event:
        found.append(at)
        at = Window(at.as_of + timedelta(days=step_days), gap_days, horizon_days)
    return found


def first_origin(events: DataFrame, time_col: str, lookback_days: int) -> datetime | None:
    """Midnight of the first event plus the lookback."""
    first = events.agg(F.date_trunc("DAY", F.min(time_col)).cast("timestamp_ntz").alias("t")).first()["t"]
    return first + timedelta(days=lookback_days) if first else None


def origins_frame(spark: SparkSession, windows: list[Window], eligibility_gap_days: int | None = None) -> DataFrame:
    """The origins as a small relation; `as_of` must be unique."""
    if len({w.as_of for w in windows}) < len(windows):
        raise ValueError("two origins share an as_of")
    rows = [(i, w.as_of, w.gap_days, w.gap_days if eligibility_gap_days is None else eligibility_gap_days, w.label_start, w.label_end) for i, w in enumerate(sorted(windows, key=lambda w: w.as_of))]
    return spark.createDataFrame(rows, ORIGINS_SCHEMA)


def is_feature_event(ts: Column, as_of: Column) -> Column:
    return ts < as_of


def is_label_event(ts: Column, label_start: Column, label_end: Column) -> Column:
    return (ts >= label_start) & (ts < label_end)


def in_lookback(ts: Column, as_of: Column, days: int) -> Column:
    """[as_of - days, as_of)."""
    return (ts >= add_days(as_of, -days)) & (ts < as_of)


def during(rows: DataFrame, windows: list[Window], time_col: str, start: Column, end: Column, span: list[timedelta], eligibility_gap_days: int | None = None) -> DataFrame:
    """`rows` with the columns of every origin whose interval [start, end), columns
    of the origin, holds their instant. Origins are few, and known to the driver."""
    origins = origins_frame(rows.sparkSession, windows, eligibility_gap_days).withColumns({"_start": start, "_end": end})
    return interval_join(rows, origins, time_col, "_start", "_end", width_for(span), small=origins).drop("_start", "_end")


def in_past(rows: DataFrame, windows: list[Window], time_col: str, days: int) -> DataFrame:
    """`rows` with every origin in whose lookback [as_of - days, as_of) they lie."""
    return during(rows, windows, time_col, add_days(F.col("as_of"), -days), F.col("as_of"), [timedelta(days=days)])


def in_label(rows: DataFrame, windows: list[Window], time_col: str) -> DataFrame:
    """`rows` with every origin in whose label window they lie."""
    return during(rows, windows, time_col, F.col("label_start"), F.col("label_end"), [w.label_end - w.label_start for w in windows])


def in_gap(rows: DataFrame, windows: list[Window], time_col: str) -> DataFrame:
    """`rows` with every origin in whose gap [as_of, label_start) they lie."""
    return during(rows, windows, time_col, F.col("as_of"), F.col("label_start"), [w.label_start - w.as_of for w in windows])


def validate_reference_date(features: DataFrame, anchor_col: str, as_of_col: str = "as_of") -> None:
    """Raise if a feature was anchored after its as-of instant."""
    late = features.filter(F.col(anchor_col) > F.col(as_of_col)).count()
    if late:
        raise ValueError(f"{late} rows have a reference date after as_of")
