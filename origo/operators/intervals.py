"""Joins of instants with the time intervals that hold them, by equality.

Time is cut into bins. An interval is entered under every bin that it touches, an
instant looks up its own one, and the bounds are tested on what meets there. Each
instant has one bin and each interval enters a bin once, so every pair is found, and
found once, whatever the widths; the width of bins only decides how often intervals
are entered and how much meets in vain. The join is a hash or sort-merge join on the
bin, never a nested loop over all pairs.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


def bin_of(ts: Column, width: timedelta) -> Column:
    """The number of the bin of an instant; it never falls as time goes on."""
    seconds = F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)
    return F.floor(seconds / F.lit(max(1, int(width.total_seconds()))))


def width_for(spans: list[timedelta]) -> timedelta:
    """A width that enters the usual one of these intervals some five times."""
    usual = sorted(spans)[len(spans) // 2] if spans else timedelta(days=1)
    return max(usual / 4, timedelta(hours=1))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: timedelta, *, right_closed: bool = False, small: DataFrame | None = None) -> DataFrame:
    """`points` with the columns of every interval that holds their instant: [start,
    end), or (start, end] if `right_closed`. A null instant or bound meets nothing,
    an interval that ends before it starts holds nothing.

    `small` names the side (one of the two frames) that is known to be small, as a
    list of occasions is: it is broadcast. Without it both sides are dealt by the bin.
    """
    clash = set(points.columns) & set(intervals.columns)
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    low, high = bin_of(F.col(start), width), bin_of(F.col(end), width)
    entered = intervals.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(low, high)))
    asked = points.withColumn("_at", bin_of(F.col(at), width))
    if small is points:
        asked = F.broadcast(asked)
    elif small is intervals:
        entered = F.broadcast(entered)
    holds = (F.col(at) > F.col(start)) & (F.col(at) <= F.col(end)) if right_closed else (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return asked.join(entered, (F.col("_at") == F.col("_bin")) & holds).drop("_at", "_bin")
