"""What the operators share: column builders, and the package for the executors."""

from __future__ import annotations

import math
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours from `earlier` to `later`, rounded down."""
    days = F.timestamp_diff("DAY", earlier, later)
    return F.when(F.timestamp_add("DAY", days.cast("int"), earlier) > later, days - 1).otherwise(days)


def calendar_days(later: Column, earlier: Column) -> Column:
    """Midnights passed between `earlier` and `later`."""
    return F.date_diff(later, earlier)


def add_days(ts: Column, days: Column | int) -> Column:
    return F.timestamp_add("DAY", F.lit(days) if isinstance(days, int) else days, ts)


def positive(number: Column) -> Column:
    """Whether a number is above zero; NaN and null are not."""
    return F.coalesce(~F.isnan(number.cast("double")) & (number > 0), F.lit(False))


def said(column: Column) -> Column:
    """A value as text, that no other value of its column shares: null, NaN and the
    text `null` are told apart; both zeros are one."""
    text = column.cast("string")
    return F.when(column.isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text))


def _digits(seed: int, ids: tuple[Column | str, ...], start: int, n: int) -> Column:
    columns = [F.col(c) if isinstance(c, str) else c for c in ids]
    text = F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), start, n), 16, 10).cast("long")


def uniform(seed: int, *ids: Column | str) -> Column:
    """A number in [0, 1) for a row: 52 bits of the MD5 of its ids and the seed. It
    counts nothing and keeps no state, so it is the same for any partitioning, in any
    order, after any retry, and in SQL."""
    return _digits(seed, ids, 1, 13) / F.lit(1 << 52)


def normal(seed: int, *ids: Column | str) -> Column:
    """A standard normal number for a row, of two independent uniform ones."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(seed, *ids)))
    return radius * F.cos(2 * math.pi * (_digits(seed, ids, 14, 13) / F.lit(1 << 52)))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once an application; they
    need not find the driver's folders."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="origo-ship-")) / "origo-src.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(to))
        _SHIPPED.add(sc.applicationId)
    return spark
