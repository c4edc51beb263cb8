"""Calibration of scores: tables, decomposition, Platt and isotonic maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from origo.functions import ship
from origo.operators import selection


def reliability_table(df: DataFrame, y_col: str = "y", p_col: str = "p", n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """`bin, bin_lower, bin_upper, n, mean_predicted, observed_rate` of bins of
    equal width, closed on the right; the first one includes 0. Empty bins have
    no row."""
    by = by or []
    edges = F.array(*[F.lit(i / n_bins) for i in range(n_bins)])
    number = F.greatest(F.size(F.filter(edges, lambda e: e < F.col(p_col))) - 1, F.lit(0))
    return (
        df.groupBy(*by, number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p_col).alias("mean_predicted"), F.avg(y_col).alias("observed_rate"))
        .select(*by, "bin", (F.col("bin") / n_bins).alias("bin_lower"), ((F.col("bin") + 1) / n_bins).alias("bin_upper"), "n", "mean_predicted", "observed_rate")
    )


def reliability_gap(table: DataFrame) -> DataFrame:
    """A reliability table with its signed gap."""
    return table.withColumn("gap", F.col("observed_rate") - F.col("mean_predicted"))


def brier_decomposition(df: DataFrame, y_col: str = "y", p_col: str = "p", n_bins: int = 10) -> DataFrame:
    """One row: `reliability, resolution, uncertainty, brier_binned`; the last is
    uncertainty - resolution + reliability."""
    bins = reliability_table(df, y_col, p_col, n_bins)
    base = F.broadcast(df.agg(F.avg(y_col).alias("_base"), F.count(F.lit(1)).alias("_all")))  # one row
    parts = bins.join(base).groupBy("_base", "_all").agg(
        (F.sum(F.col("n") * F.pow(F.col("mean_predicted") - F.col("observed_rate"), 2)) / F.col("_all")).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("observed_rate") - F.col("_base"), 2)) / F.col("_all")).alias("resolution"),
    )
    parts = parts.withColumn("uncertainty", F.col("_base") * (1 - F.col("_base")))
    return parts.select("reliability", "resolution", "uncertainty", (F.col("uncertainty") - F.col("resolution") + F.col("reliability")).alias("brier_binned"))


def bin_sensitivity(df: DataFrame, bins: tuple[int, ...] = (5, 10, 15, 20, 30), y_col: str = "y", p_col: str = "p") -> DataFrame:
    """The decomposition for several numbers of bins."""
    out = None
    for n in bins:
        part = brier_decomposition(df, y_col, p_col, n).withColumn("n_bins", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def winner_by_bins(df: DataFrame, variant: str, bins: tuple[int, ...] = (5, 10, 15, 20, 30), y_col: str = "y", p_col: str = "p") -> DataFrame:
    """`n_bins, winner, reliability`: for each number of bins the variant with the
    least reliability term, of equal ones the first by name."""
    out = None
    for n in bins:
        cells = reliability_table(df, y_col, p_col, n, [variant])
        part = cells.groupBy(variant).agg((F.sum(F.col("n") * F.pow(F.col("mean_predicted") - F.col("observed_rate"), 2)) / F.sum("n")).alias("reliability")).withColumn("n_bins", F.lit(n))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("n_bins").agg(F.min(F.struct("reliability", variant)).alias("_best"))
    return best.select("n_bins", F.col("_best")[variant].alias("winner"), F.col("_best.reliability").alias("reliability"))


class Platt:
    """A logistic map of scores with the usual ridge of strength 1 on its slope."""

    def __init__(self, model):
        self.model = model

    @classmethod
    def fit(cls, df: DataFrame, y_col: str = "y", p_col: str = "p") -> Platt:
        rows = VectorAssembler(inputCols=[p_col], outputCol="_x").transform(df.withColumn("_y", F.col(y_col).cast("double")))
        n = rows.count()
        return cls(LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9).fit(rows))

    def transform(self, df: DataFrame, p_col: str = "p", out_col: str = "calibrated") -> DataFrame:
        slope, intercept = float(self.model.coefficients[0]), float(self.model.intercept)
        return df.withColumn(out_col, 1 / (1 + F.exp(-(F.col(p_col) * slope + intercept))))


def _pooled(weight: np.ndarray, total: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Blocks in order of scores, pooled until their means rise: the slopes of the
    greatest convex minorant of the cumulative sums. Sums are whole numbers, so means
    are compared exactly."""
    held: list[list] = []
    for block in zip(weight.tolist(), total.tolist(), low.tolist(), high.tolist()):
        held.append(list(block))
        while len(held) > 1 and held[-2][1] * held[-1][0] >= held[-1][1] * held[-2][0]:
            w, s, _, h = held.pop()
            held[-1][0] += w
            held[-1][1] += s
            held[-1][3] = h
    return [np.array(x) for x in zip(*held)] if held else [weight, total, low, high]


_BLOCKS = "weight long, total long, low double, high double"


def _pool(table: pa.Table) -> pa.Table:
    table = table.sort_by("low")
    names = ["weight", "total", "low", "high"]
    found = _pooled(*(table.column(c).to_numpy() for c in names))
    return pa.table({c: pa.array(x, table.schema.field(c).type) for c, x in zip(names, found)})


def isotonic_blocks(df: DataFrame, y_col: str = "y", p_col: str = "p") -> DataFrame:
    """`weight, total, low, high`: the blocks of scores that share a calibrated value
    (total / weight), of labels 0 and 1.

    Rows are reduced to distinct scores, these dealt into ranges, and each range is
    pooled by itself. What is left of a range of m rows are slopes of a convex
    line over whole numbers, all different, at most about m ** (2 / 3) of them (and
    some m ** (1 / 3) in practice); only these meet in one task, where neighbouring
    ranges are pooled on.
    """
    ship(df.sparkSession)
    scores = df.groupBy(F.col(p_col).cast("double").alias("low")).agg(F.count(F.lit(1)).alias("weight"), F.sum(F.col(y_col).cast("long")).alias("total"))
    cut = selection.ranged(scores.filter(F.col("low").isNotNull()), F.col("low"), []).withColumn("high", F.col("low"))
    inside = cut.groupBy("_r").applyInArrow(lambda t: _pool(t.select(["weight", "total", "low", "high"])), _BLOCKS)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from _pool(pa.Table.from_batches(held)).to_batches()

    return inside.repartition(1).mapInArrow(rest, _BLOCKS)


class Isotonic:
    """A monotone map by pooling adjacent violators; linear between its knots and
    constant beyond them."""

    def __init__(self, knots: np.ndarray, values: np.ndarray):
        self.knots, self.values = knots, values

    @classmethod
    def fit(cls, df: DataFrame, y_col: str = "y", p_col: str = "p") -> Isotonic:
        rows = sorted(tuple(r) for r in isotonic_blocks(df, y_col, p_col).select("low", "high", "total", "weight").collect())
        # Both ends of each block, once where it is a single score.
        ends = [(x, s / w) for low, high, s, w in rows for x in dict.fromkeys((low, high))]
        return cls(np.array([x for x, _ in ends]), np.array([v for _, v in ends]))

    def transform(self, df: DataFrame, p_col: str = "p", out_col: str = "calibrated") -> DataFrame:
        """`df` with calibrated scores; a null score, and any without a fit, is null."""
        ship(df.sparkSession)
        knots, values = self.knots, self.values

        @F.pandas_udf("double")
        def mapped(p: pd.Series) -> pd.Series:
            if not len(knots):
                return pd.Series([None] * len(p), dtype="float64")
            return pd.Series(np.where(p.isna(), np.nan, np.interp(p.to_numpy(dtype=float, na_value=np.nan), knots, values))).where(p.notna().to_numpy())

        return df.withColumn(out_col, F.nanvl(mapped(F.col(p_col).cast("double")), F.lit(None).cast("double")))
