"""The one family of models: gradient-boosted trees over counts of binned rows.

Features are cut into bins once, at exact quantiles; all that trees over bins can tell
of rows is how many of them, and of label 1, each cell of bins holds. These counts are
what a fit reads. They are additive: the training set of an expanding or sliding
window is the sum of its origins' counts, so a backtest over any number of origins
passes over the panel once, and all its models are fitted at the same time, a task
each. The number of bins is chosen so that there are at most CELLS cells, whatever
the number of rows; this bounds a task.

Trees are grown level by level on gradient histograms (logistic loss, Newton steps).
Nothing is drawn at random, and ties go to the first feature and lowest cut, so the
same rows give the same model in any order and partitioning; `seed` is taken where
callers name one, and changes nothing.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from origo.functions import ship
from origo.operators import selection

SEED = 2718
CELLS, MOST_BINS, LEAST_ROWS = 1 << 20, 32, 20


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: of each inner node a feature (-1: all go
    left) and a cut (bins up to it go left), of each leaf a step of the margin."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    gains: np.ndarray

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        depth = int(self.leaf.shape[1]).bit_length() - 1 if len(self.leaf) else 0
        rows = np.arange(len(bins))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(bins), dtype=np.int64)
            for level in range(depth):
                at = node + (1 << level) - 1
                f = feature[at]
                node = node * 2 + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > cut[at]))
            out += leaf[node]
        return out

    def probability(self, bins: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(bins))


def _sigmoid(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-m))


def boosted(bins: np.ndarray, n: np.ndarray, positive: np.ndarray, *, trees: int = 20, depth: int = 4, rate: float = 0.1, ridge: float = 0.0, least_rows: int = LEAST_ROWS) -> Trees:
    """Trees of cells: their bins (a row each), how many rows they hold, and how many
    of label 1. One class alone gives its probability and no trees."""
    order = np.lexsort(bins.T[::-1])
    bins, n, positive = bins[order], n[order].astype(float), positive[order].astype(float)
    width, size = bins.shape[1], int(bins.max(initial=0)) + 1
    feature, cut, leaves, gains = [], [], [], np.zeros(width)
    total, ones = n.sum(), positive.sum()
    if not total or ones in (0, total):
        base = np.inf if total and ones else -np.inf
        return Trees(base, np.empty((0, 0), dtype=int), np.empty((0, 0), dtype=int), np.empty((0, 0)), gains)
    base = float(np.log(ones / (total - ones)))
    margin = np.full(len(n), base)
    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = positive - n * p, n * p * (1 - p)
        node = np.zeros(len(n), dtype=np.int64)
        own_feature, own_cut = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, dtype=int)
        for level in range(depth):
            f, c, gain = _splits(bins, node, 1 << level, size, g, h, n, ridge, least_rows)
            at = slice((1 << level) - 1, (2 << level) - 1)
            own_feature[at], own_cut[at] = f, c
            np.add.at(gains, f[f >= 0], gain[f >= 0])
            of = f[node]
            node = node * 2 + ((of >= 0) & (bins[np.arange(len(n)), np.maximum(of, 0)] > c[node]))
        up, down = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        step = rate * np.divide(up, down + ridge, out=np.zeros(1 << depth), where=down + ridge > 0)
        margin = margin + step[node]
        feature.append(own_feature)
        cut.append(own_cut)
        leaves.append(step)
    return Trees(base, np.array(feature), np.array(cut), np.array(leaves), gains)


def _splits(bins: np.ndarray, node: np.ndarray, nodes: int, size: int, g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float, least_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and gain of the best split of every node of a level."""
    best, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, dtype=int)
    for f in range(bins.shape[1]):
        key = node * size + bins[:, f]
        left = [np.bincount(key, x, nodes * size).reshape(nodes, size).cumsum(axis=1) for x in (g, h, n)]
        whole = [x[:, -1:] for x in left]
        right = [w - x for w, x in zip(whole, left)]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
        gain[(left[2] < least_rows) | (right[2] < least_rows) | ~np.isfinite(gain)] = -np.inf
        at = gain.argmax(axis=1)
        gain = gain[np.arange(nodes), at]
        better = gain > np.maximum(best, 1e-12)
        best[better], feature[better], cut[better] = gain[better], f, at[better]
    return feature, cut, best


@dataclass(frozen=True)
class Model:
    """Trees and the cut points of the features they were fitted on."""

    edges: tuple[tuple[float, ...], ...]
    trees: Trees

    def importances(self, feature_cols: list[str]) -> dict[str, float]:
        """Shares of the loss that splits of each feature took away."""
        total = float(self.trees.gains.sum())
        return {c: float(x) / total if total else 0.0 for c, x in zip(feature_cols, self.trees.gains)}


def most_bins(features: int) -> int:
    """So many bins a feature that all of them together have CELLS cells at most."""
    return max(3, min(MOST_BINS, int(CELLS ** (1 / max(features, 1)) + 1e-9)))


def cut_points(rows: DataFrame, feature_cols: list[str], bins: int | None = None) -> tuple[tuple[float, ...], ...]:
    """Exact quantiles of each feature, that part it into bins of about as many
    values; one bin is left for missing values."""
    bins = bins or most_bins(len(feature_cols)) - 1
    shares = {f"q{i}": i / bins for i in range(1, bins)}
    numbers = rows.select(*[_number(F.col(c)).alias(f"_f{i}") for i, c in enumerate(feature_cols)])
    long = numbers.unpivot([], [f"_f{i}" for i in range(len(feature_cols))], "f", "v")
    found = {r["f"]: r for r in selection.quantiles(long, "v", shares, ["f"]).collect()}
    return tuple(tuple(found[f"_f{i}"][q] for q in shares) if f"_f{i}" in found else () for i in range(len(feature_cols)))


def window_cut_points(values: DataFrame, plan: dict[datetime, list[datetime]], features: int, bins: int | None = None) -> dict[datetime, tuple[tuple[float, ...], ...]]:
    """As `cut_points`, for each origin of a plan of all values of the origins that it
    names. `values`: as_of, f (the number of a feature), v (null: missing), n (how many
    rows have it). Values are cut into ranges once for all models; the driver learns how
    many values a range has of each origin, tasks look up what lies in one range."""
    ship(values.sparkSession)
    bins, targets = bins or most_bins(features) - 1, sorted(plan)
    origins = sorted({o for used in plan.values() for o in used})
    used = [np.array([o in plan[t] for o in origins]) for t in targets]
    known, which = _which(origins)
    counts = values.filter(known & F.col("v").isNotNull()).groupBy("f", which.alias("o"), "v").agg(F.sum("n").cast("long").alias("n")).persist()
    ranges = selection.ranged(counts, F.col("v"), ["f"])
    sizes = np.zeros((features, selection.RANGES, len(origins)), dtype=np.int64)
    for r in ranges.groupBy("f", "_r", "o").agg(F.sum("n").alias("n")).collect():
        sizes[r["f"], r["_r"], r["o"]] = r["n"]
    asked, places = {}, {}
    for m, mine in enumerate(used):
        for f in range(features):
            upto = sizes[f][:, mine].sum(axis=1).cumsum()
            if not upto[-1]:
                continue
            at = [(int(upto[-1]) - 1) * (i / bins) for i in range(1, bins)]
            places[m, f] = at
            for rank in {x for a in at for x in (int(np.floor(a)), int(np.ceil(a)))}:
                r = int(np.searchsorted(upto, rank, side="right"))
                asked.setdefault((f, r), []).append((m, rank, rank - int(upto[r - 1] if r else 0)))

    def found(table: pa.Table) -> pa.Table:
        f, r = table.column("f")[0].as_py(), table.column("_r")[0].as_py()
        v, n, o = (table.column(c).to_numpy() for c in ("v", "n", "o"))
        order = np.argsort(v, kind="stable")
        v, n, o, out = v[order], n[order], o[order], []
        for m in sorted({m for m, _, _ in asked.get((f, r), [])}):
            mine = used[m][o]
            upto, held = n[mine].cumsum(), v[mine]
            out += [(m, f, rank, float(held[np.searchsorted(upto, within, side="right")])) for k, rank, within in asked[f, r] if k == m]
        columns = list(zip(*out)) if out else [()] * 4
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64()))], names=["m", "f", "rank", "v"])

    value = {(r["m"], r["f"], r["rank"]): r["v"] for r in ranges.groupBy("f", "_r").applyInArrow(found, "m int, f int, rank long, v double").collect()}
    counts.unpersist()

    def cuts(m: int, f: int) -> tuple[float, ...]:
        ends = [(a, value[m, f, int(np.floor(a))], value[m, f, int(np.ceil(a))]) for a in places.get((m, f), [])]
        return tuple(float(low + (high - low) * (a - np.floor(a))) for a, low, high in ends)

    return {t: tuple(cuts(m, f) for f in range(features)) for m, t in enumerate(targets)}


def _number(column: Column) -> Column:
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def bin_of_value(column: Column, edges: tuple[float, ...]) -> Column:
    """How many cut points lie below a value; missing values have the last bin. A
    batch of values is looked up at once: as a plain expression so many comparisons
    are a method that is too long for the JVM to compile, and are interpreted."""
    cuts = np.sort(np.array(edges, dtype=float))

    @F.pandas_udf("int")
    def below(values: pd.Series) -> pd.Series:
        numbers = values.to_numpy(dtype=float, na_value=np.nan)
        return pd.Series(np.where(np.isnan(numbers), len(cuts) + 1, np.searchsorted(cuts, numbers)).astype(np.int32))

    return below(_number(column))


def bin_of_each(which: Column, column: Column, edges: list[tuple[float, ...]]) -> Column:
    """As `bin_of_value`, by the cut points whose number each row has."""
    cuts = [np.sort(np.array(e, dtype=float)) for e in edges]

    @F.pandas_udf("int")
    def below(which: pd.Series, values: pd.Series) -> pd.Series:
        numbers, at = values.to_numpy(dtype=float, na_value=np.nan), which.to_numpy()
        out = np.empty(len(numbers), dtype=np.int32)
        for m in np.unique(at):
            own = numbers[at == m]
            out[at == m] = np.where(np.isnan(own), len(cuts[m]) + 1, np.searchsorted(cuts[m], own))
        return pd.Series(out)

    return below(which, _number(column))


def binned_by(which: Column, edges: list[tuple], feature_cols: list[str]) -> list[Column]:
    """As `binned`, by the cut points of the model whose number each row has."""
    return [bin_of_each(which, F.col(c), [e[i] for e in edges]).alias(f"_b{i}") for i, c in enumerate(feature_cols)]


def binned(edges: tuple, feature_cols: list[str]) -> list[Column]:
    return [bin_of_value(F.col(c), e).alias(f"_b{i}") for i, (c, e) in enumerate(zip(feature_cols, edges))]


def bin_names(width: int) -> list[str]:
    return [f"_b{i}" for i in range(width)]


def cells(rows: DataFrame, feature_cols: list[str], y_col: str, edges: tuple, by: list[str]) -> DataFrame:
    """`by, _b0, _b1..., n, positive`: the counts of each cell of bins."""
    names = bin_names(len(feature_cols))
    told = rows.select(*by, *binned(edges, feature_cols), F.col(y_col).cast("long").alias("_y"))
    return told.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positive"))


def _fitted(counts: DataFrame, width: int, options: dict) -> dict[int, Trees]:
    """The trees of each group `_m` of counts, fitted in a task each. What comes to
    the driver is a few numbers for each tree."""
    ship(counts.sparkSession)
    names = [f"_b{i}" for i in range(width)]

    def work(table: pa.Table) -> pa.Table:
        bins = np.column_stack([table.column(c).to_numpy() for c in names]).astype(np.int64)
        trees = boosted(bins, table.column("n").to_numpy(), table.column("positive").to_numpy(), **options)
        return pa.table({"_m": pa.array([table.column("_m")[0].as_py()], pa.int32()), "trees": pa.array([pickle.dumps(trees)], pa.binary())})

    return {r["_m"]: pickle.loads(r["trees"]) for r in counts.groupBy("_m").applyInArrow(work, "_m int, trees binary").collect()}


NONE = boosted(np.zeros((0, 1), dtype=np.int64), np.zeros(0), np.zeros(0))


def fit(train: DataFrame, feature_cols: list[str], y_col: str = "churned", *, seed: int = SEED, edges: tuple | None = None, **options) -> Model:
    """A model of all rows. `edges` are cut points found before."""
    edges = cut_points(train, feature_cols) if edges is None else edges
    counts = cells(train, feature_cols, y_col, edges, []).withColumn("_m", F.lit(0))
    return Model(edges, _fitted(counts, len(feature_cols), options).get(0, NONE))


def fit_groups(train: DataFrame, group: str, feature_cols: list[str], y_col: str = "churned", *, edges: tuple, **options) -> dict[int, Model]:
    """A model of the rows of each number in a column, fitted at the same time."""
    return fit_counts(cells(train, feature_cols, y_col, edges, [group]).withColumnRenamed(group, "_m"), edges, **options)


def fit_counts_each(counts: DataFrame, edges: list[tuple], **options) -> dict[int, Model]:
    """As `fit_counts`, with cut points of each model."""
    return {m: Model(edges[m], trees) for m, trees in _fitted(counts, len(edges[0]), options).items()}


def fit_counts(counts: DataFrame, edges: tuple, **options) -> dict[int, Model]:
    """A model of each number `_m` of counts of cells, fitted at the same time."""
    return {m: Model(edges, trees) for m, trees in _fitted(counts, len(edges), options).items()}


def predict_counts(models: dict[int, Model], counts: DataFrame, group: Column, width: int, p_col: str = "p") -> DataFrame:
    """Counts of cells with what the model of each one's number says. All rows of a
    cell have the same score, so metrics can read counts in place of rows."""
    ship(counts.sparkSession)
    score = _scorer([models[m].trees if m in models else NONE for m in range(max(models, default=-1) + 1)])
    return counts.withColumn(p_col, score(group, *bin_names(width)))


def predict_groups(models: dict[int, Model], df: DataFrame, group: str, feature_cols: list[str], p_col: str = "p") -> DataFrame:
    """`df` with what the model of each row's group says; groups count from 0."""
    ship(df.sparkSession)
    score = _scorer([models[m].trees if m in models else NONE for m in range(max(models, default=-1) + 1)])
    edges = next(iter(models.values())).edges if models else ()
    return df.withColumn(p_col, score(F.col(group), *binned(edges, feature_cols)))


def fit_windows(panel: DataFrame, plan: dict[datetime, list[datetime]], feature_cols: list[str], y_col: str = "churned", *, edges: tuple, counts: DataFrame | None = None, **options) -> dict[datetime, Model]:
    """A model for each origin of a plan, of the origins that it names for it. Counts
    are taken once, or given; a model's are the sums of its origins'."""
    targets = sorted(plan)
    pairs = [(i, origin) for i, target in enumerate(targets) for origin in plan[target]]
    if not pairs:
        return {}
    spark = panel.sparkSession
    uses = F.broadcast(spark.createDataFrame(pairs, "_m int, as_of timestamp_ntz"))  # a row for each pair of occasions
    names = [f"_b{i}" for i in range(len(feature_cols))]
    each = (cells(panel, feature_cols, y_col, edges, ["as_of"]) if counts is None else counts).join(uses, "as_of")
    sums = each.groupBy("_m", *names).agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    return {targets[m]: Model(edges, trees) for m, trees in _fitted(sums, len(feature_cols), options).items()}


def _scorer(trees: list[Trees]):
    @F.pandas_udf("double")
    def score(which: pd.Series, *bins: pd.Series) -> pd.Series:
        matrix = np.column_stack([b.to_numpy() for b in bins]).astype(np.int64)
        out = np.empty(len(which))
        for m in which.unique():
            at = (which == m).to_numpy()
            out[at] = trees[m].probability(matrix[at])
        return pd.Series(out)

    return score


def predict(model: Model, df: DataFrame, feature_cols: list[str], p_col: str = "p") -> DataFrame:
    """`df` with the probability of label 1."""
    ship(df.sparkSession)
    return df.withColumn(p_col, _scorer([model.trees])(F.lit(0), *binned(model.edges, feature_cols)))


def predict_windows(models: dict[datetime, Model], df: DataFrame, feature_cols: list[str], p_col: str = "p") -> DataFrame:
    """The rows of the origins that have a model, each with what its own one says."""
    targets = sorted(models)
    if not targets:
        return df.limit(0).withColumn(p_col, F.lit(0.0))
    ship(df.sparkSession)
    known, which = _which(targets)
    score = _scorer([models[t].trees for t in targets])
    edges = [models[t].edges for t in targets]
    bins = binned(edges[0], feature_cols) if len(set(edges)) == 1 else binned_by(which, edges, feature_cols)
    return df.filter(known).withColumn(p_col, score(which, *bins))


def _which(targets: list[datetime]) -> tuple[Column, Column]:
    """Whether a row's origin is one of these, and its place among them."""
    instants = F.array(*[F.lit(t).cast("timestamp_ntz") for t in targets])
    return F.array_contains(instants, F.col("as_of")), (F.array_position(instants, F.col("as_of")) - 1).cast("int")


def predict_window_counts(models: dict[datetime, Model], counts: DataFrame, width: int, p_col: str = "p") -> DataFrame:
    """As `predict_windows`, of counts of cells."""
    targets = sorted(models)
    if not targets:
        return counts.limit(0).withColumn(p_col, F.lit(0.0))
    known, which = _which(targets)
    return predict_counts({i: models[t] for i, t in enumerate(targets)}, counts.filter(known), which, width, p_col)
