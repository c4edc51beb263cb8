"""Comparing frames, rankings and arms, and drawing reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from origo.functions import said
from origo.operators import backtest, leakage, metrics, selection
from origo.operators.model import cut_points
from origo.operators.windows import Window


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: `n, fingerprint` of a table as a bag of rows, in one pass that
    shuffles a row for each task.

    A row is the text of its columns, ordered by name; its MD5 is four numbers of 32
    bits, which are summed over all rows. The order of rows and columns counts for
    nothing, repeated rows count each time. Two tables that differ have the same
    fingerprint with a chance of 2**-128 or so. Columns must have different names;
    nested ones are taken as JSON, bytes as hexadecimal digits.
    """
    def plain(name: str):
        kind, column = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
            return F.to_json(column, {"ignoreNullFields": "false"})
        if isinstance(kind, T.BinaryType):
            return F.hex(column)
        return F.when(column == 0, F.lit(0).cast(kind)).otherwise(column) if isinstance(kind, T.DoubleType | T.FloatType) else column

    text = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), said(plain(c))) for c in sorted(df.columns)])
    rows = df.select(F.md5(text).alias("_h"))
    parts = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"s{i}") for i, x in enumerate(parts)])
    digits = F.concat(*[F.lpad(F.lower(F.hex((F.col(f"s{i}") % (1 << 32)).cast("long"))), 8, "0") for i in range(4)])
    return sums.select("n", digits.alias("fingerprint"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often, by their fingerprints."""
    return fingerprint(a).first() == fingerprint(b.select(*a.columns)).first()


def assert_reproduced(again: DataFrame, saved: dict) -> None:
    """Raise unless a table has the fingerprint that an earlier run wrote down."""
    found = fingerprint(again).first().asDict()
    if found != {k: saved[k] for k in found}:
        raise ValueError(f"recomputed {found}, saved {saved}")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether two frames hold the same keys."""
    a, b = a.select(*keys).distinct(), b.select(*keys).distinct()
    return a.join(b, keys, "left_anti").isEmpty() and b.join(a, keys, "left_anti").isEmpty()


def draw(*ids: str, seed: int) -> Column:
    """An order of rows that looks random and is the same in any engine."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def simple_sample(df: DataFrame, n: int, id_cols: list[str], seed: int) -> DataFrame:
    """n rows at random."""
    return df.orderBy(draw(*id_cols, seed=seed), *id_cols).limit(n)


def sample_per_category(df: DataFrame, category: str, n: int, id_cols: list[str], seed: int) -> DataFrame:
    """At most n random rows of each category."""
    order = W.partitionBy(category).orderBy(draw(*id_cols, seed=seed), *id_cols)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def cohort_split(tx: DataFrame, share: float = 0.8, *, key: str = "customer_id", time_col: str = "invoice_date") -> DataFrame:
    """`customer_id, is_train`: whose first event lies before that quantile of all
    first events."""
    first = tx.groupBy(key).agg(F.min(time_col).alias("_first"))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("_first"))
    cut = selection.quantiles(first.select(seconds.alias("_s")), "_s", {"_cut": share})
    return first.join(F.broadcast(cut.select("_cut"))).select(key, (seconds < F.col("_cut")).alias("is_train"))


def rank_differences(df: DataFrame, p_col: str, q_col: str, id_col: str, top: int) -> DataFrame:
    """One row: how many rows change their rank between two scores, and how many
    of the top rows of one aren't among those of the other."""
    rows = df.select(F.col(p_col).alias("_a"), F.col(q_col).alias("_b"), F.col(id_col).alias("_id"))
    both = selection.ranked(selection.ranked(rows, [-F.col("_a"), F.col("_id")], "_p"), [-F.col("_b"), F.col("_id")], "_q")
    return both.agg(F.count_if(F.col("_p") != F.col("_q")).alias("moved"), F.count_if((F.col("_p") <= top) & (F.col("_q") > top)).alias("left_top"))


def label_agreement(panel: DataFrame, official: DataFrame, *, key: str = "customer_id", y_col: str = "churned", official_col: str = "is_churn") -> DataFrame:
    """One row: `n, agreement` of a panel's labels with others for the same keys."""
    both = panel.join(official, key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y_col) == F.col(official_col)).cast("int")).alias("agreement"))


def label_shift(a: DataFrame, b: DataFrame, keys: list[str], y_col: str = "churned") -> DataFrame:
    """`label_a, label_b, n` of rows that two arms share."""
    both = a.select(*keys, F.col(y_col).alias("label_a")).join(b.select(*keys, F.col(y_col).alias("label_b")), keys)
    return both.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def delta_by_class(naive: DataFrame, asof: DataFrame, feature: str, keys: list[str], y_col: str = "churned") -> DataFrame:
    """`churned, n, median_delta` of a feature, naive minus as-of."""
    both = naive.select(*keys, F.col(feature).alias("_a")).join(asof.select(*keys, y_col, F.col(feature).alias("_b")), keys)
    return selection.medians(both.withColumn("_d", F.col("_a") - F.col("_b")), "_d", [y_col], "median_delta")


def frozen_minus_retrained(frozen: DataFrame, retrained: DataFrame) -> DataFrame:
    """`as_of, origins_since_training, auc_delta` of two backtests' origins."""
    a, b = frozen.select("as_of", "origins_since_training", F.col("roc_auc").alias("_a")), retrained.select("as_of", F.col("roc_auc").alias("_b"))
    return a.join(b, "as_of").select("as_of", "origins_since_training", (F.col("_a") - F.col("_b")).alias("auc_delta"))


def sliding_sweep(panel: DataFrame, windows: list[Window], feature_cols: list[str], lookbacks: list[int], **options) -> DataFrame:
    """Pooled scores of the backtest for several lookbacks; one that trains
    nothing has no row."""
    out, held = None, backtest.counted(panel, windows, feature_cols)
    for days in lookbacks:
        _, scored = backtest.rolling_counts(held, windows, feature_cols, max_lookback_days=days, **options)
        part = metrics.score_counts(scored).filter("n > 0").withColumn("lookback_days", F.lit(days))
        out = part if out is None else out.unionByName(part)
    return out


def leakage_table(naive: DataFrame, asof: DataFrame, train: DataFrame, test: DataFrame, feature_cols: list[str], keys: list[str], *, seed: int, y_col: str = "churned") -> DataFrame:
    """`feature, auc, ablation_cost, pct_differing, median_delta`, by cost."""
    ablated = leakage.ablation_auc(train, test, feature_cols, y_col, seed=seed)
    cost = naive.sparkSession.createDataFrame([(c, ablated["all features"] - ablated[f"drop {c}"]) for c in feature_cols], "feature string, ablation_cost double")
    alone, delta = leakage.single_feature_auc(naive, feature_cols, y_col), leakage.feature_delta(naive, asof, feature_cols, keys)
    return alone.join(cost, "feature").join(delta, "feature").select("feature", "auc", "ablation_cost", "pct_differing", "median_delta").orderBy(F.desc("ablation_cost"), "feature")


def ablation_stability(df: DataFrame, feature_cols: list[str], id_cols: list[str], seeds: list[int], *, share: float = 0.2, y_col: str = "churned") -> DataFrame:
    """`variant, mean, std, low, high` of the ablation's AUC over several splits."""
    edges = cut_points(df, feature_cols)  # cut points know no labels
    counts = leakage.split_cells(df, feature_cols, y_col, id_cols, share, seeds, edges)
    rows = [pair for found in leakage.ablations(counts, feature_cols, edges, len(seeds)) for pair in found.items()]
    return summary(df.sparkSession.createDataFrame(rows, "variant string, auc double"), "auc", ["variant"])


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """`mean, std, low, high` of a value in each group; std is of a sample, and null
    for one row."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def pivoted(df: DataFrame, index: str, column: str, values: list, *, prefix: str) -> DataFrame:
    """Counts of `column` by `index`, a column for each of the values, and `total`."""
    counts = df.groupBy(index).agg(*[F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values], F.count(F.lit(1)).alias("total"))
    return counts


def pivoted_means(df: DataFrame, index: str, column: str, values: list, value: str, *, prefix: str = "") -> DataFrame:
    """Means of `value` by `index`, a column for each of the given values of `column`;
    one that has no rows there is null."""
    return df.groupBy(index).agg(*[F.avg(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values])


def transposed(df: DataFrame, index: str, columns: list[str], values: list, *, name: str = "name", total: str | None = None) -> DataFrame:
    """Rows become columns: a row for each of `columns`, with its value at each of the
    given values of `index`, and their sum if `total` names it. Where an index value
    is repeated, its values are summed; where it is missing, the cell is null."""
    long = df.select(index, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(index, columns, name, "_value")
    sums = [F.sum(F.when(F.col(index) == v, F.col("_value"))).alias(str(v)) for v in values]
    return long.groupBy(name).agg(*sums, *([F.sum("_value").alias(total)] if total else []))


def looked_up(df: DataFrame, column: str, names: dict, out: str, default=None) -> DataFrame:
    """`df` with what a small map says of a column; values that it lacks get the
    default. The map is part of the expression: no join, no shuffle."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    found = F.element_at(pairs, F.col(column)) if pairs is not None else F.lit(None)
    return df.withColumn(out, F.coalesce(found, F.lit(default)) if default is not None else found)


def origins_seen(panel: DataFrame, *, key: str = "customer_id") -> DataFrame:
    """`customer_id, origins`: the set of origins that a customer is in, in order."""
    return panel.groupBy(key).agg(F.array_sort(F.collect_set("as_of")).alias("origins"))
