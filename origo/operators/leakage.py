"""Diagnostics for leakage: features or splits that know too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from origo.operators import metrics, selection


def long_features(df: DataFrame, feature_cols: list[str], keep: list[str]) -> DataFrame:
    """`keep`, `feature`, `value`: a row for each feature of each row."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in feature_cols]).unpivot(keep, feature_cols, "feature", "value")


def single_feature_auc(df: DataFrame, feature_cols: list[str], y_col: str = "churned") -> DataFrame:
    """`feature, auc`: how well each feature alone ranks, in either direction."""
    rows = long_features(df, feature_cols, [y_col]).filter(F.col("value").isNotNull())
    counts = rows.groupBy("feature", "value").agg(F.sum(F.col(y_col).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    # Two levels: sums of ranges of values, then running sums within each range,
    # so no task orders all values of a feature.
    counts = selection.ranged(counts, F.col("value"), ["feature"], "r")
    sums = selection.sums_before(counts, ["feature"], {"base": "tp"}, "r", descending=True)
    inside = W.partitionBy("feature", "r").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.join(F.broadcast(sums), ["feature", "r"]).withColumn("tp_above", F.col("base") + F.coalesce(F.sum("tp").over(inside), F.lit(0)))  # a row for each range
    fp = F.col("n") - F.col("tp")
    sums = counts.groupBy("feature").agg(F.sum(fp * (F.col("tp_above") + F.col("tp") / 2)).alias("pairs"), F.sum("tp").alias("pos"), F.sum(fp).alias("neg"))
    auc = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("pairs") / (F.col("pos") * F.col("neg")))
    return sums.select("feature", F.greatest(auc, 1 - auc).alias("auc"))


def assert_no_dominant_single_feature(df: DataFrame, feature_cols: list[str], y_col: str = "churned", *, threshold: float = 0.99) -> None:
    """Raise if one feature alone ranks better than the threshold."""
    found = [r["feature"] for r in single_feature_auc(df, feature_cols, y_col).filter(F.col("auc") > threshold).collect()]
    if found:
        raise ValueError(f"single features rank too well: {', '.join(sorted(found))}")


def feature_delta(naive: DataFrame, asof: DataFrame, feature_cols: list[str], keys: list[str]) -> DataFrame:
    """`feature, pct_differing, median_delta, mean_delta` of naive minus as-of."""
    # Rows meet once; only then does each feature get a row.
    a = naive.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in feature_cols])
    b = asof.select(*keys, *[F.col(c).cast("double").alias(f"_b_{c}") for c in feature_cols])
    wide = a.join(b, keys).select(*[(F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(c) for c in feature_cols])
    delta = wide.unpivot([], feature_cols, "feature", "d")
    means = delta.groupBy("feature").agg(F.avg((F.col("d") != 0).cast("int")).alias("pct_differing"), F.avg("d").alias("mean_delta"))
    middle = selection.medians(delta, "d", ["feature"], "median_delta")
    return means.join(F.broadcast(middle), "feature", "left").select("feature", "pct_differing", "median_delta", "mean_delta")  # a row for each feature


def correlation(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """`a, b, correlation` of each pair of features (Pearson)."""
    pairs = [(a, b) for i, a in enumerate(feature_cols) for b in feature_cols[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def customer_overlap(train: DataFrame, test: DataFrame, key: str = "customer_id") -> DataFrame:
    """One row: `n_train, n_test, n_both, share_seen` of distinct customers."""
    a = train.select(key).distinct().withColumn("_a", F.lit(1))
    b = test.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    n = both.agg(F.count("_a").alias("n_train"), F.count("_b").alias("n_test"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"))
    return n.withColumn("share_seen", F.col("n_both") / F.col("n_test"))


def label_agreement_by_lag(panel: DataFrame, lags: tuple[int, ...] = (1, 2, 3), *, key: str = "customer_id", y_col: str = "churned") -> DataFrame:
    """`lag, agreement, independent`: how often a customer's labels agree that
    many origins apart, and how often they would by chance, as means over pairs
    of origins."""
    order = panel.select("as_of").distinct().withColumn("idx", F.row_number().over(W.partitionBy().orderBy("as_of")))  # a row for each origin
    rows = panel.join(F.broadcast(order), "as_of").select(key, "idx", F.col(y_col).alias("y"))
    later = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).select(key, (F.col("idx") - F.col("lag")).alias("idx"), "lag", F.col("y").alias("_y"))
    pairs = rows.join(later, [key, "idx"]).groupBy("lag", "idx").agg(F.avg((F.col("y") == F.col("_y")).cast("int")).alias("a"), F.avg("y").alias("p"), F.avg("_y").alias("q"))
    return pairs.groupBy("lag").agg(F.avg("a").alias("agreement"), F.avg(F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))).alias("independent"))


def dealt(key: Column, seed: int, share: float) -> Column:
    """Whether a key falls into a share, the same each time."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)


def drawn(id_cols: list[str], seed: int) -> Column:
    """A number of 60 bits that puts rows in an order that looks random, the same in
    any engine: the first 15 hexadecimal digits of an MD5 of the ids and the seed."""
    said = F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, y_col: str, id_cols: list[str], share: float, seed: int) -> DataFrame:
    """`df` with `is_test`: of each class the floor(share * n) rows that are drawn
    first. The class's threshold is selected from its draws, and the split is a
    filter; rows with the same ids stay on one side."""
    rows = df.withColumn("_drawn", drawn(id_cols, seed))
    last = selection.selected(rows, "_drawn", [y_col], {"_last": lambda n: F.floor(n * F.lit(float(share))) - 1}).select(F.col(y_col).alias("_class"), "_last")
    both = rows.join(F.broadcast(last), F.col(y_col).eqNullSafe(F.col("_class")), "left")  # a row for each class
    return both.withColumn("is_test", F.coalesce(F.col("_drawn") <= F.col("_last"), F.lit(False))).drop("_drawn", "_last", "_class")


BLOCKS = 12  # bits of a draw that are counted first


def split_cells(df: DataFrame, feature_cols: list[str], y_col: str, id_cols: list[str], share: float, seeds: list[int], edges: tuple) -> DataFrame:
    """`_split, is_test, _b0, _b1..., n, positive`: the counts of cells of both sides
    of the stratified split by each seed; `_split` is the seed's place.

    Draws are counted by their first bits, which tells the block that the last row of
    a class's test side lies in. Only rows of that block keep their draws in the
    counts; these tell the side of the rest exactly. No row is shuffled.
    """
    from origo.operators.model import bin_names, binned

    names, block = bin_names(len(feature_cols)), F.shiftright("_drawn", 60 - BLOCKS)
    ids = [f"_i{i}" for i in range(len(id_cols))]
    rows = df.select(F.col(y_col).alias("_y"), *[F.col(c).cast("string").alias(i) for c, i in zip(id_cols, ids)], *binned(edges, feature_cols))
    rows = rows.select("_y", *names, F.posexplode(F.array(*[drawn(ids, s) for s in seeds])).alias("_split", "_drawn"))

    def place(counts: DataFrame, at: str, rank: Column) -> DataFrame:
        """`_s, _c, <at>, rest` of the value of a class of a split that holds a rank
        from 0, and how many rows with that value come before it."""
        own = W.partitionBy("_split", "_y")
        upto = F.sum("_k").over(own.orderBy(at).rowsBetween(W.unboundedPreceding, 0))
        told = counts.withColumn("_upto", upto).withColumn("_rank", rank if rank is not None else F.floor(F.sum("_k").over(own) * F.lit(float(share))) - 1)
        found = told.filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_k")))
        return found.select(F.col("_split").alias("_s"), F.col("_y").alias("_c"), F.col(at).alias("_cut"), (F.col("_rank") - F.col("_upto") + F.col("_k")).alias("_rest"))

    same = (F.col("_split") == F.col("_s")) & (F.col("_y") == F.col("_c"))  # rows without a class are never in the test
    blocks = rows.groupBy("_split", "_y", block.alias("_block")).agg(F.count(F.lit(1)).alias("_k"))
    near = rows.withColumn("_block", block).join(F.broadcast(place(blocks, "_block", None)), same, "left")  # a row for each class and seed
    counts = near.groupBy(
        "_split", "_y", *names, F.coalesce(F.col("_block") < F.col("_cut"), F.lit(False)).alias("is_test"),
        F.when(F.col("_block") == F.col("_cut"), F.col("_drawn")).alias("_drawn"), "_rest",
    ).agg(F.count(F.lit(1)).alias("n")).persist()
    edge = counts.filter("_drawn is not null").groupBy("_split", "_y", "_drawn").agg(F.sum("n").alias("_k"), F.first("_rest").alias("_rest"))
    last = F.broadcast(place(edge, "_drawn", F.col("_rest")).drop("_rest"))  # a row for each class and seed
    told = counts.join(last, same, "left").withColumn("is_test", F.col("is_test") | F.coalesce(F.col("_drawn") <= F.col("_cut"), F.lit(False)))
    return told.groupBy("_split", "is_test", *names).agg(F.sum("n").alias("n"), F.sum(F.col("_y").cast("long") * F.col("n")).alias("positive"))


def adversarial_auc(a: DataFrame, b: DataFrame, feature_cols: list[str], *, seed: int, test_share: float = 0.3, group_col: str | None = None) -> tuple[float, dict[str, float]]:
    """How well a model tells the rows of `a` from those of `b`, and what it goes
    by. With `group_col` all rows of an entity fall on one side of the split."""
    from origo.operators.model import Model, NONE, cells, cut_points, fit_counts, predict_counts

    keep = list(dict.fromkeys([*feature_cols, *([group_col] if group_col else [])]))
    rows = a.select(*keep).withColumn("_m", F.lit(0)).unionByName(b.select(*keep).withColumn("_m", F.lit(1)))
    if group_col:
        rows = rows.withColumn("is_test", dealt(F.col(group_col), seed, test_share))
    else:
        rows = stratified_split(rows, "_m", feature_cols, test_share, seed)
    edges = cut_points(rows.filter(~F.col("is_test")), feature_cols)
    counts = cells(rows, feature_cols, "_m", edges, ["is_test"]).coalesce(4).persist()
    model = fit_counts(counts.filter(~F.col("is_test")).withColumn("_m", F.lit(0)), edges).get(0, Model(edges, NONE))
    told = metrics.score_counts(predict_counts({0: model}, counts.filter("is_test"), F.lit(0), len(feature_cols))).first()
    counts.unpersist()
    return told["roc_auc"], model.importances(feature_cols)


def ablation_auc(train: DataFrame, test: DataFrame, feature_cols: list[str], y_col: str = "churned", *, seed: int, edges: tuple | None = None) -> dict[str, float]:
    """AUC with all features and without each; all models are fitted in one pass."""
    from origo.operators.model import cells, cut_points

    edges = cut_points(train, feature_cols) if edges is None else edges
    one = lambda df, side: cells(df, feature_cols, y_col, edges, []).withColumns({"_split": F.lit(0), "is_test": F.lit(side)})
    return ablations(one(train, False).unionByName(one(test, True)), feature_cols, edges, 1)[0]


def ablations(counts: DataFrame, feature_cols: list[str], edges: tuple, splits: int) -> list[dict[str, float]]:
    """The AUCs of `ablation_auc` of each of several splits, from counts as those of
    `split_cells`. A variant without a feature adds up the cells that differ in it."""
    from origo.operators.model import bin_names, fit_counts, predict_counts

    names, bins = ["all features", *[f"drop {c}" for c in feature_cols]], bin_names(len(feature_cols))
    each = counts.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(len(feature_cols)))))
    each = each.select("is_test", (F.col("_split") * len(names) + F.col("_v")).alias("_m"), *[F.when(F.col("_v") != i, F.col(b)).otherwise(0).alias(b) for i, b in enumerate(bins, 1)], "n", "positive")
    sums = each.groupBy("is_test", "_m", *bins).agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).coalesce(len(names)).persist()
    models = fit_counts(sums.filter(~F.col("is_test")).drop("is_test"), edges)
    test = sums.filter(F.col("is_test") & F.col("_m").isin(list(models)))
    found = {r["_m"]: r["roc_auc"] for r in metrics.score_counts(predict_counts(models, test, F.col("_m"), len(bins)), ["_m"]).collect()} if models else {}
    sums.unpersist()
    return [{name: found.get(s * len(names) + i) for i, name in enumerate(names)} for s in range(splits)]
