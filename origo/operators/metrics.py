"""Ranking, calibration and decision metrics of scored rows.

Everything is first reduced to one row for each distinct score of a group, so
what is sorted is as large as the number of scores, not of rows. Totals over all
scores of a large pooled table use two levels: sums of ranges of scores, then
running sums within each range on top of the sums before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from origo.operators import selection


def check_probabilities(df: DataFrame, p_col: str) -> None:
    """Raise if a score lies outside of [0, 1]."""
    low, high, odd = df.agg(F.min(p_col), F.max(p_col), F.count_if(F.isnan(p_col) | F.col(p_col).isNull())).first()
    if odd or (low is not None and (low < 0 or high > 1)):
        raise ValueError("scores must lie in [0, 1]")


def _by_score(df: DataFrame, y_col: str, p_col: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(p_col).alias("_p")).agg(F.sum(F.col(y_col).cast("long")).alias("_tp"), F.count(F.lit(1)).alias("_n"))


def curve(df: DataFrame, y_col: str = "y", p_col: str = "p", by: list[str] | None = None) -> DataFrame:
    """For each distinct score: rows and positives of it (`n`, `tp`) and of all
    higher ones (`n_above`, `tp_above`). The points of a ROC or
    precision-recall curve."""
    return _curve(_by_score(df, y_col, p_col, by or []), by or [])


def _curve(scores: DataFrame, by: list[str]) -> DataFrame:
    # Ranges of about as many distinct scores each, wherever these bunch.
    scores = selection.ranged(scores, F.col("_p"), by)
    sums = selection.sums_before(scores, by, {"_bt": "_tp", "_bn": "_n"}, descending=True)
    inside = W.partitionBy(*by, "_r").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)
    joined = scores.join(F.broadcast(sums), [*by, "_r"])  # a row for each range
    return joined.select(
        *by, F.col("_p").alias("score"), F.col("_n").alias("n"), F.col("_tp").alias("tp"),
        (F.col("_bn") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("n_above"), (F.col("_bt") + F.coalesce(F.sum("_tp").over(inside), F.lit(0))).alias("tp_above"),
    )


def points(df: DataFrame, y_col: str = "y", p_col: str = "p", by: list[str] | None = None) -> DataFrame:
    """`threshold, fpr, tpr, precision` at each distinct score: the points of the
    ROC and the precision-recall curve; a rate of no rows is null."""
    by = by or []
    upto = curve(df, y_col, p_col, by).select(*by, F.col("score").alias("threshold"), "n", "tp", (F.col("n_above") + F.col("n")).alias("_n"), (F.col("tp_above") + F.col("tp")).alias("_tp"))
    totals = upto.groupBy(*by).agg(F.sum("n").alias("_all"), F.sum("tp").alias("_pos"))
    both = upto.join(F.broadcast(totals), by) if by else upto.join(F.broadcast(totals))  # a row for each group
    rate = lambda a, b: F.try_divide(a.cast("double"), b)
    return both.select(
        *by, "threshold", rate(F.col("_n") - F.col("_tp"), F.col("_all") - F.col("_pos")).alias("fpr"), rate(F.col("_tp"), F.col("_pos")).alias("tpr"),
        rate(F.col("_tp"), F.col("_n")).alias("precision"),
    )


def score(df: DataFrame, y_col: str = "y", p_col: str = "p", by: list[str] | None = None, *, checked: bool = False) -> DataFrame:
    """`n, prevalence, roc_auc, pr_auc, brier` of each group, or of all rows.

    ROC AUC counts ties as half; PR AUC is average precision. Both are null if
    only one class occurs. Scores outside of [0, 1] raise a ValueError, which is
    a pass of its own; `checked` leaves it out for scores that a model gives.
    """
    by = by or []
    if not checked:
        check_probabilities(df, p_col)
    error = df.groupBy(*by).agg(F.avg(F.pow(F.col(p_col) - F.col(y_col), 2)).alias("brier"))
    return _scored(curve(df, y_col, p_col, by), error, by)


def score_counts(counts: DataFrame, by: list[str] | None = None, *, p_col: str = "p", n_col: str = "n", positive_col: str = "positive") -> DataFrame:
    """As `score`, of rows that say how many rows have a score, and how many of
    these have label 1."""
    by = by or []
    scores = counts.groupBy(*by, F.col(p_col).alias("_p")).agg(F.sum(positive_col).alias("_tp"), F.sum(n_col).alias("_n"))
    wrong = F.col("_tp") * F.pow(1 - F.col("_p"), 2) + (F.col("_n") - F.col("_tp")) * F.pow("_p", 2)
    return _scored(_curve(scores, by), scores.groupBy(*by).agg((F.sum(wrong) / F.sum("_n")).alias("brier")), by)


def _scored(points: DataFrame, error: DataFrame, by: list[str]) -> DataFrame:
    fp, fp_above = F.col("n") - F.col("tp"), F.col("n_above") - F.col("tp_above")
    # A pair counts if the positive's score is higher, and half if equal.
    ranked = points.groupBy(*by).agg(
        F.sum("n").alias("_n"), F.sum("tp").alias("_pos"), F.sum(fp * (F.col("tp_above") + F.col("tp") / 2)).alias("_pairs"),
        F.sum(F.col("tp") * (F.col("tp_above") + F.col("tp")) / (F.col("n_above") + F.col("n"))).alias("_steps"), F.sum(fp_above * 0).alias("_zero"),
    )
    both = ranked.join(error, by) if by else ranked.join(F.broadcast(error))  # one row each without groups
    negatives = F.col("_n") - F.col("_pos")
    mixed = (F.col("_pos") > 0) & (negatives > 0)
    return both.select(
        *by, F.col("_n").alias("n"), (F.col("_pos") / F.col("_n")).alias("prevalence"), F.when(mixed, F.col("_pairs") / (F.col("_pos") * negatives)).alias("roc_auc"),
        F.when(mixed, F.col("_steps") / F.col("_pos")).alias("pr_auc"), "brier",
    )


def confusion(df: DataFrame, y_col: str = "y", p_col: str = "p", threshold: float = 0.5) -> DataFrame:
    """`actual, predicted, n`."""
    return df.groupBy(F.col(y_col).alias("actual"), (F.col(p_col) >= threshold).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _value(tp: Column, targeted: Column, offer_cost: float, saved_margin: float, save_rate: float) -> Column:
    return tp * F.lit(save_rate * saved_margin) - targeted * F.lit(offer_cost)


def sweep_expected_value(df: DataFrame, thresholds: list[float], *, offer_cost: float, saved_margin: float, save_rate: float, y_col: str = "y", p_col: str = "p", by: list[str] | None = None) -> DataFrame:
    """`threshold, n_targeted, expected_value` for each threshold, also those that
    target nobody. Rows are counted between thresholds, then summed from above."""
    if not 0 <= save_rate <= 1:
        raise ValueError("save_rate must lie in [0, 1]")
    by, cuts = by or [], sorted(set(thresholds))
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    counts = df.groupBy(*by, F.size(F.filter(edges, lambda c: c <= F.col(p_col))).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y_col).cast("long")).alias("_tp"))
    # A row with k thresholds at or below it is targeted by the first k of them.
    each = counts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1)))).withColumn("_in", F.col("_i") < F.col("_k"))
    sums = each.groupBy(*by, "_i").agg(F.sum(F.when(F.col("_in"), F.col("_n")).otherwise(0)).alias("n_targeted"), F.sum(F.when(F.col("_in"), F.col("_tp")).otherwise(0)).alias("_tp"))
    return sums.select(*by, F.get(edges, F.col("_i")).alias("threshold"), "n_targeted", _value(F.col("_tp"), F.col("n_targeted"), offer_cost, saved_margin, save_rate).alias("expected_value"))


def expected_value(df: DataFrame, threshold: float, **options) -> float:
    """Expected value of targeting scores at or above a threshold."""
    row = sweep_expected_value(df, [threshold], **options).first()
    return row["expected_value"] if row else 0.0


def peeked_optimum(df: DataFrame, thresholds: list[float], *, by: list[str] | None = None, **options) -> DataFrame:
    """The row of the sweep with the highest value in each group, of equal ones the
    lowest threshold: what choosing on the labels themselves would give, to compare
    the break-even threshold with."""
    by = by or []
    sweep = sweep_expected_value(df, thresholds, by=by, **options)
    best = sweep.groupBy(*by).agg(F.max(F.struct("expected_value", (-F.col("threshold")).alias("_t"), "threshold", "n_targeted")).alias("_best"))
    return best.select(*by, "_best.threshold", "_best.n_targeted", "_best.expected_value")


def mean_against_prevalence(df: DataFrame, y_col: str = "y", p_col: str = "p", by: list[str] | None = None) -> DataFrame:
    """`mean_predicted, prevalence, difference`: whether scores are right on average."""
    means = df.groupBy(*(by or [])).agg(F.avg(p_col).alias("mean_predicted"), F.avg(y_col).alias("prevalence"))
    return means.withColumn("difference", F.col("mean_predicted") - F.col("prevalence"))


def break_even_threshold(offer_cost: float, saved_margin: float, save_rate: float) -> float:
    """Where an offer pays for itself on average; never chosen on labels."""
    return offer_cost / (save_rate * saved_margin)


def budget_value(df: DataFrame, budgets: list[int], id_col: str, *, offer_cost: float, saved_margin: float, save_rate: float, y_col: str = "y", p_col: str = "p", by: list[str] | None = None) -> DataFrame:
    """`budget, n_targeted, churners, expected_value` of the k highest scores for
    each budget k; ties go to smaller ids. The score of the last row of the largest
    budget is selected from counts first, so only rows that reach it are sorted."""
    by = by or []
    top = selection.selected(df, p_col, by, {"_cut": lambda n: n - max(budgets)}).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_cut")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    near = df.join(F.broadcast(top), same or None, "left").filter(F.col("_cut").isNull() | (F.col(p_col) >= F.col("_cut"))).drop("_cut", *[f"_by{i}" for i in range(len(by))])  # a row for each group
    order = W.partitionBy(*by).orderBy(F.desc(p_col), id_col)
    ranked = near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max(budgets))
    sums = ranked.groupBy(*by).agg(*[f for k in budgets for f in (F.count_if(F.col("_rank") <= k).alias(f"n{k}"), F.sum(F.when(F.col("_rank") <= k, F.col(y_col)).otherwise(0)).alias(f"t{k}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("budget"), F.col(f"n{k}").alias("n_targeted"), F.col(f"t{k}").alias("churners")) for k in budgets])).alias("x")
    return sums.select(*by, rows).select(*by, "x.*").withColumn("expected_value", _value(F.col("churners"), F.col("n_targeted"), offer_cost, saved_margin, save_rate))
