"""Backtests over rolling origins with a purge of labels that aren't final yet."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from origo.operators import hazard, metrics
from origo.operators.model import NONE, SEED, Model, _number, bin_names, bin_of_each, bin_of_value, binned, binned_by, cells, cut_points, fit, fit_counts, fit_counts_each, fit_windows, predict, predict_window_counts, predict_windows, window_cut_points
from origo.operators.windows import Window, origins_frame


def mature_origins(windows: list[Window], test: Window, *, purge: bool = True, max_lookback_days: int | None = None) -> list[Window]:
    """Earlier origins whose labels are final at the test origin, and that lie in
    its lookback if there is one."""
    def usable(w: Window) -> bool:
        final = w.label_end <= test.as_of if purge else True
        near = max_lookback_days is None or (test.as_of - w.as_of).days <= max_lookback_days
        return w.as_of < test.as_of and final and near

    return [w for w in sorted(windows, key=lambda w: w.as_of) if usable(w)]


def origin_plan(origins: DataFrame, *, min_training_origins: int = 1, purge: bool = True, max_lookback_days: int | None = None) -> DataFrame:
    """`test_as_of, n_train, first_train, last_train`: the same plan as a relation,
    from a frame of origins."""
    a = origins.select(F.col("idx").alias("i"), F.col("as_of").alias("train"), "label_end")
    b = origins.select(F.col("idx").alias("j"), F.col("as_of").alias("test_as_of"))
    on = (F.col("i") < F.col("j")) & (F.col("j") >= min_training_origins)
    if purge:
        on &= F.col("label_end") <= F.col("test_as_of")
    if max_lookback_days is not None:
        on &= F.col("train") >= F.timestamp_add("DAY", F.lit(-max_lookback_days), F.col("test_as_of"))
    pairs = b.join(F.broadcast(a), on)  # origins are few: a row for each occasion
    return pairs.groupBy("test_as_of").agg(F.count(F.lit(1)).alias("n_train"), F.min("train").alias("first_train"), F.max("train").alias("last_train"))


def _at(panel: DataFrame, windows: list[Window]) -> DataFrame:
    return panel.filter(F.col("as_of").isin([F.lit(w.as_of).cast("timestamp_ntz") for w in windows]))


def training_plan(windows: list[Window], *, min_training_origins: int = 1, purge: bool = True, max_lookback_days: int | None = None) -> dict[datetime, list[datetime]]:
    """For each origin that can be tested, the mature origins that train its model."""
    ordered = sorted(windows, key=lambda w: w.as_of)
    mature = {w.as_of: [x.as_of for x in mature_origins(ordered, w, purge=purge, max_lookback_days=max_lookback_days)] for w in ordered[min_training_origins:]}
    return {target: train for target, train in mature.items() if train}


def _edges(panel: DataFrame, windows: list[Window], feature_cols: list[str]) -> tuple:
    """Cut points of the first origin's rows, which lie in every model's past."""
    return cut_points(_at(panel, [min(windows, key=lambda w: w.as_of)]), feature_cols)


KEPT = 16  # partitions of kept counts, as cells are few whatever the rows


@dataclass(frozen=True)
class Counted:
    """A panel as counts of cells of its origins, and the cut points of these. Fits
    and metrics of a backtest read nothing else, so the panel is passed over once."""

    edges: tuple[tuple[float, ...], ...]
    counts: DataFrame


def counted(panel: DataFrame, windows: list[Window], feature_cols: list[str], y_col: str = "churned") -> Counted:
    """The counts of a panel, kept for several backtests of it."""
    edges = _edges(panel, windows, feature_cols)
    return Counted(edges, cells(panel, feature_cols, y_col, edges, ["as_of"]).coalesce(KEPT).persist())


def rolling_counts(held: Counted, windows: list[Window], feature_cols: list[str], *, min_training_origins: int = 1, max_lookback_days: int | None = None, purge: bool = True, **model) -> tuple[dict[datetime, Model], DataFrame]:
    """The models of a rolling backtest, and the counts of the origins that they
    score, with `p`."""
    plan = training_plan(windows, min_training_origins=min_training_origins, purge=purge, max_lookback_days=max_lookback_days)
    models = fit_windows(held.counts, plan, feature_cols, edges=held.edges, counts=held.counts, **model)
    return models, predict_window_counts(models, held.counts, len(feature_cols))


def rolling_origin_backtest(panel: DataFrame, windows: list[Window], feature_cols: list[str], *, min_training_origins: int = 1, seed: int = SEED, max_lookback_days: int | None = None, purge: bool = True, held: Counted | None = None, **model) -> tuple[DataFrame, DataFrame]:
    """`(per_origin, predictions)`: each origin from the given number on, scored
    by a model of its mature origins; those without any are skipped. All models are
    fitted and scored in one pass over the panel, or on the counts `held` of it."""
    held = held or counted(panel, windows, feature_cols)
    models, scored = rolling_counts(held, windows, feature_cols, min_training_origins=min_training_origins, purge=purge, max_lookback_days=max_lookback_days, **model)
    return metrics.score_counts(scored, ["as_of"]), predict_windows(models, panel, feature_cols)


def fit_at_origin(panel: DataFrame, windows: list[Window], target: int, feature_cols: list[str], *, seed: int = SEED, **model) -> tuple[Model, list[Window]]:
    """The model that the backtest fits for one origin, and its mature origins."""
    ordered = sorted(windows, key=lambda w: w.as_of)
    mature = mature_origins(ordered, ordered[target])
    if not mature:
        raise ValueError("no origin is mature")
    return fit(_at(panel, mature), feature_cols, edges=_edges(panel, ordered, feature_cols), **model), mature


def frozen_model_backtest(panel: DataFrame, windows: list[Window], feature_cols: list[str], *, min_training_origins: int = 1, seed: int = SEED, held: Counted | None = None, **model) -> tuple[DataFrame, DataFrame]:
    """Fit once, at the first origin that can be tested, and score it and all
    later ones; `origins_since_training` counts from 0."""
    ordered = sorted(windows, key=lambda w: w.as_of)
    first = next((i for i, w in enumerate(ordered) if i >= min_training_origins and mature_origins(ordered, w)), None)
    if first is None:
        raise ValueError("no origin is ever mature")
    held = held or counted(panel, windows, feature_cols)
    at = ordered[first].as_of
    fitted = fit_windows(held.counts, {at: [w.as_of for w in mature_origins(ordered, ordered[first])]}, feature_cols, edges=held.edges, counts=held.counts, **model)
    same = {w.as_of: fitted.get(at, Model(held.edges, NONE)) for w in ordered[first:]}
    scored = predict_window_counts(same, held.counts, len(feature_cols))
    predictions = predict(same[at], _at(panel, ordered[first:]), feature_cols)
    ages = F.broadcast(origins_frame(panel.sparkSession, ordered).select("as_of", (F.col("idx") - first).alias("origins_since_training")))  # a row for each origin
    return metrics.score_counts(scored, ["as_of"]).join(ages, "as_of"), predictions


def hazard_curve(model: Model, rows: DataFrame, feature_cols: list[str], periods: int) -> DataFrame:
    """Every row in every period with its hazard."""
    return predict(model, hazard.expand_periods(rows, periods), [*feature_cols, "period"], "hazard")


def predict_survival(model: Model, rows: DataFrame, feature_cols: list[str], periods: int, *, key: str = "customer_id") -> DataFrame:
    """`as_of, customer_id, survival`: the chance of no event in any period, which
    is the chance to churn."""
    return hazard.survival(hazard_curve(model, rows, feature_cols, periods), key=key)


def holdout_after(panel: DataFrame, windows: list[Window], *, purge: bool = True) -> tuple[DataFrame, DataFrame]:
    """`(train, test)`: the last origin, and the earlier ones whose labels are final
    there; without the purge all earlier ones, whose labels look forward past it."""
    ordered = sorted(windows, key=lambda w: w.as_of)
    return _at(panel, mature_origins(ordered, ordered[-1], purge=purge)), _at(panel, ordered[-1:])


def fit_hazard_at_origin(panel: DataFrame, tx: DataFrame, windows: list[Window], target: int, feature_cols: list[str], *, time_col: str, key: str = "customer_id", period_days: int = hazard.PERIOD_DAYS, seed: int = SEED, **model) -> tuple[Model, list[Window]]:
    """The hazard model that the backtest fits for one origin, and its mature
    origins. All of these have a part in its cut points."""
    ordered = sorted(windows, key=lambda w: w.as_of)
    mature = mature_origins(ordered, ordered[target])
    if not mature:
        raise ValueError("no origin is mature")
    at = ordered[target].as_of
    edges = _hazard_edges(panel, tx, mature, {at: [w.as_of for w in mature]}, feature_cols, time_col, key, period_days)[at]
    counts = _event_cells(panel, tx, mature, feature_cols, edges, [], time_col, key, period_days)
    told = _period_cells(counts, [], edges, hazard.n_periods(mature, period_days)).withColumn("_m", F.lit(0))
    return fit_counts(told, edges, **model).get(0, Model(edges, NONE)), mature


def _hazard_edges(panel: DataFrame, tx: DataFrame, windows: list[Window], plan: dict[datetime, list[datetime]], feature_cols: list[str], time_col: str, key: str, period_days: int) -> dict[datetime, tuple]:
    """Cut points of the person-periods of all origins that each model is fitted on.
    No row is repeated for its periods: it counts as often as it has any."""
    rows = hazard.with_events(tx, windows, _at(panel, windows), time_col=time_col, key=key, period_days=period_days)
    last = F.lit(hazard.n_periods(windows, period_days))
    told = rows.select("as_of", F.coalesce("_event", last).alias("n"), *[_number(F.col(c)).alias(f"{i}") for i, c in enumerate(feature_cols)])
    values = told.unpivot(["as_of", "n"], [f"{i}" for i in range(len(feature_cols))], "f", "v").select("as_of", F.col("f").cast("int").alias("f"), "v", F.col("n").cast("long").alias("n"))
    each = told.groupBy("as_of", F.col("n").alias("periods")).agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.explode(F.sequence(F.lit(1), "periods")))
    periods = each.select("as_of", F.lit(len(feature_cols)).alias("f"), F.col("v").cast("double").alias("v"), "n")
    return window_cut_points(values.unionByName(periods), plan, len(feature_cols) + 1)


def _event_cells(panel: DataFrame, tx: DataFrame, windows: list[Window], feature_cols: list[str], edges: tuple, by: list[str], time_col: str, key: str, period_days: int) -> DataFrame:
    """`by, _b0..., _event, n`: the counts of a panel's cells, by the period of the
    event. No row is repeated for its periods: cells are, as they are few."""
    rows = hazard.with_events(tx, windows, _at(panel, windows), time_col=time_col, key=key, period_days=period_days)
    told = rows.select(*by, *binned(edges[:-1], feature_cols), "_event")
    return told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n"))


def _period_cells(counts: DataFrame, by: list[str], edges: tuple, periods: int, bins: Column | None = None) -> DataFrame:
    """The counts of cells of person-periods, with the period as the last bin; `bins`
    are those of `period`, if not by the cut points `edges`."""
    names = bin_names(len(edges))
    each = counts.withColumn("period", F.explode(F.sequence(F.lit(1), F.coalesce("_event", F.lit(periods)))))
    each = each.withColumn(names[-1], bin_of_value(F.col("period"), edges[-1]) if bins is None else bins)
    ended = F.when(F.col("period") == F.col("_event"), F.col("n")).otherwise(0)
    return each.groupBy(*by, *names).agg(F.sum("n").alias("n"), F.sum(ended).alias("positive"))


def _cells_of_models(panel: DataFrame, tx: DataFrame, windows: list[Window], plan: dict[datetime, list[datetime]], feature_cols: list[str], edges: list[tuple], time_col: str, key: str, period_days: int) -> DataFrame:
    """`_m, as_of, churned, _event, _b0..., n`: the counts of cells, by each model's own
    cut points, of the rows that it is fitted on (`as_of` and `churned` are null) and of
    those that it scores."""
    uses = [(m, origin, fits) for m, t in enumerate(sorted(plan)) for fits, origins in ((True, plan[t]), (False, [t])) for origin in origins]
    uses = F.broadcast(panel.sparkSession.createDataFrame(uses, "_m int, as_of timestamp_ntz, _fits boolean"))  # a row for each pair of occasions
    rows = hazard.with_events(tx, windows, _at(panel, windows), time_col=time_col, key=key, period_days=period_days).join(uses, "as_of")
    scored = [F.when(~F.col("_fits"), F.col(c)).alias(c) for c in ("as_of", "churned")]
    told = rows.select("_m", *scored, "_event", *binned_by(F.col("_m"), edges, feature_cols))
    return told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n"))


def hazard_rolling_origin_backtest(panel: DataFrame, tx: DataFrame, windows: list[Window], feature_cols: list[str], *, time_col: str, key: str = "customer_id", period_days: int = hazard.PERIOD_DAYS, min_training_origins: int = 1, seed: int = SEED, **model) -> tuple[DataFrame, DataFrame]:
    """As `rolling_origin_backtest`, by hazards of person-periods; survival is
    scored against `churned`."""
    periods, columns = hazard.n_periods(windows, period_days), [*feature_cols, "period"]
    plan = training_plan(windows, min_training_origins=min_training_origins)
    models, edges, counts, targets = {}, [], None, sorted(plan)
    if plan:
        found = _hazard_edges(panel, tx, windows, plan, feature_cols, time_col, key, period_days)
        edges = [found[t] for t in targets]
        period_bin = bin_of_each(F.col("_m"), F.col("period"), [e[-1] for e in edges])
        counts = _cells_of_models(panel, tx, windows, plan, feature_cols, edges, time_col, key, period_days).coalesce(KEPT).persist()
        told = _period_cells(counts.filter("as_of is null"), ["_m"], edges[0], periods, period_bin)
        models = {targets[m]: fitted for m, fitted in fit_counts_each(told, edges, **model).items()}
    hazards = predict_windows(models, hazard.expand_periods(panel, periods), columns, "hazard")
    predictions = panel.join(hazard.survival(hazards, key=key), ["as_of", key]).withColumnRenamed("survival", "p")
    if not models:
        return metrics.score(predictions, "churned", "p", ["as_of"], checked=True), predictions
    # Rows of one cell survive alike, so a cell is told of each period, not a row.
    names = bin_names(len(columns))
    whole = counts.filter("as_of is not null").groupBy("_m", "as_of", *names[:-1]).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("churned").cast("long")).alias("positive"))
    each = hazard.expand_periods(whole, periods).withColumn(names[-1], period_bin)
    told = predict_window_counts(models, each, len(columns), "hazard").groupBy("as_of", *names[:-1], "n", "positive").agg(F.product(1 - F.col("hazard")).alias("p"))
    return metrics.score_counts(told, ["as_of"]), predictions
