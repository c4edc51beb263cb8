"""Ranks, order statistics and running sums over very many rows.

Rows are cut into ranges of the order by splitters; what lies before a range is the
sum of the ranges before it, and only inside a range is anything sorted. Splitters
are quantiles of a sketch or of a sample: they decide how even the ranges are, never
what comes out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SIDE = 16  # splitters are looked up in two steps of so many
RANGES = SIDE * SIDE
SAMPLE = 16 * RANGES


def _steps(splitters: Column) -> Column:
    """Every SIDE-th splitter, for the first step."""
    return F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda i: F.element_at(splitters, i * SIDE))


def _range_of(steps: Column, splitters: Column, value: Column) -> Column:
    """How many of RANGES - 1 sorted splitters lie below a value."""
    step = F.size(F.filter(steps, lambda c: c < value))
    return (step * SIDE + F.size(F.filter(F.slice(splitters, step * SIDE + 1, F.lit(SIDE)), lambda c: c < value))).cast("int")


def _joined(df: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """`df` with the row of its group; groups are few."""
    return df.join(F.broadcast(few), by) if by else df.join(F.broadcast(few))


def ranged(df: DataFrame, value: Column, by: list[str], name: str = "_r") -> DataFrame:
    """`df` with the range of its group that a number falls into. Equal values share
    a range, so reduce rows to distinct values first where one may be frequent."""
    at = F.expr(f"array({', '.join(f'{i / RANGES}D' for i in range(1, RANGES))})")
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, at, RANGES * 8).alias("_cuts")).withColumn("_steps", _steps(F.col("_cuts")))
    return _joined(df, cuts, by).withColumn(name, _range_of(F.col("_steps"), F.col("_cuts"), value)).drop("_cuts", "_steps")


def _running(df: DataFrame, by: list[str], sums: dict[str, str], name: str, descending: bool) -> DataFrame:
    """`by, _all`: one row for a group, an array of its ranges in order with the sums
    over those before each (`<out>`), and over it alone (`own_<out>`)."""
    each = df.groupBy(*by, name).agg(*[F.sum(c).alias(out) for out, c in sums.items()])
    kind = {out: each.schema[out].dataType.simpleString() for out in sums}
    entry = "array<struct<" + ",".join([f"{name}:int", *[f"{o}:{kind[o]}" for o in sums], *[f"own_{o}:{kind[o]}" for o in sums]]) + ">>"
    ordered = F.sort_array(F.collect_list(F.struct(name, *sums)), asc=not descending)
    start = F.struct(*[F.lit(0).cast(kind[o]).alias(o) for o in sums], F.array().cast(entry).alias("seen"))

    def add(held: Column, x: Column) -> Column:
        told = F.struct(x[name].cast("int").alias(name), *[held[o].alias(o) for o in sums], *[x[o].alias(f"own_{o}") for o in sums])
        return F.struct(*[(held[o] + x[o]).cast(kind[o]).alias(o) for o in sums], F.concat(held["seen"], F.array(told)).cast(entry).alias("seen"))

    return each.groupBy(*by).agg(ordered.alias("_o")).select(*by, F.aggregate("_o", start, add)["seen"].alias("_all"))


def sums_before(df: DataFrame, by: list[str], sums: dict[str, str], name: str = "_r", *, descending: bool = False) -> DataFrame:
    """`by, <name>, <sum>...`: for each range the sums of columns over the ranges of
    its group before it."""
    return _running(df, by, sums, name, descending).select(*by, F.explode("_all").alias("_x")).select(*by, f"_x.{name}", *[f"_x.{o}" for o in sums])


def selected(df: DataFrame, value_col: str, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """`by, n, <name>...`: for each group how many values it has, and for each name
    the value at a rank from 0, which is a function of that number. A rank that no
    value has gives null; null values don't count. Groups must be few: a row of
    splitters for each is broadcast."""
    counts = df.filter(F.col(value_col).isNotNull()).groupBy(*by, F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = ranged(counts, F.col("_v"), by)
    # One row for a group: its ranges, its number of values, and the range that each
    # wanted rank lies in. Only these ranges are looked at again.
    groups = _running(counts, by, {"before": "_n"}, "_r", False).select(*by, "_all", F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x["own_before"]).alias("n"))
    names = list(ranks)
    asked = F.array(*[F.floor(f(F.col("n"))).cast("long") for f in ranks.values()])
    groups = groups.select(*by, "n", "_all", F.transform(asked, lambda rank, i: F.struct(i.alias("i"), rank.alias("rank"))).alias("_w"))
    spans = groups.select(*by, F.explode("_w").alias("_w"), "_all").select(*by, "_w.i", "_w.rank", F.get(F.filter("_all", lambda x: (x["before"] <= F.col("_w.rank")) & (F.col("_w.rank") < x["before"] + x["own_before"])), F.lit(0)).alias("_x"))
    spans = spans.filter("_x is not null").select(*by, "i", "rank", F.col("_x._r").alias("_r"), F.col("_x.before").alias("_before"))
    near = counts.join(F.broadcast(spans), [*by, "_r"])  # a row for each group and rank
    order = W.partitionBy(*by, "_r", "i").orderBy("_v")
    upto = F.col("_before") + F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0))
    found = near.withColumn("_upto", upto).filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "_v"))).alias("_values"))
    told = groups.select(*by, "n")
    told = told.join(F.broadcast(values), by, "left") if by else told.join(F.broadcast(values), how="left")  # a row for each group
    return told.select(*by, "n", *[F.try_element_at("_values", F.lit(i)).alias(name) for i, name in enumerate(names)])


def quantiles(df: DataFrame, value_col: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """`by, n, <name>...`: exact quantiles of each group, between two values by linear
    interpolation; no task sorts more than a range of the values."""
    by, ranks = by or [], {}
    for name, q in shares.items():
        ranks[f"_{name}_low"] = lambda n, q=q: (n - 1) * F.lit(float(q))
        ranks[f"_{name}_high"] = lambda n, q=q: F.ceil((n - 1) * F.lit(float(q)))
    found = selected(df.withColumn(value_col, F.col(value_col).cast("double")), value_col, by, ranks)
    out = []
    for name, q in shares.items():
        low, high, at = F.col(f"_{name}_low"), F.col(f"_{name}_high"), (F.col("n") - 1) * F.lit(float(q))
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*by, "n", *out)


def medians(df: DataFrame, value_col: str, by: list[str] | None = None, name: str = "median") -> DataFrame:
    """`by, n, <name>`: the exact median of each group."""
    return quantiles(df, value_col, {name: 0.5}, by)


def ranked(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """`df` with `name`: the place of each row, from 1, in the order of all rows by
    keys, ascending. The keys together must be different for every row, or equal
    rows get places in no certain order, but still gapless.

    Splitters are of a sample: the SAMPLE rows with the smallest hashes of their keys.
    """
    rows = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    sample = rows.select("_key").orderBy(F.xxhash64("_key")).limit(SAMPLE).agg(F.sort_array(F.collect_list("_key")).alias("_s"))
    # Of fewer rows than RANGES some splitters are equal, and some ranges empty.
    places = F.sequence(F.lit(1), F.lit(RANGES - 1))
    cuts = sample.select(F.when(F.size("_s") > 0, F.transform(places, lambda i: F.element_at("_s", (i * F.size("_s") / RANGES).cast("int") + 1))).alias("_cuts")).withColumn("_steps", _steps(F.col("_cuts")))
    cut = rows.join(F.broadcast(cuts)).withColumn("_r", _range_of(F.col("_steps"), F.col("_cuts"), F.col("_key"))).drop("_cuts", "_steps")  # one row
    base = sums_before(cut.select("_r", F.lit(1).cast("long").alias("_one")), [], {"_before": "_one"})
    place = F.row_number().over(W.partitionBy("_r").orderBy("_key"))
    return cut.join(F.broadcast(base), "_r").withColumn(name, F.col("_before") + place).drop("_r", "_key", "_before")  # RANGES rows at most
