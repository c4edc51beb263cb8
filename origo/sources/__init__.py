"""Reading and writing tables, results and caches."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from origo.operators import cleaning
from origo.sources.sheets import read_workbook


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header under a fixed schema; only `columns` are read."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*columns) if columns else rows


def read_sheets(spark: SparkSession, paths: list[str], schema: str, sheets: list[str] | None = None) -> DataFrame:
    """Several files of one table: workbooks, of which all sheets or the named ones
    are read, or CSV or Parquet files exported from sheets."""
    out = None
    for path in paths:
        kind = path.lower().rsplit(".", 1)[-1]
        part = read_workbook(spark, path, schema, sheets) if kind == "xlsx" else read_csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).parquet(path)
        out = part if out is None else out.unionByName(part)
    return out


def committed(spark: SparkSession, cache: str) -> str | None:
    """The folder of the cache's last whole table, or None. A table is whole once the
    file that names it is there; folders without one are what failed writers left."""
    p = spark._jvm.org.apache.hadoop.fs.Path(cache)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(p):
        return None
    marks = [x.getPath().getName() for x in store.listStatus(p) if x.getPath().getName().startswith("_mark-")]
    return f"{cache}/{max(marks).removeprefix('_mark-')}" if marks else None


def commit(df: DataFrame, cache: str) -> str:
    """Write `df` as the cache's next table: into a folder of its own, then, as the
    last step, its mark. Readers see the table before or this one, never a part.
    All older tables but the last before go; who reads that one can finish."""
    spark = df.sparkSession
    old = committed(spark, cache)
    number = int(old.rsplit("-", 1)[1]) + 1 if old else 0
    at = f"table-{number:09d}"
    df.write.mode("overwrite").parquet(f"{cache}/{at}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(cache).getFileSystem(spark._jsc.hadoopConfiguration())
    store.create(path(f"{cache}/_mark-{at}"), False).close()  # fails if another writer was first
    for entry in store.listStatus(path(cache)):
        name = entry.getPath().getName()
        if name.removeprefix("_mark-").startswith("table-") and int(name.rsplit("-", 1)[1]) < number - 1:
            store.delete(entry.getPath(), True)
    return f"{cache}/{at}"


def read_through(spark: SparkSession, cache: str, raw: str, clean: Callable[[], DataFrame], *, force_reload: bool = False) -> DataFrame:
    """The cached table; where no whole one is, the raw one is cleaned into it. With
    `force_reload` it is cleaned anew; readers keep the old table until then."""
    at = None if force_reload else committed(spark, cache)
    if at is None:
        if not exists(spark, raw):
            raise FileNotFoundError(raw)
        at = commit(clean(), cache)
    return spark.read.parquet(at)


def load_retail(spark: SparkSession, raw: str, cache: str, *, force_reload: bool = False) -> DataFrame:
    """Cleaned rows of a workbook's sheets, or of one CSV or Parquet file."""
    return read_through(spark, cache, raw, lambda: cleaning.clean_retail(read_sheets(spark, [raw], cleaning.RETAIL_RAW)), force_reload=force_reload)


def load_subscriptions(spark: SparkSession, raw: str, cache: str, *, force_reload: bool = False) -> DataFrame:
    return read_through(spark, cache, raw, lambda: cleaning.clean_subscriptions(read_csv(spark, raw, cleaning.SUBSCRIPTION_RAW)), force_reload=force_reload)


def read_official_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "msno string, is_churn int").withColumnRenamed("msno", "customer_id")


def write_result(row: dict, path: str) -> None:
    """One object, to a file of the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(row, indent=2, default=str))


def write_indexed(df: DataFrame, index: str, path: str) -> None:
    """A small table as an object of objects by its index."""
    write_result({str(r[index]): {k: v for k, v in r.asDict().items() if k != index} for r in df.collect()}, path)


def read_result(path: str) -> dict:
    return json.loads(Path(path).read_text())


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def headline_numbers(naive: dict, honest: dict) -> dict:
    """How much worse honest numbers are; a missing one raises."""
    return {"auc_gap": naive["roc_auc"] - honest["roc_auc"], "brier_worse": honest["brier"] / naive["brier"] - 1}


RESULTS = ("naive", "no_gap", "honest", "calibration")


def load_headline(folder: str) -> dict:
    """The headline of the four result files of a folder, `<name>.json` each. A
    missing file raises FileNotFoundError with its name, a missing number KeyError."""
    lost = [n for n in RESULTS if not (Path(folder) / f"{n}.json").exists()]
    if lost:
        raise FileNotFoundError(f"no results of {', '.join(lost)} in {folder}")
    found = {n: read_result(str(Path(folder) / f"{n}.json")) for n in RESULTS}
    arms = {n: {k: found[n][k] for k in ("roc_auc", "pr_auc", "brier")} for n in RESULTS[:3]}
    gaps = {f"{n}_{k}": v for n in RESULTS[:2] for k, v in headline_numbers(found[n], found["honest"]).items()}
    return {"arms": arms, **gaps, "calibration": found["calibration"]}


def sql_view(df: DataFrame, name: str, sql: str) -> DataFrame:
    """What a query says of `df`, which it reads under a name. The name is taken only
    while the query is analysed: a view of the caller's by that name stays."""
    spark = df.sparkSession
    own = spark.table(name) if any(x.name == name and x.isTemporary for x in spark.catalog.listTables()) else None
    df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        if own is None:
            spark.catalog.dropTempView(name)
        else:
            own.createOrReplaceTempView(name)


def sql_scalar(df: DataFrame, name: str, sql: str):
    """The one value of a query; more or fewer rows or columns raise."""
    rows = sql_view(df, name, sql).limit(2).collect()
    if len(rows) != 1 or len(rows[0]) != 1:
        raise ValueError("the query must give one value")
    return rows[0][0]


def members_quality(members: DataFrame) -> DataFrame:
    """One row: shares of ages outside of 1 to 100 and of missing genders."""
    odd = ~F.coalesce(F.col("bd").between(1, 100), F.lit(False))
    return members.agg(F.avg(odd.cast("int")).alias("odd_age"), F.avg(F.col("gender").isNull().cast("int")).alias("no_gender"))
