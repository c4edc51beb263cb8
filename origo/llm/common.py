"""What the operators of this subpackage share: tables, checkpoints, names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from origo.functions import ship as ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed and written to the folder that the session names in
    `spark.checkpoint.dir`, so that a lost executor costs no recomputation.

    Where the session names none, a temporary folder is used in local mode only;
    elsewhere the executors share no such folder, and that is an error.
    """
    sc = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="origo-checkpoint-"))
    held = df.checkpoint()
    given_back(df.sparkSession)
    return held


def given_back(spark: SparkSession, share: float = 0.5) -> bool:
    """Have the driver forget the plans that nothing holds any more, if its heap has
    grown over a share of its limit; whether it had. Plans of many steps are garbage
    as soon as their result is checkpointed, but the heap would grow to its limit
    before it is collected, and only a whole collection makes it shrink again."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= share * runtime.maxMemory():
        return False
    spark._jvm.System.gc()
    return True


def released(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing will read again (a frame that
    is no checkpoint is left alone), and have the driver forget what led to it:
    Spark removes the shuffle files of plans that its driver no longer holds."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    df.sparkSession._jvm.System.gc()


def redealt(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, dealt out by a hash of the columns that a join will need. A join of a
    table grouped by its key would otherwise keep that grouping, and Spark could
    not split a partition of the other side that one key makes large."""
    return df.repartition(F.xxhash64(*columns))


def parts_for(amount: int, per_part: int) -> int:
    """How many parts of `per_part` hold `amount`; 1 at least."""
    return max(1, -(-int(amount) // int(per_part)))
