"""Running totals over a global order, without passing all rows through one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Have a folder for checkpoints: the one that the cluster names, and in a local session that
    names none a temporary one."""
    if spark.sparkContext.getCheckpointDir():
        return
    if named := spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(named)  # a session's setting doesn't reach the context by itself
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="vereda-"))


def running(df: DataFrame, order: list[str], value: Column | None = None, out: str = "_n") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (of ones, for a row number) over all rows up to
    this one in the order of ``order``, which should be unique.

    Rows are dealt to ranges of the order and summed there; a range starts with the sum of the
    ranges before it.  The ranges' sums are as many rows as there are partitions."""
    checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_v", F.lit(1).cast("long") if value is None else value)
    # the bounds of the ranges are sampled, so they are fixed before they are used twice
    rows = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = rows.groupBy("_range").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sums.select("_range", F.coalesce(before, F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, "_range").withColumn(out, F.col("_start") + F.sum("_v").over(inside)).drop("_v", "_range", "_start")
