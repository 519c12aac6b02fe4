"""Rows in id order, cut into ranges that tasks can stream, each with its successor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions


def _tree(bounds: list[int], key: Column, at: int = 0) -> Column:
    """The number of bounds below ``key``, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(at)
    mid = len(bounds) // 2
    return F.when(key <= F.lit(bounds[mid]), _tree(bounds[:mid], key, at)).otherwise(_tree(bounds[mid + 1 :], key, at + mid + 1))


def range_bounds(df: DataFrame, key: str = "doc_id", n: int | None = None) -> list[int]:
    """Approximate quantiles of the key: at most one bound per range, so the driver holds
    a number of values that is set by the cluster's partitions and not by the rows."""
    n = min(n or partitions(df.sparkSession), 4096)
    at = [i / n for i in range(1, n)]
    if not at:
        return []
    found = df.agg(F.percentile_approx(key, at, 100 * n).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(key: str | Column, bounds: list[int]) -> Column:
    """Null keys come first, in range 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNull(), 0).otherwise(_tree(bounds, key))


def with_heads(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt to ranges of ascending key and sorted there, with columns ``part`` and
    ``tail``.  The first rows of the next range (of the first, after the last) follow as
    ``tail`` rows, so that every row's successor is in its own partition."""
    spark = df.sparkSession
    bounds = range_bounds(df, key)
    df = df.withColumn("part", range_of(key, bounds))
    heads = df.groupBy("part").agg(F.min(key).alias("head"), F.max(F.col(key).isNull()).alias("void")).orderBy("part").collect()
    rows = [(None if r["void"] else r["head"], heads[i - 1]["part"]) for i, r in enumerate(heads)]
    # one row for each range: a bounded table
    target = F.broadcast(spark.createDataFrame(rows, "_head long, _to int"))
    tails = df.join(target, df[key].eqNullSafe(F.col("_head"))).withColumn("part", F.col("_to")).drop("_head", "_to")
    both = df.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))
    return both.repartitionById(max(1, len(bounds) + 1), F.col("part")).sortWithinPartitions("part", "tail", key, *[c for c in ("text",) if c in df.columns])
