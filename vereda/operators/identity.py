"""One identity for rows that share any of several keys, and the row that stands for it.

Rows are the same if they share a key, or if a chain of rows does.  Rows and keys make a graph;
its components are found by joins, so no identity has to fit into a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import checkpoint_dir


def _changed(parents: DataFrame) -> int:
    return parents.agg(F.sum(F.xxhash64("node", "parent").cast("decimal(38,0)")).alias("h")).first()["h"] or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any ordered type → (node, component), the smallest node that is reached,
    for every node of an edge.

    Every node points to a parent, at first itself.  In a round each node takes the least parent
    around it, its parent takes the least that its children have seen, and all pointers are
    doubled, so the rounds grow with the logarithm of the longest chain.  Minima are combined
    before they are shuffled; a node with very many neighbours is one row of each task."""
    checkpoint_dir(edges.sparkSession)
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = both.filter("u is not null and v is not null and u <> v").distinct().checkpoint()
    parents = both.select(F.col("u").alias("node")).distinct().withColumn("parent", F.col("node")).checkpoint()
    state = _changed(parents)
    for _ in range(rounds):
        around = both.join(parents, F.col("v") == F.col("node")).groupBy("u").agg(F.min("parent").alias("least"))
        seen = parents.join(around, F.col("node") == F.col("u")).select("node", "parent", F.least("parent", "least").alias("least"))
        hooks = seen.groupBy(F.col("parent").alias("root")).agg(F.min("least").alias("hook"))
        seen = seen.select("node", "least").join(hooks, F.col("node") == F.col("root"), "left").select("node", F.least("least", "hook").alias("parent"))
        seen = seen.checkpoint()
        up = seen.select(F.col("node").alias("at"), F.col("parent").alias("next"))
        parents = seen.join(up, F.col("parent") == F.col("at")).select("node", F.col("next").alias("parent")).checkpoint()
        last, state = state, _changed(parents)
        if state == last:
            return parents.withColumnRenamed("parent", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def identities(rows: DataFrame, row: str, keys: Column) -> DataFrame:
    """(row, identity): the smallest row that shares one of the ``keys`` (an array), directly or
    over others.  Each key links its rows with the least of them, so a key that a third of all
    rows have costs as many links as it has rows.

    Defined cases: null keys link nothing; rows without a key stand for themselves; a null row
    is its own identity (null); repeated rows appear once."""
    own = rows.select(F.col(row).alias("row"), F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key")).filter("row is not null")
    checkpoint_dir(rows.sparkSession)
    own = own.checkpoint()
    lead = own.groupBy("key").agg(F.min("row").alias("lead"))
    links = own.join(lead, "key").filter("row <> lead").select(F.col("row").alias("u"), F.col("lead").alias("v"))
    found = components(links)
    every = rows.select(F.col(row).alias("row")).distinct()
    return every.join(found, F.col("row") == F.col("node"), "left").select(F.col("row").alias(row), F.coalesce("component", "row").alias("identity"))


def best_of_each(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``kept``: whether a row comes first of its group; ``order`` should be total.
    Found by a grouped minimum, so that a large group is not sorted."""
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_first"))
    mine = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return rows.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn("kept", mine == F.col("_first")).drop("_group", "_first")


def top_of_each(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their ``place``.  Spark cuts each task's rows to n of a
    group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
