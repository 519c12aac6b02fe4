"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of long ids → ``(node, component)``, the smallest id that the node
    reaches, for every node that is not its own component's smallest.

    Each round is two joins with a grouped minimum, which is combined before it is shuffled and
    written before it is joined: the join has two plain exchanges, so that the edges of a node
    with very many neighbours can be dealt to several tasks.  The number of rounds grows with
    the logarithm of the components' size.
    """
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: every neighbour larger than u goes to the smallest node around u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lows")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = settle(large, "edges")
        # small star: u and its smaller neighbours go to the smallest of them
        drop_settled(low)
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_settled(large)
        drop_settled(low)
        drop_settled(edges)
        edges, last = new, state
        state = _state(edges)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
