"""Scored search over typed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def union_index(*projections: DataFrame) -> DataFrame:
    """(kind, id, title, body) of several sources."""
    out = projections[0]
    for p in projections[1:]:
        out = out.unionByName(p)
    return out


def top(index: DataFrame, query: str, k: int = 8, body: str = "body", tie: str = "id") -> DataFrame:
    """The k best rows for a query (k within 1..20), ties in the order of ``tie``."""
    scored = index.withColumn("score", text.containment_score(F.col(body), query)).filter("score > 0")
    return scored.orderBy(F.desc("score"), tie).limit(max(1, min(20, k)))


def top_of_each(rows: DataFrame, queries: list[str], body: str, key: str, k: int = 8) -> DataFrame:
    """(q, key, score): the k best rows for each of several queries, in one scan; ties by key."""
    scores = F.array(*[F.struct(F.lit(i).alias("q"), text.containment_score(F.col(body), q).alias("score")) for i, q in enumerate(queries)])
    found = rows.select(key, F.inline(scores)).filter("score > 0")
    best = Window.partitionBy("q").orderBy(F.desc("score"), key)
    return found.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= max(1, min(20, k))).select("q", key, "score")
