"""Rolling order statistics: the place of a value among its last n, and quantiles of them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from math import floor

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a series that one step of a task works on.
STRETCH = 4096


def _walk(values: list[float | None], n: int, quantiles: list[float], skip: int) -> tuple[list, list[list]]:
    """For every value but the first ``skip``: its rank, and the quantiles, of the n values up to it;
    null until the window is full of known values.  The window is kept sorted: a value that
    comes is put in and one that goes is taken out by bisection, nothing is sorted again."""
    ranks: list[float | None] = []
    found: list[list[float | None]] = [[] for _ in quantiles]
    held: list[float] = []
    for i, x in enumerate(values):
        if x is not None:
            insort(held, x)
        if i >= n and values[i - n] is not None:
            held.pop(bisect_left(held, values[i - n]))
        if i < skip:
            continue
        full = len(held) == n
        ranks.append(bisect_right(held, x) / n if full else None)
        for q, out in zip(quantiles, found, strict=True):
            at = q * (n - 1)
            low = floor(at)
            out.append(held[low] + (at - low) * (held[min(low + 1, n - 1)] - held[low]) if full else None)
    return ranks, found


def rolling_order(df: DataFrame, value: str, n: int, quantiles: dict[str, float], by: str = "symbol", at: str = "ts") -> DataFrame:
    """``df`` with ``rank``, the share of the last n values that are not larger than this one, and
    the named quantiles of them (linear between neighbours).

    A series is cut into stretches of ``STRETCH`` rows, each with the n - 1 rows before it, so that
    a long one is dealt to many tasks; a step costs a search in the window and not a sort.

    Defined cases: windows with a null or NaN value, and the first n - 1 rows, give nulls; equal
    times come in the order of the value; columns named like the new ones are replaced."""
    names = ["rank", *quantiles]
    rows = df.drop(*names)
    keep = rows.columns
    w = Window.partitionBy(by).orderBy(at, value)
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = rows.select(F.struct(*keep).alias("row"), F.col(by).alias("by"), known.alias("x"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    own, ahead = F.floor(F.col("i") / STRETCH), F.floor((F.col("i") + n - 1) / STRETCH)
    rows = rows.withColumn("stretch", F.explode(F.sequence(own, ahead)))
    # a row that a stretch has only for its windows needs no columns
    rows = rows.withColumn("lead", F.col("stretch") > own).withColumn("row", F.when(~F.col("lead"), F.col("row")))
    made = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(c, T.DoubleType()) for c in names)])

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        skip = pa.compute.sum(t.column("lead").cast(pa.int64())).as_py()
        ranks, found = _walk(t.column("x").to_pylist(), n, list(quantiles.values()), skip)
        columns = [t.column("row").combine_chunks().slice(skip), pa.array(ranks, pa.float64()), *(pa.array(x, pa.float64()) for x in found)]
        return pa.Table.from_arrays(columns, names=["row", *names])

    out = rows.groupBy("by", "stretch").applyInArrow(work, made)
    return out.select("row.*", *names)
