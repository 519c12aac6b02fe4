"""Several short lists of extremes from one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import top_of_each


@dataclass(frozen=True)
class TopList:
    """Rows for which ``score`` is known (and ``where`` holds), largest first or ``least`` first."""

    name: str
    score: Column
    least: bool = False
    where: Column | None = None
    most: int = 5


def top_lists(rows: DataFrame, key: str, lists: list[TopList], within: list[str] | None = None) -> DataFrame:
    """(…within, list, place, key, score): the first rows of every list, ties to the smaller key.

    A row emits a short record for each list that it may stand in.  Each task keeps the longest
    list's length of a list's records before the shuffle, so the input is scanned once and what
    is shuffled doesn't grow with it.

    Defined cases: null and NaN scores and null keys stand in no list."""
    within = within or []
    entries = []
    for x in lists:
        score = x.score.cast("double")
        good = score.isNotNull() & ~F.isnan(score) & (F.lit(True) if x.where is None else F.coalesce(x.where, F.lit(False)))
        entries.append(F.when(good, F.struct(F.lit(x.name).alias("list"), score.alias("score"), (score if x.least else -score).alias("order"), F.lit(x.most).alias("most"))))
    each = rows.filter(F.col(key).isNotNull()).select(*within, key, F.inline(F.array_compact(F.array(*entries))))
    top = top_of_each(each, [*within, "list"], [F.col("order"), F.col(key)], max(x.most for x in lists))
    return top.filter(F.col("place") <= F.col("most")).select(*within, "list", "place", key, "score")
