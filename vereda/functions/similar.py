"""Likeness of two texts by their matching blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Start in a, start in b and length of the longest common stretch; the first of equals.
    Row by row the length of the common stretch that ends at each place of b."""
    best = (0, 0, 0)
    run = np.zeros(len(b) + 1, np.int64)
    for i, c in enumerate(a):
        run[1:] = np.where(b == c, run[:-1] + 1, 0)
        j = int(run.argmax())
        if run[j] > best[2]:
            n = int(run[j])
            best = (i + 1 - n, j - n, n)
    return best


def matching(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common stretch, and the same again on either
    side of it."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    total, todo = 0, [(x, y)]
    while todo:
        x, y = todo.pop()
        if len(x) and len(y):
            i, j, n = _longest(x, y)
            if n:
                total += n
                todo += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return total


def likeness(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters; 1 for two empty texts; null if one is
    null.  Its steps grow with the product of the lengths, so it is for titles and lines."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = zip(x, y, strict=True)
        return pd.Series([None if p is None or q is None else 1.0 if p == q else 2.0 * matching(p, q) / (len(p) + len(q)) for p, q in pairs], dtype="float64")

    return F.pandas_udf(ratios, "double")(a, b)
