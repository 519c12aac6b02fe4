"""Binding a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x worked out once, however often f uses it.

    Lambdas of higher-order functions work out all that they mention for each element, so an
    array that they look into has to be bound first."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
