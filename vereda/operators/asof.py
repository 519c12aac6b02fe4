"""As-of join: for each row the latest row of another table, not older than a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], tolerance: int, parts: int = 1) -> DataFrame:
    """``left`` with the ``values`` of the latest right row of the same ``by`` whose time is at most
    the left row's and at most ``tolerance`` seconds before it; null where there is none.

    Time is cut into stretches of ``tolerance / parts``.  A right row is put into its own stretch and
    the ``parts`` next ones, a left row into its own, and one ordered pass over a stretch finds
    the latest.  So a key that holds a third of all rows is dealt out by time, and more finely
    with more parts; no pair of rows is made.

    Defined cases: a left row with a null key or time gets nulls; such right rows are passed over;
    right rows of equal time are decided by the largest values; repeated left rows stay."""
    step = max(1, tolerance * 1_000_000 // parts)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    found = [f"_{v}" for v in values]
    own = left.select("*", t.alias("_t"), F.floor(t / step).alias("_stretch"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"))
    own = own.select(*[F.col(k) for k in by], "_t", "_stretch", "_left", "_row", F.lit(None).cast(right.select(F.struct(t.alias("_at"), *values).alias("x")).schema["x"].dataType).alias("_x"))
    known = t.isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    stretches = F.sequence(F.floor(t / step), F.floor(t / step) + parts)
    other = right.filter(known).select(*by, t.alias("_t"), F.explode(stretches).alias("_stretch"), F.lit(0).alias("_left"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.struct(t.alias("_at"), *values).alias("_x"))
    w = Window.partitionBy(*by, "_stretch").orderBy("_t", "_left", "_x").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("_last", F.last("_x", ignorenulls=True).over(w)).filter("_left = 1")
    good = F.col("_t").isNotNull() & (F.col("_t") - F.col("_last._at") <= tolerance * 1_000_000)
    for k in by:
        good = good & F.col(k).isNotNull()
    out = both.select("_row", *[F.when(good, F.col(f"_last.{v}")).alias(n) for v, n in zip(values, found, strict=True)])
    return out.select("_row.*", *[F.col(n).alias(n[1:] if n[1:] not in left.columns else f"right{n}") for n in found])
