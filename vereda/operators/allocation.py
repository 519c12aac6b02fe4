"""Study plans: units of work dealt to days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import top_of_each
from .ordered import checkpoint_dir, running


def sequential(tasks: DataFrame, order: list[str], units: str, per_day: int, days: int) -> DataFrame:
    """Units in order, ``per_day`` to a day, the rest on the last: (…, day, n) for each task.

    A task covers an interval of unit numbers; the days it touches are those of the
    interval's ends, so units are never exploded."""
    t = running(tasks, order, F.col(units), "_hi").withColumn("_lo", F.col("_hi") - F.col(units)).filter(F.col(units) > 0)
    day = lambda p: F.least(F.floor(p / per_day), F.lit(days - 1))
    t = t.withColumn("day", F.explode(F.sequence(day(F.col("_lo")), day(F.col("_hi") - 1))))
    last = F.col("day") == days - 1
    end = F.when(last, F.col("_hi")).otherwise(F.least(F.col("_hi"), (F.col("day") + 1) * per_day))
    return t.withColumn("n", end - F.greatest(F.col("_lo"), F.col("day") * per_day)).drop("_lo", "_hi")


def round_robin(items: DataFrame, group: str, order: str, per_day: int, days: int) -> DataFrame:
    """Items in turn from each group, ``per_day`` to a day."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    numbered = running(items.withColumn("turn", turn), ["turn", group], out="_place")
    return numbered.withColumn("day", F.least(F.floor((F.col("_place") - 1) / per_day), F.lit(days - 1))).drop("_place")


def quota(total: Column, days: Column, factor: float = 1.0, least: int = 1, most: int = 1000) -> Column:
    """Units a day: the total over the days, scaled and bounded."""
    return F.least(F.greatest(F.ceil(total / F.greatest(days, F.lit(1)) * factor), F.lit(least)), F.lit(most))


def matched(fits: DataFrame, item: str, places: DataFrame) -> DataFrame:
    """Items to specifications without reuse: ``fits(item, spec)``, and ``places(spec, prio,
    take)`` with distinct ``prio`` → (item, spec, place).

    The result is that of the greedy rule: specifications by priority, each takes its first
    ``take`` items in item order that are not taken yet.  It is reached in rounds, by all
    specifications at once: an item asks the first specification on its list, which keeps the
    first ``take`` that have asked so far; what it turns away asks its next choice, and may
    displace others there.  A round is one grouped cut, made in each task before the shuffle;
    there are as many rounds as an item has to ask at most.

    Defined cases: null items and specifications fit nothing; repeated fits count once; items
    that nobody takes are not in the result."""
    checkpoint_dir(fits.sparkSession)
    asked = fits.filter(F.col(item).isNotNull()).select(item, "spec").distinct().join(places.select("spec", "prio", "take"), "spec").filter("take > 0").checkpoint()
    open_ = asked
    while True:
        asks = open_.groupBy(item).agg(F.min(F.struct("prio", "spec", "take")).alias("s")).select(item, "s.spec", "s.take")
        most = asks.agg(F.max("take").alias("m")).first()["m"]
        if most is None:
            return asks.select(item, "spec", F.lit(0).alias("place"))
        held = top_of_each(asks, ["spec"], [F.col(item)], most).filter(F.col("place") <= F.col("take")).checkpoint()
        turned = asks.join(held.select(item, "spec"), [item, "spec"], "left_anti").select(item, "spec").checkpoint()
        if not turned.limit(1).count():
            return held.select(item, "spec", "place")
        # who has once been turned away stays so: those kept before it only get better
        open_ = open_.join(turned, [item, "spec"], "left_anti").checkpoint()
