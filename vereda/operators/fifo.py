"""First-in first-out matching of buys and sells as an interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matched(trades: DataFrame) -> DataFrame:
    """``trades(asset, trade, at, price, buy, qty)`` → one row for each pair of a buy and a sell
    that share units.

    The k-th unit bought always meets the k-th unit sold, so each trade is an interval of
    cumulative quantity and pairs are the overlaps.  Each interval is cut into stretches of
    ``step`` units and pairs meet on (asset, stretch): an equi-join whose keys stay small even
    for an asset that trades very often; an overlap counts in the stretch where it begins.
    """
    step = 64
    run = Window.partitionBy("asset", "buy").orderBy("at", "trade").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("hi", F.sum("qty").over(run)).withColumn("lo", F.col("hi") - F.col("qty"))
    t = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))
    side = lambda flag, name: t.filter(F.col("buy") == flag).select("asset", "cell", *[F.col(c).alias(f"{name}_{c}") for c in ("trade", "at", "price", "lo", "hi")])
    pairs = side(True, "buy").join(side(False, "sell"), ["asset", "cell"]).filter("buy_lo < sell_hi and sell_lo < buy_hi")
    begin = F.greatest("buy_lo", "sell_lo")
    pairs = pairs.filter(F.floor(begin / step) == F.col("cell"))
    earlier = F.struct("buy_at", "buy_trade") < F.struct("sell_at", "sell_trade")
    return pairs.select("asset", "buy_trade", "sell_trade", "buy_price", "sell_price", (F.least("buy_hi", "sell_hi") - begin).alias("qty"), earlier.alias("long"))
