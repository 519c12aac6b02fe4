"""Time-series operators over long frames of bars: symbol, ts, open, high, low, close, volume.

Every operator is a window over one symbol, ordered by time.  A rolling statistic is NULL
until its frame is full.  Missing values are NULL, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(by: str = "symbol", at: str = "ts") -> WindowSpec:
    return Window.partitionBy(by).orderBy(at)


def rolling(agg, value: Column, n: int, over: WindowSpec | None = None) -> Column:
    """``agg`` of the last n values, NULL while fewer than n are known."""
    w = (over or series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, agg(value).over(w))


def change(value: Column, k: int = 1, over: WindowSpec | None = None) -> Column:
    """Return over k rows; negative k looks ahead."""
    w = over or series()
    if k > 0:
        return F.try_divide(value, F.lag(value, k).over(w)) - 1
    return F.try_divide(F.lead(value, -k).over(w), value) - 1


def ewm(df: DataFrame, value: str, out: str, weight: float, by: str = "symbol", at: str = "ts") -> DataFrame:
    """Recursive average y = (1 - a) y + a x that starts at the first value (no NULLs inside).

    In closed form over blocks of rows: weights older than a block are below 1e-17 of the
    newest, so that a row needs its own block up to itself and the end of the block before.
    No sequence is walked row by row, whatever its length.
    """
    keep = -math.log(1 - weight)
    size = max(2, math.ceil(40 / keep))
    row = F.row_number().over(Window.partitionBy(by).orderBy(at)) - 1
    df = df.withColumn("_i", row).withColumn("_b", F.floor(F.col("_i") / size)).withColumn("_k", F.col("_i") % size)
    gain = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(weight))
    term = F.col(value) * gain * F.exp(F.col("_k") * keep)
    in_block = Window.partitionBy(by, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_own", F.sum(term).over(in_block) * F.exp(-F.col("_k") * keep))
    before = Window.partitionBy(by).orderBy("_b").rangeBetween(-1, -1)
    ends = F.max(F.when(F.col("_k") == size - 1, F.col("_own"))).over(before)
    y = F.col("_own") + F.coalesce(ends, F.lit(0.0)) * F.exp(-(F.col("_k") + 1) * keep)
    return df.withColumn(out, y).drop("_i", "_b", "_k", "_own")


def span(n: int) -> float:
    return 2.0 / (n + 1)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(ewm(df, "close", "_fast", span(fast)), "close", "_slow", span(slow))
    df = ewm(df.withColumn("macd", F.col("_fast") - F.col("_slow")), "macd", "macd_signal", span(signal))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def _gain_loss(df: DataFrame) -> DataFrame:
    d = F.col("close") - F.lag("close").over(series())
    return df.withColumn("_d", d).withColumn("_up", F.greatest(F.col("_d"), F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0)))


def _index(up: Column, down: Column) -> Column:
    """100 where nothing fell."""
    return F.when(down == 0, F.when(up == 0, F.lit(None)).otherwise(100.0)).otherwise(100 - 100 / (1 + up / down))


def rsi(df: DataFrame, n: int = 14, method: str = "wilder") -> DataFrame:
    """``wilder`` averages recursively from the first difference on, ``simple`` over n rows."""
    df = _gain_loss(df)
    if method == "simple":
        up, down = rolling(F.avg, F.col("_up"), n), rolling(F.avg, F.col("_down"), n)
        return df.withColumn("rsi", _index(up, down)).drop("_d", "_up", "_down")
    moved = df.filter(F.col("_d").isNotNull())
    moved = ewm(ewm(moved, "_up", "_au", 1.0 / n), "_down", "_ad", 1.0 / n)
    found = moved.select("symbol", "ts", _index(F.col("_au"), F.col("_ad")).alias("rsi"))
    return df.drop("_d", "_up", "_down").join(found, ["symbol", "ts"], "left")


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    c = F.col("close")
    df = df.withColumn("bb_mid", rolling(F.avg, c, n)).withColumn("_sd", rolling(F.stddev_samp, c, n))
    df = df.withColumn("bb_up", F.col("bb_mid") + width * F.col("_sd")).withColumn("bb_down", F.col("bb_mid") - width * F.col("_sd"))
    return df.withColumn("pct_b", F.try_divide(c - F.col("bb_down"), F.col("bb_up") - F.col("bb_down"))).drop("_sd")


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    before = F.lag("close").over(series())
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn("true_range", true_range).withColumn("atr", rolling(F.avg, F.col("true_range"), n))


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index; unchanged and first rows count as falling."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_tp", typical)
    rose = F.coalesce(F.col("_tp") > F.lag("_tp").over(series()), F.lit(False))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumn("_in", F.when(rose, flow).otherwise(0.0)).withColumn("_out", F.when(rose, 0.0).otherwise(flow))
    inflow, outflow = rolling(F.sum, F.col("_in"), n), rolling(F.sum, F.col("_out"), n)
    return df.withColumn("mfi", F.when(outflow > 0, 100 - 100 / (1 + inflow / outflow))).drop("_tp", "_in", "_out")


def drawdown(df: DataFrame) -> DataFrame:
    peak = F.max("close").over(series().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drawdown", F.try_divide(F.col("close"), peak) - 1)


def crosses_up(a: str, b: str) -> Column:
    w = series()
    return F.coalesce((F.col(a) > F.col(b)) & (F.lag(a).over(w) <= F.lag(b).over(w)), F.lit(False))


def swings(df: DataFrame, reach: int = 10) -> DataFrame:
    """Rows whose high (low) is the greatest (least) of ``reach`` rows on either side."""
    w = series().rowsBetween(-reach, reach)
    full = F.count("*").over(w) == 2 * reach + 1
    df = df.withColumn("swing_high", full & (F.col("high") == F.max("high").over(w)))
    return df.withColumn("swing_low", full & (F.col("low") == F.min("low").over(w)))


def clusters(df: DataFrame, value: str, gap: float = 0.02, by: str = "symbol") -> DataFrame:
    """Sorted values; a new cluster begins where the step from the previous member exceeds ``gap``."""
    w = Window.partitionBy(by).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w)) / F.lag(value).over(w) > gap, F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def filled(df: DataFrame, value: str, by: str | None = "symbol", at: str = "ts") -> DataFrame:
    """Each missing value takes the last known one (an as-of join's second half)."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def bars(rows: DataFrame, period: Column, price: Column, volume: Column, order: list[str], symbol: Column) -> DataFrame:
    """Open, high, low, close and volume of each symbol and period, by one grouped
    aggregation that is combined before the shuffle."""
    rank = F.struct(*order)
    base = rows.select(symbol.alias("symbol"), period.alias("ts"), price.alias("_p"), volume.alias("_v"), rank.alias("_o"))
    return base.groupBy("symbol", "ts").agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"), F.sum("_v").alias("volume"), F.count("*").alias("trades")
    )


def aligned(left: DataFrame, right: DataFrame, at: str, columns: list[str], grain: str = "month") -> DataFrame:
    """Two series on the union of their days, each with its last known value (none before its first).

    Values are carried within each ``grain`` of days by a window over that grain alone; what
    enters a grain is the last value of the grains before it, a small table of its own.  So no
    task gets the whole series, however long it is."""
    joined = left.join(right, at, "full_outer").withColumn("_g", F.date_trunc(grain, at))
    inside = Window.partitionBy("_g").orderBy(at)
    ends = joined.groupBy("_g").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns])
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    enters = ends.select("_g", *[F.last(c, True).over(before).alias(f"_{c}") for c in columns])
    carried = joined.join(enters, "_g", "left")
    return carried.select(at, *[F.coalesce(F.last(c, True).over(inside), F.col(f"_{c}")).alias(c) for c in columns])
