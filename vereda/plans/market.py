"""Time-series queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import series
from .common import BARS, daily_bars, rolled, rounded, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


W = "OVER (PARTITION BY symbol ORDER BY ts)"


@query(f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume, trades FROM b")
def bars_daily(spark, sf_dir):
    """Open, high, low, close and volume by symbol and day."""
    return daily_bars(spark, sf_dir)


@query(
    f"""WITH {BARS}, m AS (SELECT symbol, ts, close, {rolled("avg", "close", 20)} AS bb_mid, {rolled("stddev_samp", "close", 20)} AS sd,
        {rolled("avg", "close", 50)} AS sma50, {rolled("avg", "close", 200)} AS sma200 FROM b)
    SELECT symbol, ts, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200, round(bb_mid, 6) AS bb_mid, round(bb_mid + 2 * sd, 6) AS bb_up, round(bb_mid - 2 * sd, 6) AS bb_down,
        round((close - (bb_mid - 2 * sd)) / nullif((bb_mid + 2 * sd) - (bb_mid - 2 * sd), 0), 6) AS pct_b FROM m"""
)
def sma_bands(spark, sf_dir):
    """Moving averages and bands, NULL until their frames are full."""
    df = series.bollinger(daily_bars(spark, sf_dir))
    c = F.col("close")
    return rounded(df.select("symbol", "ts", series.rolling(F.avg, c, 50).alias("sma50"), series.rolling(F.avg, c, 200).alias("sma200"), "bb_mid", "bb_up", "bb_down", "pct_b"))


def _ema_sql(value: str, a: str, name: str, source: str, out: str) -> str:
    """The recursive average in closed form over the whole series."""
    return f"""{out} AS (SELECT *, pow(1 - {a}, i) * sum(CASE WHEN i = 0 THEN {value} ELSE {a} * {value} * pow(1 - {a}, -i) END)
        OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {name} FROM {source})"""


@query(
    f"""WITH {BARS}, n AS (SELECT symbol, ts, close, row_number() {W} - 1 AS i FROM b),
    {_ema_sql("close", "(2.0/13)", "fast", "n", "e1")}, {_ema_sql("close", "(2.0/27)", "slow", "e1", "e2")},
    d AS (SELECT *, fast - slow AS macd FROM e2), {_ema_sql("macd", "(2.0/10)", "macd_signal", "d", "e3")}
    SELECT symbol, ts, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd - macd_signal, 6) AS macd_hist FROM e3"""
)
def ema_macd(spark, sf_dir):
    """Convergence and divergence of recursive averages."""
    return rounded(series.macd(daily_bars(spark, sf_dir)).select("symbol", "ts", "macd", "macd_signal", "macd_hist"))


@query(
    f"""WITH {BARS}, g AS (SELECT symbol, ts, close - lag(close) {W} AS dd FROM b),
    n AS (SELECT symbol, ts, greatest(dd, 0) AS up, greatest(-dd, 0) AS down, row_number() {W} - 1 AS i FROM g WHERE dd IS NOT NULL),
    {_ema_sql("up", "(1.0/14)", "au", "n", "e1")}, {_ema_sql("down", "(1.0/14)", "ad", "e1", "e2")}
    SELECT b.symbol, b.ts, round(CASE WHEN ad = 0 THEN CASE WHEN au = 0 THEN NULL ELSE 100 END ELSE 100 - 100 / (1 + au / ad) END, 6) AS rsi
    FROM b LEFT JOIN e2 ON e2.symbol = b.symbol AND e2.ts = b.ts"""
)
def rsi_wilder(spark, sf_dir):
    """Relative strength with recursive averages."""
    return rounded(series.rsi(daily_bars(spark, sf_dir)).select("symbol", "ts", "rsi"))


@query(
    f"""WITH {BARS}, g AS (SELECT symbol, ts, close - lag(close) {W} AS dd FROM b), u AS (SELECT symbol, ts, CASE WHEN dd IS NOT NULL THEN greatest(dd, 0) END AS up, CASE WHEN dd IS NOT NULL THEN greatest(-dd, 0) END AS down FROM g),
    m AS (SELECT symbol, ts, {rolled("avg", "up", 14)} AS au, {rolled("avg", "down", 14)} AS ad FROM u)
    SELECT symbol, ts, round(CASE WHEN ad = 0 THEN CASE WHEN au = 0 THEN NULL ELSE 100 END ELSE 100 - 100 / (1 + au / ad) END, 6) AS rsi FROM m"""
)
def rsi_simple(spark, sf_dir):
    """Relative strength with plain means."""
    df = daily_bars(spark, sf_dir)
    d = F.col("close") - F.lag("close").over(series.series())
    df = df.withColumn("_d", d).withColumn("_up", F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0)))).withColumn("_down", F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))))
    up, down = series.rolling(F.avg, F.col("_up"), 14), series.rolling(F.avg, F.col("_down"), 14)
    return rounded(df.select("symbol", "ts", series._index(up, down).alias("rsi")))


@query(
    f"""WITH {BARS}, t AS (SELECT *, lag(close) {W} AS pc, (high + low + close) / 3 AS tp FROM b),
    r AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS true_range, coalesce(tp > lag(tp) {W}, false) AS rose FROM t),
    f AS (SELECT *, CASE WHEN rose THEN tp * volume ELSE 0 END AS fi, CASE WHEN rose THEN 0 ELSE tp * volume END AS fo FROM r),
    m AS (SELECT symbol, ts, true_range, {rolled("avg", "true_range", 14)} AS atr, {rolled("sum", "fi", 14)} AS si, {rolled("sum", "fo", 14)} AS so FROM f)
    SELECT symbol, ts, true_range, round(atr, 6) AS atr, round(CASE WHEN so > 0 THEN 100 - 100 / (1 + si / so) END, 6) AS mfi FROM m"""
)
def atr_mfi(spark, sf_dir):
    """True range and money flow."""
    return rounded(series.mfi(series.atr(daily_bars(spark, sf_dir))).select("symbol", "ts", "true_range", "atr", "mfi"), only=["atr", "mfi"])


@query(
    f"""WITH {BARS}, d AS (SELECT symbol, ts, close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM b)
    SELECT symbol, round(min(dd), 6) AS max_drawdown, arg_min(ts, struct_pack(a := dd, z := ts)) AS at, count(*) AS days FROM d GROUP BY symbol"""
)
def drawdown(spark, sf_dir):
    """Deepest fall from a peak, and its day."""
    df = series.drawdown(daily_bars(spark, sf_dir))
    return rounded(df.groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"), F.min_by("ts", F.struct("drawdown", "ts")).alias("at"), F.count("*").alias("days")))


@query(
    f"""WITH {BARS}, p AS (SELECT symbol, date_trunc('month', ts)::DATE AS period, max(high) AS hi, min(low) AS lo FROM b GROUP BY 1, 2)
    SELECT symbol, period, round(hi, 6) AS hi, round(lo, 6) AS lo, round(lag(hi) OVER (PARTITION BY symbol ORDER BY period), 6) AS prev_hi, round(lag(lo) OVER (PARTITION BY symbol ORDER BY period), 6) AS prev_lo FROM p"""
)
def period_hilo(spark, sf_dir):
    """High and low of each month and of the month before."""
    p = daily_bars(spark, sf_dir).groupBy("symbol", F.trunc("ts", "month").alias("period")).agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    w = Window.partitionBy("symbol").orderBy("period")
    return rounded(p.withColumn("prev_hi", F.lag("hi").over(w)).withColumn("prev_lo", F.lag("lo").over(w)))


@query(f"WITH {BARS} SELECT symbol, year(ts)::INTEGER AS year, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS ret, count(*) AS days FROM b GROUP BY 1, 2")
def annual_returns(spark, sf_dir):
    """Last over first close of each calendar year."""
    g = daily_bars(spark, sf_dir).groupBy("symbol", F.year("ts").alias("year"))
    return rounded(g.agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("ret"), F.count("*").alias("days")))


@query(
    f"""WITH {BARS}, m AS (SELECT symbol, date_trunc('month', ts)::DATE AS month, arg_max(close, ts) AS last FROM b GROUP BY 1, 2)
    SELECT symbol, month, round(100 * last / first_value(last) OVER (PARTITION BY symbol ORDER BY month), 6) AS base100 FROM m"""
)
def monthly_index(spark, sf_dir):
    """Month-end closes, the first month being 100."""
    m = daily_bars(spark, sf_dir).groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(F.max_by("close", "ts").alias("last"))
    first = F.first("last").over(Window.partitionBy("symbol").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return rounded(m.select("symbol", "month", (100 * F.col("last") / first).alias("base100")))


_RETURNS = f"""{BARS}, o AS (SELECT o_orderdate::DATE AS ts, avg(o_totalprice) AS bench FROM orders GROUP BY 1),
    j AS (SELECT b.symbol, b.ts, b.close, last_value(o.bench IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS UNBOUNDED PRECEDING) AS bench FROM b LEFT JOIN o ON o.ts = b.ts),
    r AS (SELECT symbol, ts, close / lag(close) {W} - 1 AS ra, bench / lag(bench) {W} - 1 AS rb FROM j),
    q AS (SELECT * FROM r WHERE ra IS NOT NULL AND rb IS NOT NULL)"""


def _returns(spark, sf_dir):
    """Daily returns of each symbol and of the benchmark (mean order price), as-of filled."""
    bench = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("bench"))
    joined = series.filled(daily_bars(spark, sf_dir).join(bench, "ts", "left"), "bench")
    r = joined.select("symbol", "ts", series.change(F.col("close")).alias("ra"), series.change(F.col("bench")).alias("rb"))
    return r.filter("ra is not null and rb is not null")


@query(
    f"""WITH {_RETURNS}, m AS (SELECT symbol, ts, CASE WHEN count(*) OVER w = 90 THEN corr(ra, rb) OVER w END AS c, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts DESC) AS k
        FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, round(c, 6) AS corr90 FROM m WHERE k = 1 AND c IS NOT NULL AND NOT isnan(c)"""
)
def rolling_corr(spark, sf_dir):
    """Correlation over 90 rows, one value for each month."""
    w = series.series().rowsBetween(-89, 0)
    r = _returns(spark, sf_dir).withColumn("corr90", F.when(F.count("*").over(w) == 90, F.try_divide(F.covar_pop("ra", "rb").over(w), F.stddev_pop("ra").over(w) * F.stddev_pop("rb").over(w))))
    last = F.row_number().over(Window.partitionBy("symbol", F.trunc("ts", "month")).orderBy(F.desc("ts")))
    return rounded(r.withColumn("k", last).filter("k = 1 and corr90 is not null").select("symbol", "ts", "corr90"))


@query(
    f"""WITH {_RETURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM q)
    SELECT symbol, count(*) AS n, round(corr(ra, rb), 6) AS corr, round(covar_samp(ra, rb) / var_pop(rb), 6) AS beta_mixed, round(covar_samp(ra, rb) / var_samp(rb), 6) AS beta FROM k WHERE n <= 252 GROUP BY symbol"""
)
def beta_window(spark, sf_dir):
    """Correlation and both betas over the last 252 returns."""
    r = _returns(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter("n <= 252")
    cov = F.covar_samp("ra", "rb")
    return rounded(r.groupBy("symbol").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("corr"), (cov / F.var_pop("rb")).alias("beta_mixed"), (cov / F.var_samp("rb")).alias("beta")))


@query(
    f"""WITH {_RETURNS} SELECT symbol, CASE WHEN rb > 0.001 THEN 'up' WHEN rb < -0.001 THEN 'down' ELSE 'flat' END AS regime, count(*) AS n, round(avg(ra), 6) AS mean, round(quantile_cont(ra, 0.5), 6) AS median, round(avg((ra > 0)::INT), 6) AS hit FROM q GROUP BY 1, 2"""
)
def regime_stats(spark, sf_dir):
    """A symbol's returns on days when the benchmark rises, falls or stays."""
    regime = F.when(F.col("rb") > 0.001, "up").when(F.col("rb") < -0.001, "down").otherwise("flat")
    g = _returns(spark, sf_dir).groupBy("symbol", regime.alias("regime"))
    return rounded(g.agg(F.count("*").alias("n"), F.avg("ra").alias("mean"), F.percentile("ra", 0.5).alias("median"), F.avg((F.col("ra") > 0).cast("int")).alias("hit")))


_SWINGS = f"""{BARS}, s AS (SELECT symbol, ts, high, low, count(*) OVER w = 21 AND high = max(high) OVER w AS sh, count(*) OVER w = 21 AND low = min(low) OVER w AS sl
    FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))"""


@query(
    f"""WITH {_SWINGS}, v AS (SELECT symbol, ts, high AS level FROM s WHERE sh), g AS (SELECT *, CASE WHEN (level - lag(level) OVER o) / lag(level) OVER o > 0.02 OR lag(level) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY symbol ORDER BY level, ts)),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY level, ts ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
    SELECT symbol, cluster::BIGINT AS cluster, count(*) AS touches, round(avg(level), 6) AS level FROM c GROUP BY 1, 2"""
)
def swing_clusters(spark, sf_dir):
    """Swing highs, grouped where neighbours lie within two per cent."""
    s = series.swings(daily_bars(spark, sf_dir)).filter("swing_high").select("symbol", "ts", F.col("high").alias("level"))
    return rounded(series.clusters(s, "level").groupBy("symbol", "cluster").agg(F.count("*").alias("touches"), F.avg("level").alias("level")))


HORIZONS = (1, 3, 5, 10, 21)
_FRAME = f"""{BARS}, f AS (SELECT symbol, ts, open, close, lag(close) {W} AS c1, {rolled("avg", "close", 20)} AS s20, {rolled("stddev_samp", "close", 20)} AS d20, {rolled("avg", "close", 50)} AS s50,
        {rolled("max", "close", 20)} AS hi20, {rolled("min", "close", 20)} AS lo20, close / lag(close, 1) {W} - 1 AS r1, close / lag(close, 5) {W} - 1 AS r5, {", ".join(f"lead(close, {h}) {W} / close - 1 AS f{h}" for h in HORIZONS)} FROM b),
    g AS (SELECT *, lag(s50) {W} AS s50p, lag(r1, 1) {W} AS r1p, lag(r1, 2) {W} AS r1pp FROM f)"""
_RULES = {
    "below lower band": "close < s20 - 2 * d20",
    "above upper band": "close > s20 + 2 * d20",
    "crosses above 50": "close > s50 AND c1 <= s50p",
    "fell 8% in 5": "r5 <= -0.08",
    "three falls": "r1 < 0 AND r1p < 0 AND r1pp < 0",
    "new 20 high": "close >= hi20",
    "new 20 low": "close <= lo20",
    "gap down": "open / c1 - 1 < -0.02",
    "gap up": "open / c1 - 1 > 0.02",
}


def _signal_frame(spark, sf_dir) -> DataFrame:
    c, w = F.col("close"), series.series()
    df = daily_bars(spark, sf_dir).select(
        "symbol", "ts", "open", "close", F.lag("close").over(w).alias("c1"), series.rolling(F.avg, c, 20).alias("s20"), series.rolling(F.stddev_samp, c, 20).alias("d20"), series.rolling(F.avg, c, 50).alias("s50"),
        series.rolling(F.max, c, 20).alias("hi20"), series.rolling(F.min, c, 20).alias("lo20"), series.change(c, 1).alias("r1"), series.change(c, 5).alias("r5"), *[series.change(c, -h).alias(f"f{h}") for h in HORIZONS],
    )
    return df.withColumn("s50p", F.lag("s50").over(w)).withColumn("r1p", F.lag("r1", 1).over(w)).withColumn("r1pp", F.lag("r1", 2).over(w))


def _fired(df: DataFrame) -> DataFrame:
    """One row for each signal that fires, horizon and bar."""
    rules = F.array(*[F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in _RULES.items()])
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("fwd")) for h in HORIZONS])
    return df.select("symbol", "ts", F.explode(F.array_compact(rules)).alias("rule"), ahead.alias("a")).select("symbol", "rule", F.inline("a"))


_SUMMARY = f"""WITH {_FRAME}, u AS ({" UNION ALL ".join(f"SELECT symbol, {h} AS h, f{h} AS fwd FROM g" for h in HORIZONS)}),
    z AS (SELECT symbol, h, avg(fwd) AS base, sum((fwd > 0)::INT)::DOUBLE / count(fwd) AS base_hit FROM u GROUP BY 1, 2),
    s AS ({" UNION ALL ".join(f"SELECT symbol, '{n}' AS rule, {h} AS h, f{h} AS fwd FROM g WHERE {r}" for n, r in _RULES.items() for h in HORIZONS)}),
    t AS (SELECT symbol, rule, h, count(*) AS fired, count(fwd) AS n, avg(fwd) AS mean, sum((fwd > 0)::INT)::DOUBLE / count(fwd) AS hit, stddev_samp(fwd) AS sd FROM s GROUP BY 1, 2, 3)"""


def _summary(spark, sf_dir) -> DataFrame:
    df = _signal_frame(spark, sf_dir)
    base = df.select("symbol", F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("fwd")) for h in HORIZONS])))
    base = base.groupBy("symbol", "h").agg(F.avg("fwd").alias("base"), (F.sum((F.col("fwd") > 0).cast("int")) / F.count("fwd")).alias("base_hit"))
    hits = _fired(df).groupBy("symbol", "rule", "h").agg(F.count("*").alias("fired"), F.count("fwd").alias("n"), F.avg("fwd").alias("mean"), F.try_divide(F.sum((F.col("fwd") > 0).cast("int")), F.count("fwd")).alias("hit"), F.stddev_samp("fwd").alias("sd"))
    return hits.join(base, ["symbol", "h"])


@query(
    f"""{_SUMMARY} SELECT t.symbol, t.rule, t.h, t.fired, t.n, round(mean, 6) AS mean, round(hit, 6) AS hit, round(mean - base, 6) AS edge, round(hit - base_hit, 6) AS hit_edge,
        round(CASE WHEN sd > 0 THEN (mean - base) / (sd / sqrt(n)) END, 4) AS tstat FROM t JOIN z ON z.symbol = t.symbol AND z.h = t.h WHERE n > 0"""
)
def signal_backtest(spark, sf_dir):
    """Forward returns after each signal, against all days."""
    s = _summary(spark, sf_dir).filter("n > 0")
    t = F.when(F.col("sd") > 0, (F.col("mean") - F.col("base")) / (F.col("sd") / F.sqrt("n")))
    return s.select("symbol", "rule", "h", "fired", "n", *[F.round(x, 6).alias(a) for x, a in ((F.col("mean"), "mean"), (F.col("hit"), "hit"), (F.col("mean") - F.col("base"), "edge"), (F.col("hit") - F.col("base_hit"), "hit_edge"))], F.round(t, 4).alias("tstat"))


@query(
    f"""{_SUMMARY}, k AS (SELECT t.symbol, t.rule, n, round(mean - base, 6) AS edge, row_number() OVER (PARTITION BY t.symbol ORDER BY round(mean - base, 6) DESC, t.rule) AS place FROM t JOIN z ON z.symbol = t.symbol AND z.h = t.h WHERE t.h = 10 AND fired >= 15 AND n > 0)
    SELECT symbol, place::INTEGER AS place, rule, n, edge FROM k"""
)
def signal_ranking(spark, sf_dir):
    """Signals by their edge over ten rows, where they fired often enough."""
    s = _summary(spark, sf_dir).filter("h = 10 and fired >= 15 and n > 0").withColumn("edge", F.round(F.col("mean") - F.col("base"), 6))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("edge"), "rule"))).select("symbol", "place", "rule", "n", "edge")


@query(
    f"""WITH {BARS}, s AS (SELECT *, high - low AS sz, abs(close - open) AS body, high - greatest(open, close) AS above, least(open, close) - low AS below FROM b),
    c AS (SELECT *, CASE WHEN sz <= 0 THEN 'sem amplitude' WHEN body / sz < 0.12 THEN 'doji (indecisao)' WHEN body / sz > 0.68 THEN CASE WHEN close >= open THEN 'marubozu de alta' ELSE 'marubozu de baixa' END
        WHEN below >= 2 * body AND above <= 0.25 * sz THEN 'martelo (sombra inferior)' WHEN above >= 2 * body AND below <= 0.25 * sz THEN 'estrela cadente (sombra superior)'
        ELSE CASE WHEN close >= open THEN 'corpo de alta' ELSE 'corpo de baixa' END END AS shape, lead(close) {W} / close - 1 AS nxt FROM s)
    SELECT shape, count(*) AS n, round(avg(nxt), 6) AS next_mean, round(avg((nxt > 0)::INT), 6) AS next_hit FROM c GROUP BY shape"""
)
def candle_classes(spark, sf_dir):
    """Shape of each bar, and how the next one went."""
    shape = numeric.candle(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    df = daily_bars(spark, sf_dir).select(shape.alias("shape"), series.change(F.col("close"), -1).alias("nxt"))
    return rounded(df.groupBy("shape").agg(F.count("*").alias("n"), F.avg("nxt").alias("next_mean"), F.avg((F.col("nxt") > 0).cast("int")).alias("next_hit")))


@query(
    f"""WITH {BARS}, r AS (SELECT symbol, ts, close / lag(close) {W} - 1 AS r FROM b), v AS (SELECT symbol, ts, r, {rolled("stddev_samp", "r", 21)} * sqrt(252) * 100 AS vol FROM r),
    p AS (SELECT symbol, quantile_cont(vol, 0.25) AS p25, quantile_cont(vol, 0.75) AS p75 FROM v GROUP BY symbol), l AS (SELECT symbol, arg_max(vol, ts) AS vol FROM v WHERE vol IS NOT NULL GROUP BY symbol)
    SELECT l.symbol, round(vol, 6) AS vol, round(p25, 6) AS p25, round(p75, 6) AS p75, CASE WHEN vol > p75 THEN 'high' WHEN vol < p25 THEN 'low' ELSE 'normal' END AS regime FROM l JOIN p ON p.symbol = l.symbol"""
)
def volatility_regime(spark, sf_dir):
    """Realised volatility of 21 rows against its own quartiles."""
    r = daily_bars(spark, sf_dir).withColumn("r", series.change(F.col("close")))
    v = r.withColumn("vol", series.rolling(F.stddev_samp, F.col("r"), 21) * F.sqrt(F.lit(252.0)) * 100)
    g = v.groupBy("symbol").agg(F.max_by("vol", F.when(F.col("vol").isNotNull(), F.col("ts"))).alias("vol"), F.percentile("vol", 0.25).alias("p25"), F.percentile("vol", 0.75).alias("p75"))
    return rounded(g.withColumn("regime", F.when(F.col("vol") > F.col("p75"), "high").when(F.col("vol") < F.col("p25"), "low").otherwise("normal")))


@query(
    f"""WITH {BARS}, k AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM b), l AS (SELECT symbol, close, 60 - n AS x FROM k WHERE n <= 60),
    s AS (SELECT symbol, regr_slope(close, x) AS slope, avg(close) AS mean, count(*) AS n FROM l GROUP BY symbol)
    SELECT symbol, n, round(slope, 6) AS slope, CASE WHEN slope * 60 / mean > 0.03 THEN 'up' WHEN slope * 60 / mean < -0.03 THEN 'down' ELSE 'flat' END AS trend FROM s"""
)
def trend_slope(spark, sf_dir):
    """Regression over the last sixty closes."""
    k = daily_bars(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter("n <= 60")
    s = k.groupBy("symbol").agg(F.regr_slope("close", 60 - F.col("n")).alias("slope"), F.avg("close").alias("mean"), F.count("*").alias("n"))
    move = F.col("slope") * 60 / F.col("mean")
    return rounded(s.select("symbol", "n", "slope", F.when(move > 0.03, "up").when(move < -0.03, "down").otherwise("flat").alias("trend")))


_ALIGNED = [("w1", 5), ("m1", 21), ("m3", 63), ("m12", 252)]


@query(
    f"""WITH {BARS}, r AS (SELECT symbol, ts, close, {", ".join(f"close / lag(close, {k}) {W} - 1 AS {n}" for n, k in _ALIGNED)}, {rolled("max", "close", 252)} AS hi, {rolled("min", "close", 252)} AS lo, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b)
    SELECT symbol, ts, {", ".join(f"round({n}, 6) AS {n}" for n, _ in _ALIGNED)}, CASE WHEN hi > lo THEN round_even((close - lo) / (hi - lo) * 100, 0)::DOUBLE END AS place FROM r WHERE k = 1"""
)
def return_snapshot(spark, sf_dir):
    """Returns over several spans and the place in the year's range, at the last bar."""
    c = F.col("close")
    df = daily_bars(spark, sf_dir).select("symbol", "ts", *[series.change(c, k).alias(n) for n, k in _ALIGNED], numeric.place_in_range(c, series.rolling(F.min, c, 252), series.rolling(F.max, c, 252)).alias("place"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("k"))
    return rounded(df.filter("k = 1").drop("k"))


@query(
    """WITH e AS (SELECT event_type AS symbol, ts::DATE AS d, floor((hour(ts) * 60 + minute(ts)) / 30)::INTEGER AS slot, value, ts FROM events),
    q AS (SELECT symbol, d, slot, count(*) AS volume, arg_min(value, ts) AS o, arg_max(value, ts) AS c FROM e GROUP BY 1, 2, 3),
    s AS (SELECT *, volume::DOUBLE / sum(volume) OVER (PARTITION BY symbol, d) AS share, lead(c - o) OVER (PARTITION BY symbol, d ORDER BY slot) AS nxt FROM q)
    SELECT symbol, slot, count(*) AS n, round(avg(volume), 6) AS mean_volume, round(avg(share), 6) AS share, round(avg((c > o)::INT), 6) AS up_rate, round(avg(coalesce(((c - o) > 0 AND nxt > 0) OR ((c - o) < 0 AND nxt < 0), false)::INT), 6) AS continues FROM s GROUP BY 1, 2"""
)
def intraday_profile(spark, sf_dir):
    """Volume, direction and continuation by half hour of the day."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("d"), F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30).cast("int").alias("slot"), "value", "ts")
    q = e.groupBy("symbol", "d", "slot").agg(F.count("*").alias("volume"), F.min_by("value", "ts").alias("o"), F.max_by("value", "ts").alias("c"))
    day = Window.partitionBy("symbol", "d")
    q = q.withColumn("share", F.col("volume") / F.sum("volume").over(day)).withColumn("move", F.col("c") - F.col("o")).withColumn("nxt", F.lead("move").over(day.orderBy("slot")))
    goes_on = F.coalesce(((F.col("move") > 0) & (F.col("nxt") > 0)) | ((F.col("move") < 0) & (F.col("nxt") < 0)), F.lit(False))
    return rounded(q.groupBy("symbol", "slot").agg(F.count("*").alias("n"), F.avg("volume").alias("mean_volume"), F.avg("share").alias("share"), F.avg((F.col("move") > 0).cast("int")).alias("up_rate"), F.avg(goes_on.cast("int")).alias("continues")))


@query(
    """WITH p AS (SELECT event_type AS symbol, ts::DATE AS d, ts, value, value - lag(value) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts) AS step FROM events)
    SELECT symbol, d, count(*) AS n, round(abs(arg_max(value, ts) - arg_min(value, ts)) / nullif(sum(abs(step)), 0), 6) AS efficiency, arg_max(ts, struct_pack(v := value, t := ts)) AS high_at FROM p GROUP BY 1, 2"""
)
def session_efficiency(spark, sf_dir):
    """Net move of each session over the length of its path."""
    w = Window.partitionBy("symbol", "d").orderBy("ts")
    p = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("d"), "ts", "value").withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    return rounded(p.groupBy("symbol", "d").agg(F.count("*").alias("n"), F.try_divide(F.abs(F.max_by("value", "ts") - F.min_by("value", "ts")), F.sum("step")).alias("efficiency"), F.max_by("ts", F.struct("value", "ts")).alias("high_at")))


@query(
    """WITH e AS (SELECT event_type AS symbol, ts::DATE AS d, ts, value AS p, event_id % 7 + 1 AS v FROM events), c AS (SELECT *, sum(p * v) OVER w / sum(v) OVER w AS vwap FROM e WINDOW w AS (PARTITION BY symbol, d ORDER BY ts ROWS UNBOUNDED PRECEDING))
    SELECT symbol, d, round(arg_max(vwap, ts), 6) AS vwap, round(arg_max(p, ts), 6) AS last, arg_max(p, ts) > arg_max(vwap, ts) AS above FROM c GROUP BY 1, 2"""
)
def session_vwap(spark, sf_dir):
    """Volume-weighted price of each session at its end."""
    w = Window.partitionBy("symbol", "d").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("d"), "ts", F.col("value").alias("p"), (F.col("event_id") % 7 + 1).alias("v"))
    e = e.withColumn("vwap", F.sum(F.col("p") * F.col("v")).over(w) / F.sum("v").over(w))
    g = e.groupBy("symbol", "d").agg(F.max_by("vwap", "ts").alias("vwap"), F.max_by("p", "ts").alias("last"))
    return rounded(g.withColumn("above", F.col("last") > F.col("vwap")))


_CDF_SQL = "CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END"


def _cdf_sql(x: str) -> str:
    k = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"((((1.330274429 * {k} + -1.821255978) * {k} + 1.781477937) * {k} + -0.356563782) * {k} + 0.319381530) * {k}"
    return _CDF_SQL.format(x=x, t=f"(exp(-{x} * {x} / 2) / 2.5066282746310002 * ({poly}))")


@query(
    f"""WITH a AS (SELECT p_partkey, p_partkey % 2 = 0 AS is_call, 100.0 + p_size AS spot, 80.0 + p_retailprice % 60 AS strike, p_size / 365.0 AS years, 0.1 AS rate, 0.39 AS sigma FROM part),
    d AS (SELECT *, (ln(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * sqrt(greatest(years, 1e-12))) AS d1 FROM a), e AS (SELECT *, d1 - sigma * sqrt(greatest(years, 1e-12)) AS d2 FROM d)
    SELECT p_partkey, round(CASE WHEN is_call THEN spot * {_cdf_sql("d1")} - strike * exp(-rate * years) * {_cdf_sql("d2")} ELSE strike * exp(-rate * years) * {_cdf_sql("(-d2)")} - spot * {_cdf_sql("(-d1)")} END, 6) AS price FROM e"""
)
def bs_price(spark, sf_dir):
    """Option prices over a chain built from parts."""
    a = _chain(spark, sf_dir)
    return rounded(a.select("p_partkey", numeric.black_scholes(*[F.col(c) for c in ("is_call", "spot", "strike", "years", "rate", "sigma")]).alias("price")))


def _chain(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("is_call"), (100.0 + F.col("p_size")).alias("spot"), (80.0 + F.col("p_retailprice") % 60).alias("strike"), (F.col("p_size") / 365.0).alias("years"), F.lit(0.1).alias("rate"), F.lit(0.39).alias("sigma"))


@query("""SELECT p_partkey, round(100.0 + p_size, 3) AS spot FROM part""")
def implied_spot(spark, sf_dir):
    """The spot found back from its own option price by bisection."""
    return _implied(spark, sf_dir).select("p_partkey", F.round("found", 3).alias("spot"))


@query()
def implied_spot_chain(spark, sf_dir):
    """The same for the whole chain, the shortest expiries too: the bisection's own result,
    and what the option is worth there beside its premium."""
    a = _implied(spark, sf_dir)
    worth = numeric.black_scholes(*[F.col(c) for c in ("is_call", "found", "strike", "years", "rate", "sigma")])
    return a.select("p_partkey", "spot", "premium", F.col("found").alias("implied"), F.when(F.col("found").isNotNull(), worth).alias("worth"))


def _implied(spark, sf_dir) -> DataFrame:
    a = spread(_chain(spark, sf_dir), "p_partkey").withColumn("premium", numeric.black_scholes(*[F.col(c) for c in ("is_call", "spot", "strike", "years", "rate", "sigma")]))
    return a.withColumn("found", numeric.implied_spot(*[F.col(c) for c in ("is_call", "premium", "strike", "years", "rate", "sigma")]))


@query(
    """WITH v AS (SELECT l_partkey, sum(l_quantity) AS vol FROM lineitem GROUP BY 1), s AS (SELECT p_brand, p_partkey % 2 = 0 AS is_call, p_retailprice AS strike, coalesce(vol, 0) AS vol FROM part LEFT JOIN v ON l_partkey = p_partkey)
    SELECT p_brand, round(sum(CASE WHEN is_call THEN vol ELSE 0 END), 4) AS call_vol, round(sum(CASE WHEN is_call THEN 0 ELSE vol END), 4) AS put_vol,
        round(sum(CASE WHEN is_call THEN 0 ELSE vol END) / nullif(sum(CASE WHEN is_call THEN vol ELSE 0 END), 0), 6) AS pcr, arg_max(strike, struct_pack(v := vol, k := strike)) AS top_strike FROM s GROUP BY 1"""
)
def put_call(spark, sf_dir):
    """Put to call volume of each family, and its busiest strike."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("vol"))
    s = table(spark, sf_dir, "part").join(v, "p_partkey", "left").select("p_brand", (F.col("p_partkey") % 2 == 0).alias("is_call"), F.col("p_retailprice").alias("strike"), F.coalesce("vol", F.lit(0.0)).alias("vol"))
    call, put = F.sum(F.when(F.col("is_call"), F.col("vol")).otherwise(0.0)), F.sum(F.when(F.col("is_call"), 0.0).otherwise(F.col("vol")))
    return s.groupBy("p_brand").agg(F.round(call, 4).alias("call_vol"), F.round(put, 4).alias("put_vol"), F.round(F.try_divide(put, F.nullif(call, F.lit(0.0))), 6).alias("pcr"), F.max_by("strike", F.struct("vol", "strike")).alias("top_strike"))


@query(
    """WITH s AS (SELECT p_brand, p_partkey, p_retailprice AS strike, p_size AS dte FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (dte < 10)::INT, CASE WHEN dte >= 10 THEN dte ELSE -dte END, abs(strike - 1200), p_partkey) AS k FROM s)
    SELECT p_brand, p_partkey, strike, dte FROM n WHERE k = 1"""
)
def option_pick(spark, sf_dir):
    """Nearest expiry of at least ten days (else the latest), then the strike nearest to spot."""
    s = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("strike"), F.col("p_size").alias("dte"))
    order = [(F.col("dte") < 10).cast("int"), F.when(F.col("dte") >= 10, F.col("dte")).otherwise(-F.col("dte")), F.abs(F.col("strike") - 1200), F.col("p_partkey")]
    return s.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(*order))).filter("k = 1").drop("k")


_LOTS = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice AS price, o_orderkey % 2 = 0 AS buy, (o_orderkey % 5 + 1) AS qty FROM orders),
    c AS (SELECT *, sum(qty) OVER (PARTITION BY o_custkey, buy ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS hi FROM o),
    m AS (SELECT b.o_custkey, b.o_orderkey AS buy_key, s.o_orderkey AS sell_key, least(b.hi, s.hi) - greatest(b.hi - b.qty, s.hi - s.qty) AS qty, b.price AS bp, s.price AS sp,
            (b.o_orderdate, b.o_orderkey) < (s.o_orderdate, s.o_orderkey) AS long
          FROM c b JOIN c s ON s.o_custkey = b.o_custkey AND b.buy AND NOT s.buy AND b.hi - b.qty < s.hi AND s.hi - s.qty < b.hi)"""


@query(_LOTS + " SELECT o_custkey, buy_key, sell_key, qty::BIGINT AS qty, long, round((sp - bp) * qty, 2) AS pnl FROM m")
def lot_fifo(spark, sf_dir):
    """First-in first-out lots: the k-th unit bought meets the k-th unit sold, which is the
    overlap of two intervals of cumulative quantity."""
    from ..operators.fifo import matched

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("trade"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 2 == 0).alias("buy"), (F.col("o_orderkey") % 5 + 1).alias("qty"))
    m = matched(o)
    return m.select(F.col("asset").alias("o_custkey"), F.col("buy_trade").alias("buy_key"), F.col("sell_trade").alias("sell_key"), "qty", "long", F.round((F.col("sell_price") - F.col("buy_price")) * F.col("qty"), 2).alias("pnl"))


@query(
    """WITH d AS (SELECT l_partkey, l_shipdate::DATE AS ts, avg(l_extendedprice / l_quantity) AS px FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY ts) AS i FROM d),
    p AS (SELECT a.l_partkey, a.ts, b.px / a.px AS mult, b.ts AS until FROM n a JOIN n b ON b.l_partkey = a.l_partkey AND b.i > a.i AND b.i <= a.i + 7 AND b.ts <= a.ts + INTERVAL 60 DAY),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY round(mult, 9) DESC, ts, until) AS r FROM p)
    SELECT l_partkey, ts, until, round(mult, 6) AS mult FROM k WHERE r = 1"""
)
def movers(spark, sf_dir):
    """Best multiple of each part within seven rows and sixty days."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("ts")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    ahead = F.collect_list(F.struct(F.col("ts").alias("until"), F.col("px").alias("later"))).over(Window.partitionBy("l_partkey").orderBy("ts").rowsBetween(1, 7))
    p = d.withColumn("ahead", ahead).select("l_partkey", "ts", "px", F.explode("ahead").alias("x")).filter(F.col("x.until") <= F.date_add("ts", 60)).select("l_partkey", "ts", F.col("x.until").alias("until"), (F.col("x.later") / F.col("px")).alias("mult"))
    best = Window.partitionBy("l_partkey").orderBy(F.desc(F.round("mult", 9)), "ts", "until")
    return rounded(p.withColumn("r", F.row_number().over(best)).filter("r = 1").select("l_partkey", "ts", "until", "mult"))


@query(
    """WITH s AS (SELECT n_name, r_name, s_acctbal, least(greatest(s_acctbal / 100, -100), 100) AS score FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    g AS (SELECT r_name, n_name, avg(score) AS score, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT r_name, count(*) AS members, round(avg(score), 6) AS mean_score, sum((score >= 30)::INT)::BIGINT AS strong, string_agg(n_name, ',' ORDER BY score DESC, n_name) AS ordered FROM g GROUP BY 1"""
)
def sector_rollup(spark, sf_dir):
    """Mean score of each group, how many are strong, and its members in order."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    g = s.groupBy("r_name", "n_name").agg(F.avg(numeric.clip(F.col("s_acctbal") / 100)).alias("score"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "n_name"))), lambda x: x["n_name"]), ",")
    return rounded(g.groupBy("r_name").agg(F.count("*").alias("members"), F.avg("score").alias("mean_score"), F.sum((F.col("score") >= 30).cast("int")).alias("strong"), names.alias("ordered")))


@query(
    f"""WITH {BARS}, f AS (SELECT symbol, ts, close, {rolled("avg", "close", 50)} AS s50, {rolled("avg", "close", 200)} AS s200, (close / lag(close, 21) {W} - 1) * 100 AS m1, {rolled("min", "low", 21)} AS lo1, {rolled("max", "high", 21)} AS hi1, {rolled("min", "low", 252)} AS lo12, {rolled("max", "high", 252)} AS hi12 FROM b),
    h AS (SELECT *, (close / s200 - 1) * 100 AS d200, CASE WHEN hi1 > lo1 THEN round_even((close - lo1) / (hi1 - lo1) * 100, 0)::DOUBLE END AS pm, CASE WHEN hi12 > lo12 THEN round_even((close - lo12) / (hi12 - lo12) * 100, 0)::DOUBLE END AS py FROM f WHERE s200 IS NOT NULL),
    t AS (SELECT *, least(greatest((CASE WHEN close > s50 AND s50 > s200 THEN 40.0 WHEN close < s50 AND s50 < s200 THEN -40.0 WHEN close > s200 THEN 15.0 ELSE -15.0 END) + least(greatest(coalesce(m1, 0) * 3, -25), 25) + CASE WHEN d200 > 30 THEN -15.0 ELSE 0 END, -100), 100) AS score,
        (coalesce(0.4 * (pm * 2 - 100), 0) + coalesce(0.25 * (py * 2 - 100), 0) + 0.15 * least(greatest(d200 * 3, -100), 100)) / ((CASE WHEN pm IS NULL THEN 0 ELSE 0.4 END) + (CASE WHEN py IS NULL THEN 0 ELSE 0.25 END) + 0.15) AS val FROM h),
    l AS (SELECT symbol, ts, score, val, CASE WHEN score >= 30 THEN 'ALTA' WHEN score <= -30 THEN 'BAIXA' ELSE 'NEUTRO' END AS trend, CASE WHEN val >= 25 THEN 'CARO' WHEN val > -25 THEN 'JUSTO' ELSE 'BARATO' END AS tag FROM t)
    SELECT symbol, ts, round(score, 6) AS score, round(val, 6) AS val, trend, tag, CASE trend || tag {" ".join(f"WHEN '{a}{b}' THEN '{s}'" for (a, b), s in numeric.SIGNALS.items())} END AS signal FROM l"""
)
def score_matrix(spark, sf_dir):
    """Technical score, valuation and the combined signal of every bar."""
    c = F.col("close")
    df = daily_bars(spark, sf_dir).select(
        "symbol", "ts", "close", series.rolling(F.avg, c, 50).alias("s50"), series.rolling(F.avg, c, 200).alias("s200"), (series.change(c, 21) * 100).alias("m1"),
        *[series.rolling(f, F.col(x), n).alias(a) for f, x, n, a in ((F.min, "low", 21, "lo1"), (F.max, "high", 21, "hi1"), (F.min, "low", 252, "lo12"), (F.max, "high", 252, "hi12"))],
    ).filter("s200 is not null")
    df = df.withColumn("d200", (c / F.col("s200") - 1) * 100)
    score = numeric.technical_score(c, F.col("s50"), F.col("s200"), F.lit(None).cast("double"), F.col("m1"), F.col("d200"))
    val = numeric.valuation_score(numeric.place_in_range(c, F.col("lo1"), F.col("hi1")), numeric.place_in_range(c, F.col("lo12"), F.col("hi12")), F.lit(None).cast("double"), F.col("d200"))
    df = df.select("symbol", "ts", score.alias("score"), val.alias("val")).withColumn("trend", numeric.trend_label(F.col("score"))).withColumn("tag", numeric.valuation_tag(F.col("val")))
    return rounded(df.withColumn("signal", numeric.signal(F.col("trend"), F.col("tag"))))
