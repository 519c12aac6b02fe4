"""Queries that rank: short lists, orders over several keys, as-of features, kept views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, similar
from ..operators import asof, orderstats, series, views
from ..operators.identity import top_of_each
from ..operators.ordered import checkpoint_dir, running
from ..operators.toplists import TopList, top_lists
from . import market
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


#: Trades of each part: first, last and mean price, and the flow of quantities by the sign of their discount.
_INSTRUMENTS = """t AS (SELECT l_partkey AS k, l_extendedprice / l_quantity AS p, l_quantity * sign(l_discount - 0.05) AS f, l_shipdate AS d, l_orderkey AS o, l_linenumber AS n FROM lineitem),
    i AS (SELECT k, arg_min(p, struct_pack(d := d, o := o, n := n, p := p)) AS first, arg_max(p, struct_pack(d := d, o := o, n := n, p := p)) AS last, round(avg(p), 6) AS mean, round(sum(f), 6) AS flow, count(*) AS trades FROM t GROUP BY k),
    s AS (SELECT k, round(100 * (last / first - 1), 6) AS change, round(100 * (last / mean - 1), 6) AS stretch, flow, trades FROM i)"""


def _instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), (F.col("l_quantity") * F.signum(F.col("l_discount") - 0.05)).alias("f"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p")).alias("o"))
    i = t.groupBy("k").agg(F.min_by("p", "o").alias("first"), F.max_by("p", "o").alias("last"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.sum("f"), 6).alias("flow"), F.count("*").alias("trades"))
    return i.select("k", F.round(100 * (F.col("last") / F.col("first") - 1), 6).alias("change"), F.round(100 * (F.col("last") / F.col("mean") - 1), 6).alias("stretch"), "flow", "trades")


def _list_sql(name: str, score: str, order: str, where: str = "true") -> str:
    return f"SELECT '{name}' AS list, row_number() OVER (ORDER BY {score} {order}, k) AS place, k, {score} AS score FROM s WHERE {where} QUALIFY place <= 5"


@query(
    f"WITH {_INSTRUMENTS}, l AS ("
    + " UNION ALL ".join([_list_sql("best", "change", "DESC"), _list_sql("worst", "change", ""), _list_sql("stretched", "stretch", "DESC"), _list_sql("cheap", "stretch", ""), _list_sql("inflow", "flow", "DESC", "trades >= 3")])
    + ") SELECT list, place::INTEGER AS place, k, round(score, 4)::DOUBLE AS score FROM l"
)
def highlights(spark, sf_dir):
    """Five lists of five instruments from one pass: gains, losses, dearest and cheapest against
    their mean, and the largest inflow."""
    lists = [TopList("best", F.col("change")), TopList("worst", F.col("change"), least=True), TopList("stretched", F.col("stretch")), TopList("cheap", F.col("stretch"), least=True), TopList("inflow", F.col("flow"), where=F.col("trades") >= 3)]
    return rounded(top_lists(_instruments(spark, sf_dir), "k", lists), 4)


@query(
    f"""WITH {_INSTRUMENTS}, a AS (SELECT k, CASE WHEN sign(stretch) = sign(flow) THEN 0 WHEN flow = 0 THEN 1 ELSE 2 END AS class, abs(stretch) AS conviction, round(-change, 6) AS elasticity FROM s)
    SELECT k, class::INTEGER AS class, row_number() OVER (ORDER BY class, conviction DESC, elasticity DESC, k) AS place FROM a"""
)
def setup_radar(spark, sf_dir):
    """All setups in order: those whose signals agree, then those that wait, then by conviction and
    elasticity.  The order runs through ranges, not through one task."""
    s = _instruments(spark, sf_dir)
    agree = F.when(F.signum("stretch") == F.signum("flow"), 0).when(F.col("flow") == 0, 1).otherwise(2)
    a = s.select("k", agree.alias("class"), (-F.abs("stretch")).alias("c"), F.round("change", 6).alias("e"))
    return running(a, ["class", "c", "e", "k"], out="place").select("k", "class", "place")


@query(
    """WITH d AS (SELECT event_type || '-' || user_id % 4 AS symbol, ts::DATE AS d, avg(value) AS v FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS i FROM d),
    c AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.v, b.v), 6) AS corr FROM n a JOIN n b ON a.i = b.i AND a.symbol < b.symbol WHERE a.i <= 90 GROUP BY ALL HAVING count(*) >= 20)
    SELECT a, b, n, corr, (row_number() OVER (ORDER BY abs(corr) DESC, a, b))::INTEGER AS place FROM c WHERE NOT isnan(corr) QUALIFY place <= 14"""
)
def correlated_series(spark, sf_dir):
    """The fourteen pairs of series with the largest correlation over their last ninety values,
    aligned from the end.  The series are a universe of named instruments, so their pairs are few."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string")).alias("symbol"), F.to_date("ts").alias("d"), "value")
    n = top_of_each(e.groupBy("symbol", "d").agg(F.avg("value").alias("v")), ["symbol"], [F.desc("d")], 90)
    a, b = n.select(F.col("symbol").alias("a"), F.col("v").alias("x"), "place"), n.select(F.col("symbol").alias("b"), F.col("v").alias("y"), "place")
    c = a.join(b, "place").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("corr")).filter("n >= 20 and corr is not null and not isnan(corr)")
    return top_of_each(c.withColumn("all", F.lit(0)), ["all"], [F.desc(F.abs("corr")), F.col("a"), F.col("b")], 14).drop("all")


@query(
    """WITH p AS (SELECT event_type AS symbol, ts::DATE AS d, ts, value, value - lag(value) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts) AS step FROM events),
    e AS (SELECT symbol, d, round(abs(arg_max(value, ts) - arg_min(value, ts)) / nullif(sum(abs(step)), 0), 6) AS score FROM p GROUP BY 1, 2), k AS (SELECT * FROM e WHERE score IS NOT NULL)
    SELECT symbol, 'restless' AS list, row_number() OVER (PARTITION BY symbol ORDER BY score, d)::INTEGER AS place, d, score FROM k QUALIFY place <= 5
    UNION ALL SELECT symbol, 'straight' AS list, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, d)::INTEGER AS place, d, score FROM k QUALIFY place <= 5"""
)
def session_extremes(spark, sf_dir):
    """The five least and the five most efficient sessions of each symbol."""
    lists = [TopList("restless", F.col("efficiency"), least=True), TopList("straight", F.col("efficiency"))]
    return top_lists(market.session_efficiency(spark, sf_dir), "d", lists, ["symbol"])


@query(
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS click_ts, event_id AS click_id, value AS click_value FROM events WHERE event_type = 'click')
    SELECT p.event_id, CASE WHEN date_diff('microsecond', click_ts, p.ts) <= 172800000000 THEN click_id END AS click_id, CASE WHEN date_diff('microsecond', click_ts, p.ts) <= 172800000000 THEN round(click_value, 6) END AS click_value
    FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.click_ts"""
)
def attributed_purchases(spark, sf_dir):
    """Every purchase with the same user's latest click before it, if that is at most two days old."""
    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    found = asof.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["click_id", "click_value"], 2 * 86400)
    return rounded(found.select("event_id", "click_id", "click_value"))


@query(
    """WITH p AS (SELECT p_partkey, 100.0 + p_size AS spot, p_size / 365.0 AS years FROM part WHERE p_size >= 5)
    SELECT p_partkey, round(0.15 + (p_partkey % 50) / 100.0, 4)::DOUBLE AS sigma FROM p"""
)
def implied_volatilities(spark, sf_dir):
    """The volatility found back from each option's price, near the money."""
    p = table(spark, sf_dir, "part").filter("p_size >= 5").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("call"), (100.0 + F.col("p_size")).alias("spot"), (F.col("p_size") / 365.0).alias("years"), (0.15 + (F.col("p_partkey") % 50) / 100.0).alias("sigma"))
    args = [F.col("spot"), F.col("spot") * 1.01, F.col("years"), F.lit(0.1)]
    p = spread(p, "p_partkey").withColumn("premium", numeric.black_scholes(F.col("call"), *args, F.col("sigma")))
    return p.select("p_partkey", F.round(numeric.implied_volatility(F.col("call"), F.col("premium"), *args), 4).alias("sigma"))


@query(
    """WITH f AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 5 NOT IN (2, 4) UNION ALL SELECT conv_id, turn, text || '!' FROM conversations WHERE turn % 5 = 2 UNION ALL SELECT page_id, 1000, url FROM pages)
    SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars, min(turn)::BIGINT AS first_turn, min(text) AS least_text, max(turn)::BIGINT AS last_turn FROM f GROUP BY conv_id"""
)
def catalogue_refresh(spark, sf_dir):
    """A catalogue of conversations that is kept up to date: it is built, then some turns go, some
    change and others come; only the buckets of changed keys are written again."""
    checkpoint_dir(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    view = views.View(["conv_id"], {"chars": "length(text)"}, {"first_turn": "turn", "least_text": "text"}, {"last_turn": "turn"})
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), F.lit(1000).cast("long").alias("turn"), F.col("url").alias("text"))
    added = c.filter("turn % 5 = 2").withColumn("text", F.concat("text", F.lit("!"))).unionByName(pages)
    base = c.filter("turn % 5 not in (2, 4)").unionByName(added)
    root = f"{spark.sparkContext.getCheckpointDir()}/catalogue-{uuid.uuid4().hex}"
    views.create(view, c, root)
    views.refresh(view, c.filter("turn % 5 in (2, 4)"), added, base, root)
    return views.current(spark, view, base, root)


@query()
def title_suspects(spark, sf_dir):
    """Pages in the order in which their titles are unlike the first line of their text."""
    first = F.regexp_extract("html", r"(?s)<p[^>]*>\s*([^\n<]*)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), first.alias("line"))
    p = p.withColumn("likeness", F.round(similar.likeness(F.col("title"), F.col("line")), 6))
    return running(p, ["likeness", "page_id"], out="place").select("page_id", "title", "line", "likeness", "place")


@query(
    f"""WITH {BARS}, w AS (SELECT symbol, ts, close, count(*) OVER f AS n, quantile_cont(close, 0.8) OVER f AS q80, quantile_cont(close, 0.25) OVER f AS q25, list(close) OVER f AS xs FROM b WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, CASE WHEN n = 60 THEN round(len(list_filter(xs, lambda x: x <= close)) / 60.0, 6)::DOUBLE END AS rank, CASE WHEN n = 60 THEN round(q80, 6) END AS q80, CASE WHEN n = 60 THEN round(q25, 6) END AS q25 FROM w"""
)
def rolling_ranks(spark, sf_dir):
    """The place of each close among its last sixty, and their quantiles."""
    found = orderstats.rolling_order(daily_bars(spark, sf_dir).select("symbol", "ts", "close"), "close", 60, {"q80": 0.8, "q25": 0.25})
    return rounded(found.select("symbol", "ts", "rank", "q80", "q25"))


@query(
    f"""WITH {BARS}, f AS (SELECT symbol, ts, close, row_number() {market.W} AS i, avg(close) OVER s AS m60, stddev_pop(close) OVER s AS d60, close / lag(close, 5) {market.W} - 1 AS m5, close / lag(close, 20) {market.W} - 1 AS m20, max(close) OVER y AS hi, min(close) OVER y AS lo,
            {rolled("avg", "close", 50)} AS sma50, {rolled("avg", "close", 200)} AS sma200, quantile_cont(volume, 0.9) OVER s AS v90, count(*) OVER s AS n60, volume FROM b
        WINDOW s AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), y AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
    z AS (SELECT *, round((close - m60) / (d60 + 1e-9), 6) AS z FROM f WHERE i >= 30),
    l AS (SELECT symbol, ts, list_filter([CASE WHEN z > 2 THEN 'anomaly above' WHEN z < -2 THEN 'anomaly below' END, CASE WHEN m5 > 0.03 AND m20 > 0.05 THEN 'momentum up' WHEN m5 < -0.03 AND m20 < -0.05 THEN 'momentum down' END,
        CASE WHEN n60 = 60 AND volume > v90 THEN 'volume above percentile 90' END, CASE WHEN i >= 120 THEN CASE WHEN close >= hi * 0.99 THEN 'year high' WHEN close <= lo * 1.01 THEN 'year low' END END,
        CASE WHEN close > sma50 AND sma50 > sma200 THEN 'above averages' WHEN close < sma50 AND sma50 < sma200 THEN 'below averages' END], lambda x: x IS NOT NULL) AS ls FROM z)
    SELECT symbol, ts, array_to_string(ls[1:4], '; ') AS labels FROM l WHERE len(ls) > 0"""
)
def series_patterns(spark, sf_dir):
    """The patterns of every bar, the first four that hold: anomaly, momentum, volume beyond its
    percentile, extremes of the year, and the stack of averages."""
    c, s = F.col("close"), series.series()
    last = lambda f, n: f.over(s.rowsBetween(1 - n, 0))
    f = daily_bars(spark, sf_dir).select(
        "symbol", "ts", "close", "volume", F.row_number().over(s).alias("i"), last(F.avg(c), 60).alias("m60"), last(F.stddev_pop(c), 60).alias("d60"), series.change(c, 5).alias("m5"), series.change(c, 20).alias("m20"),
        last(F.max(c), 252).alias("hi"), last(F.min(c), 252).alias("lo"), series.rolling(F.avg, c, 50).alias("sma50"), series.rolling(F.avg, c, 200).alias("sma200"),
    )
    f = orderstats.rolling_order(f, "volume", 60, {"v90": 0.9}).filter("i >= 30")
    z = F.round((c - F.col("m60")) / (F.col("d60") + 1e-9), 6)
    labels = F.array_compact(
        F.array(
            F.when(z > 2, "anomaly above").when(z < -2, "anomaly below"),
            F.when((F.col("m5") > 0.03) & (F.col("m20") > 0.05), "momentum up").when((F.col("m5") < -0.03) & (F.col("m20") < -0.05), "momentum down"),
            F.when(F.col("volume") > F.col("v90"), "volume above percentile 90"),
            F.when(F.col("i") >= 120, F.when(c >= F.col("hi") * 0.99, "year high").when(c <= F.col("lo") * 1.01, "year low")),
            F.when((c > F.col("sma50")) & (F.col("sma50") > F.col("sma200")), "above averages").when((c < F.col("sma50")) & (F.col("sma50") < F.col("sma200")), "below averages"),
        )
    )
    return f.select("symbol", "ts", F.array_join(F.slice(labels, 1, 4), "; ").alias("labels")).filter("labels <> ''")


@query(
    f"""WITH {BARS}, g AS (SELECT symbol, ts, close - lag(close) {market.W} AS dd FROM b), n AS (SELECT symbol, ts, greatest(dd, 0) AS up, greatest(-dd, 0) AS down, row_number() {market.W} - 1 AS i FROM g WHERE dd IS NOT NULL),
    {market._ema_sql("up", "(1.0/14)", "au", "n", "e1")}, {market._ema_sql("down", "(1.0/14)", "ad", "e1", "e2")},
    o AS (SELECT symbol, ts, CASE WHEN ad = 0 THEN CASE WHEN au = 0 THEN NULL ELSE 100 END ELSE 100 - 100 / (1 + au / ad) END AS rsi FROM e2),
    t AS (SELECT *, (high + low + close) / 3 AS tp FROM b), r AS (SELECT *, coalesce(tp > lag(tp) {market.W}, false) AS rose FROM t), q AS (SELECT *, CASE WHEN rose THEN tp * volume ELSE 0 END AS fi, CASE WHEN rose THEN 0 ELSE tp * volume END AS fo FROM r),
    m AS (SELECT symbol, ts, close, row_number() {market.W} AS i, {rolled("sum", "fi", 14)} AS si, {rolled("sum", "fo", 14)} AS so, {rolled("avg", "close", 20)} AS sma20, {rolled("avg", "close", 50)} AS sma50, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS sma200,
        round((close / lag(close, 21) {market.W} - 1) * 100, 6) AS month FROM q),
    s AS (SELECT m.symbol, m.ts, CASE WHEN close > sma50 AND sma50 > sma200 THEN 40 WHEN close < sma50 AND sma50 < sma200 THEN -40 WHEN close > sma200 THEN 15 ELSE -15 END + CASE WHEN close > sma20 THEN 18 ELSE -18 END + least(greatest(coalesce(month, 0) * 3, -18), 18)
        + CASE WHEN rsi > 72 THEN -12 WHEN rsi < 28 THEN 12 ELSE 0 END + CASE WHEN so > 0 THEN least(greatest((100 - 100 / (1 + si / so) - 50) * 0.5, -12), 12) ELSE 0 END AS score FROM m LEFT JOIN o ON o.symbol = m.symbol AND o.ts = m.ts WHERE i >= 60),
    k AS (SELECT symbol, ts, round(least(greatest(score, -100), 100), 4) AS score FROM s)
    SELECT symbol, ts, score::DOUBLE AS score, CASE WHEN score >= 30 THEN 'up' WHEN score <= -30 THEN 'down' ELSE 'neutral' END AS regime FROM k"""
)
def index_regime(spark, sf_dir):
    """Score and regime of an index on every day: averages, momentum, oscillator and money flow."""
    c, s = F.col("close"), series.series()
    f = series.rsi(series.mfi(daily_bars(spark, sf_dir)))
    f = f.withColumns({"i": F.row_number().over(s), "sma20": series.rolling(F.avg, c, 20), "sma50": series.rolling(F.avg, c, 50), "sma200": F.avg(c).over(s.rowsBetween(-199, 0)), "month": F.round(series.change(c, 21) * 100, 6)})
    score = numeric.index_score(c, F.col("sma20"), F.col("sma50"), F.col("sma200"), F.col("month"), F.col("rsi"), F.col("mfi"))
    k = f.filter("i >= 60").select("symbol", "ts", F.round(score, 4).alias("score"))
    return k.withColumn("regime", F.when(F.col("score") >= 30, "up").when(F.col("score") <= -30, "down").otherwise("neutral"))
