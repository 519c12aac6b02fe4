"""Further queries: calendars, forecasts, option scenarios, panels and resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normaliser, numeric, text
from ..operators import inference, series
from ..operators.ordered import running
from ..streaming import ingest
from .common import BARS, daily_bars, rolled, rounded, table
from .market import _cdf_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = "OVER (PARTITION BY symbol ORDER BY ts)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Counts and means by six-hour windows; the same function serves streams."""
    return rounded(ingest.windowed(table(spark, sf_dir, "events"), "6 hours"))


@query(
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, k"""
)
def user_sessions(spark, sf_dir):
    """Sessions that end after eight hours of silence."""
    e = table(spark, sf_dir, "events").withColumn("fresh", F.coalesce(F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts")) > F.expr("INTERVAL 8 HOURS"), F.lit(True)).cast("int"))
    k = F.sum("fresh").over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("k", k).groupBy("user_id", "k").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("k")


_LEVELS = (0.236, 0.382, 0.5, 0.618, 0.786)


@query(
    f"""WITH {BARS}, r AS (SELECT symbol, max(high) AS hi, min(low) AS lo FROM b WHERE ts >= DATE '2000-01-01' GROUP BY symbol), l AS (SELECT unnest([{", ".join(map(str, _LEVELS))}])::DOUBLE AS level)
    SELECT symbol, level, round(hi - (hi - lo) * level, 6) AS price FROM r, l"""
)
def retracements(spark, sf_dir):
    """Retracement levels of each symbol's range since a date."""
    r = daily_bars(spark, sf_dir).filter("ts >= date'2000-01-01'").groupBy("symbol").agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    return rounded(r.select("symbol", "hi", "lo", F.explode(F.array(*[F.lit(x) for x in _LEVELS])).alias("level")).select("symbol", "level", (F.col("hi") - (F.col("hi") - F.col("lo")) * F.col("level")).alias("price")))


@query(
    f"""WITH {BARS}, e AS (SELECT symbol, max(ts) AS ts FROM b GROUP BY symbol), d AS (SELECT symbol, unnest(generate_series(ts + 1, ts + 40, INTERVAL 1 DAY))::DATE AS day FROM (SELECT symbol, ts::DATE AS ts FROM e)),
    k AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS step FROM d WHERE isodow(day) <= 5) SELECT symbol, day, step::INTEGER AS step FROM k WHERE step <= 21"""
)
def weekdays_ahead(spark, sf_dir):
    """The next twenty-one weekdays after each symbol's last bar."""
    last = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("ts"))
    days = last.select("symbol", F.explode(F.sequence(F.date_add("ts", 1), F.date_add("ts", 40))).alias("day")).filter(F.weekday("day") < 5)
    return days.withColumn("step", F.row_number().over(Window.partitionBy("symbol").orderBy("day"))).filter("step <= 21")


@query(
    f"""WITH {BARS}, k AS (SELECT symbol, ts, close, close / lag(close) {W} - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM b),
    s AS (SELECT symbol, regr_slope(close, 60 - n) AS slope, stddev_samp(r) AS sd, arg_min(close, n) AS last FROM k WHERE n <= 60 GROUP BY symbol), h AS (SELECT unnest(generate_series(1, 21)) AS step)
    SELECT symbol, step::INTEGER AS step, round(last + least(greatest(0.5 * slope * step, -2 * sd * sqrt(step) * last), 2 * sd * sqrt(step) * last), 6) AS mid, round(1.28 * sd * sqrt(step) * last, 6) AS band FROM s, h"""
)
def forecast_bands(spark, sf_dir):
    """Half the recent slope, bounded by two deviations, with a widening band."""
    k = daily_bars(spark, sf_dir).withColumn("r", series.change(F.col("close"))).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter("n <= 60")
    s = k.groupBy("symbol").agg(F.regr_slope("close", 60 - F.col("n")).alias("slope"), F.stddev_samp("r").alias("sd"), F.min_by("close", "n").alias("last"))
    s = s.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(21))))
    wide = 2 * F.col("sd") * F.sqrt("step") * F.col("last")
    return rounded(s.select("symbol", "step", (F.col("last") + F.least(F.greatest(0.5 * F.col("slope") * F.col("step"), -wide), wide)).alias("mid"), (1.28 * F.col("sd") * F.sqrt("step") * F.col("last")).alias("band")))


@query(
    """WITH q AS (SELECT o_orderstatus AS unit, date_trunc('quarter', o_orderdate)::DATE AS q, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
    t AS (SELECT unit, q, v, CASE WHEN count(v) OVER w = 4 THEN sum(v) OVER w END AS ttm, v / lag(v, 4) OVER (PARTITION BY unit ORDER BY q) - 1 AS yoy FROM q WINDOW w AS (PARTITION BY unit ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT unit, year(q)::VARCHAR || 'T' || quarter(q)::VARCHAR AS label, round(ttm, 2) AS ttm, round(yoy, 6) AS yoy FROM t"""
)
def trailing_year(spark, sf_dir):
    """Trailing four quarters and the change on the year before."""
    q = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("unit"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("q")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("unit").orderBy("q")
    label = F.concat(F.year("q").cast("string"), F.lit("T"), F.quarter("q").cast("string"))
    return q.select("unit", label.alias("label"), F.round(series.rolling(F.sum, F.col("v"), 4, w), 2).alias("ttm"), F.round(series.change(F.col("v"), 4, w), 6).alias("yoy"))


@query(
    f"""WITH {BARS}, m AS (SELECT symbol, date_trunc('month', ts)::DATE AS month, arg_max(close, ts) AS last FROM b GROUP BY 1, 2), r AS (SELECT symbol, month AS ts, last / lag(last) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM m)
    SELECT symbol, ts AS month, round(CASE WHEN count(r) OVER w = 12 THEN exp(sum(ln(1 + r)) OVER w) - 1 END, 6) AS year_return FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
)
def compounded(spark, sf_dir):
    """Twelve monthly returns compounded."""
    m = daily_bars(spark, sf_dir).groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(F.max_by("close", "ts").alias("last"))
    w = Window.partitionBy("symbol").orderBy("month")
    m = m.withColumn("r", series.change(F.col("last"), 1, w))
    return rounded(m.select("symbol", "month", (F.exp(series.rolling(F.sum, F.ln(1 + F.col("r")), 12, w)) - 1).alias("year_return")))


@query(
    """WITH d AS (SELECT event_type AS route, ts::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY day DESC) AS i FROM d),
    a AS (SELECT route, avg(n) FILTER (WHERE i <= 7) AS d7, avg(n) FILTER (WHERE i <= 30) AS d30 FROM k GROUP BY route)
    SELECT route, round(d7, 6) AS d7, round(d30, 6) AS d30, round((d7 / d30 - 1) * 100, 6) AS deviation, CASE WHEN (d7 / d30 - 1) * 100 <= -25 THEN 'disrupted' WHEN (d7 / d30 - 1) * 100 >= 20 THEN 'busy' ELSE 'normal' END AS status FROM a"""
)
def route_deviation(spark, sf_dir):
    """The last week's mean against the last month's."""
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    k = d.withColumn("i", F.row_number().over(Window.partitionBy("route").orderBy(F.desc("day"))))
    a = k.groupBy("route").agg(F.avg(F.when(F.col("i") <= 7, F.col("n"))).alias("d7"), F.avg(F.when(F.col("i") <= 30, F.col("n"))).alias("d30")).withColumn("deviation", (F.col("d7") / F.col("d30") - 1) * 100)
    return rounded(a.withColumn("status", F.when(F.col("deviation") <= -25, "disrupted").when(F.col("deviation") >= 20, "busy").otherwise("normal")))


_CHAIN = """c AS (SELECT n_nationkey AS asset, 100.0 + n_nationkey AS spot, unnest(generate_series(82, 128, 2)) AS pct FROM nation), k AS (SELECT asset, spot, spot * pct / 100.0 AS strike, 0.1 AS years, 0.1 AS rate, 0.39 AS sigma FROM c),
    d AS (SELECT *, (ln(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * sqrt(years)) AS d1 FROM k), e AS (SELECT *, d1 - sigma * sqrt(years) AS d2 FROM d)"""


@query(
    f"""WITH {_CHAIN}, p AS (SELECT asset, strike, spot, spot * {_cdf_sql("d1")} - strike * exp(-rate * years) * {_cdf_sql("d2")} AS premium FROM e)
    SELECT asset, round(strike, 6) AS strike, round(premium, 6) AS premium, round(strike + premium, 6) AS break_even, CASE WHEN strike < spot * 0.98 THEN 'ITM' WHEN strike > spot * 1.02 THEN 'OTM' ELSE 'ATM' END AS moneyness FROM p"""
)
def theoretical_chain(spark, sf_dir):
    """A chain of call prices around each spot with break-evens."""
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("asset"), (100.0 + F.col("n_nationkey")).alias("spot"), F.explode(F.sequence(F.lit(82), F.lit(128), F.lit(2))).alias("pct")).withColumn("strike", F.col("spot") * F.col("pct") / 100.0)
    premium = numeric.black_scholes(F.lit(True), F.col("spot"), F.col("strike"), F.lit(0.1), F.lit(0.1), F.lit(0.39))
    kind = F.when(F.col("strike") < F.col("spot") * 0.98, "ITM").when(F.col("strike") > F.col("spot") * 1.02, "OTM").otherwise("ATM")
    return rounded(k.withColumn("premium", premium).select("asset", "strike", "premium", (F.col("strike") + F.col("premium")).alias("break_even"), kind.alias("moneyness")))


@query(
    """WITH s AS (SELECT n_nationkey AS asset, 100.0 + n_nationkey AS spot, unnest(generate_series(0, 240)) AS i FROM nation), p AS (SELECT asset, i, greatest(spot * (0.88 + i * 0.001) - spot, 0) AS pnl, spot FROM s)
    SELECT asset, min(i) AS step, round(min(0.88 + i * 0.001) - 1, 6) AS move FROM p WHERE round(pnl, 6) >= round(spot * 0.05, 6) GROUP BY asset"""
)
def required_move(spark, sf_dir):
    """The first of 241 steps at which a position reaches its target, found in one expression."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("asset"), (100.0 + F.col("n_nationkey")).alias("spot"))
    hits = F.filter(F.sequence(F.lit(0), F.lit(240)), lambda i: F.round(F.greatest(F.col("spot") * (0.88 + i * 0.001) - F.col("spot"), F.lit(0.0)), 6) >= F.round(F.col("spot") * 0.05, 6))
    return n.select("asset", F.array_min(hits).cast("long").alias("step")).withColumn("move", F.round(0.88 + F.col("step") * 0.001 - 1, 6))


@query(
    """SELECT p_partkey, floor(1000 / nullif(p_retailprice * 0.02 * 10, 0))::BIGINT AS by_risk, least(floor(1000 / nullif(p_retailprice * 0.02 * 10, 0)), floor(20000 / (p_retailprice * 10)))::BIGINT AS lots FROM part"""
)
def position_size(spark, sf_dir):
    """Lots by risk, bounded by capital."""
    price = F.col("p_retailprice")
    by_risk = F.floor(F.try_divide(F.lit(1000.0), price * 0.02 * 10))
    return table(spark, sf_dir, "part").select("p_partkey", by_risk.alias("by_risk"), F.least(by_risk, F.floor(20000 / (price * 10))).alias("lots"))


@query(
    """WITH f AS (SELECT n_name, sum(s_acctbal) AS ebitda FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1), g AS (SELECT * FROM (VALUES ('low', 0.8), ('base', 1.0), ('high', 1.2)) a(scenario, factor), (VALUES (3.0), (4.0), (5.0)) m(multiple))
    SELECT n_name, scenario, multiple::DOUBLE AS multiple, round(ebitda * factor * multiple, 2) AS value FROM f, g"""
)
def fair_value_grid(spark, sf_dir):
    """Value by scenario and multiple: nine literals for each row."""
    f = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.sum("s_acctbal").alias("ebitda"))
    grid = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(x).alias("factor"), F.lit(m).alias("multiple")) for s, x in (("low", 0.8), ("base", 1.0), ("high", 1.2)) for m in (3.0, 4.0, 5.0)])
    return f.select("n_name", "ebitda", F.inline(grid)).select("n_name", "scenario", "multiple", F.round(F.col("ebitda") * F.col("factor") * F.col("multiple"), 2).alias("value"))


@query("WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark) SELECT item_id, ((k - 33 % n + n) % n)::BIGINT AS place FROM n WHERE (k - 33 % n + n) % n < 12")
def rotating_slice(spark, sf_dir):
    """Twelve items from an offset on, around the end."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    n = b.count()
    return running(b, ["item_id"]).select("item_id", F.pmod(F.col("_n") - 1 - 33, F.lit(n)).cast("long").alias("place")).filter("place < 12")


@query(
    """WITH f AS (SELECT l_returnflag AS category, CASE WHEN l_discount > 0.07 THEN 2 WHEN l_discount > 0.04 THEN 1 WHEN l_discount < 0.02 THEN -1 ELSE 0 END AS s, 1 + l_linenumber % 3 AS w FROM lineitem)
    SELECT category, sum(s * w)::BIGINT AS points, round(100.0 * sum(s * w) / sum(2 * w), 6) AS score FROM f GROUP BY ROLLUP (category)"""
)
def category_scores(spark, sf_dir):
    """Weighted factor scores by category and in total."""
    d = F.col("l_discount")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.when(d > 0.07, 2).when(d > 0.04, 1).when(d < 0.02, -1).otherwise(0).alias("s"), (1 + F.col("l_linenumber") % 3).alias("w"))
    return f.rollup("category").agg(F.sum(F.col("s") * F.col("w")).alias("points"), F.round(100.0 * F.sum(F.col("s") * F.col("w")) / F.sum(2 * F.col("w")), 6).alias("score"))


_WORDS = ["PROMO", "SMALL", "LARGE", "STANDARD"]


@query(
    f"""WITH k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(_WORDS))}) v(ord, word)), h AS (SELECT p_brand, ord, word, p_type, count(*) AS n FROM part JOIN k ON contains(upper(p_type), word) GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ord, n DESC, p_type) AS i FROM h) SELECT p_brand, word, p_type, n FROM r WHERE i = 1"""
)
def keyword_resolution(spark, sf_dir):
    """The first keyword with hits, and its most frequent value."""
    hits = F.array_compact(F.array(*[F.when(F.upper("p_type").contains(w), F.struct(F.lit(i).alias("ord"), F.lit(w).alias("word"))) for i, w in enumerate(_WORDS)]))
    h = table(spark, sf_dir, "part").select("p_brand", "p_type", F.inline(hits)).groupBy("p_brand", "ord", "word", "p_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand").orderBy("ord", F.desc("n"), "p_type")
    return h.withColumn("i", F.row_number().over(w)).filter("i = 1").select("p_brand", "word", "p_type", "n")


@query(f"WITH {BARS} SELECT ts, max(close) FILTER (WHERE symbol = 'A') AS a, max(close) FILTER (WHERE symbol = 'N') AS n, max(close) FILTER (WHERE symbol = 'R') AS r FROM b GROUP BY ts HAVING count(*) = 3")
def aligned_closes(spark, sf_dir):
    """Closes side by side on the days that all symbols share."""
    wide = daily_bars(spark, sf_dir).groupBy("ts").pivot("symbol", ["A", "N", "R"]).agg(F.max("close")).dropna()
    return wide.select("ts", *[F.col(c).alias(c.lower()) for c in ("A", "N", "R")])


@query(
    f"""WITH {BARS}, r AS (SELECT symbol, close / lag(close) {W} - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b), t AS (SELECT * FROM r WHERE k <= 252 AND r IS NOT NULL)
    SELECT x.symbol AS a, y.symbol AS b, round(corr(x.r, y.r), 6) AS corr FROM t x JOIN t y ON x.k = y.k AND x.symbol < y.symbol GROUP BY 1, 2"""
)
def positional_correlation(spark, sf_dir):
    """Correlation of the last 252 returns, aligned by position and not by date."""
    t = daily_bars(spark, sf_dir).select("symbol", series.change(F.col("close")).alias("r"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("k")).filter("k <= 252 and r is not null")
    pairs = t.alias("x").join(t.alias("y"), F.expr("x.k = y.k and x.symbol < y.symbol"))
    return rounded(pairs.groupBy(F.col("x.symbol").alias("a"), F.col("y.symbol").alias("b")).agg(F.corr("x.r", "y.r").alias("corr")))


@query(
    """WITH e AS (SELECT o_orderdate::DATE AS d, count(*) AS opened FROM orders GROUP BY 1), x AS (SELECT l_shipdate::DATE AS d, round(sum(l_extendedprice), 2) AS closed FROM lineitem GROUP BY 1)
    SELECT coalesce(e.d, x.d) AS d, coalesce(opened, 0) AS opened, coalesce(closed, 0)::DOUBLE AS closed FROM e FULL OUTER JOIN x ON e.d = x.d"""
)
def two_date_chart(spark, sf_dir):
    """Counts by one date and sums by another, merged."""
    e = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("opened"))
    x = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.round(F.sum("l_extendedprice"), 2).alias("closed"))
    return e.join(x, "d", "full_outer").select("d", F.coalesce("opened", F.lit(0)).alias("opened"), F.coalesce("closed", F.lit(0.0)).alias("closed"))


@query(
    f"""WITH {BARS}, f AS (SELECT symbol, ts, close, {rolled("avg", "close", 20)} AS m, {rolled("stddev_samp", "close", 20)} AS s, {rolled("max", "close", 252)} AS hi, {rolled("min", "close", 252)} AS lo, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b)
    SELECT symbol, ts, concat_ws(',', CASE WHEN (close - m) / s > 2 THEN 'overbought' END, CASE WHEN (close - m) / s < -2 THEN 'oversold' END, CASE WHEN close >= hi * 0.98 THEN 'near high' END, CASE WHEN close <= lo * 1.02 THEN 'near low' END) AS labels FROM f WHERE k <= 60"""
)
def pattern_labels(spark, sf_dir):
    """Labels of the last bars, only those that hold."""
    c = F.col("close")
    f = daily_bars(spark, sf_dir).select("symbol", "ts", "close", series.rolling(F.avg, c, 20).alias("m"), series.rolling(F.stddev_samp, c, 20).alias("s"), series.rolling(F.max, c, 252).alias("hi"), series.rolling(F.min, c, 252).alias("lo"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("k")).filter("k <= 60")
    z = F.try_divide(c - F.col("m"), F.col("s"))
    return f.select("symbol", "ts", F.concat_ws(",", F.when(z > 2, "overbought"), F.when(z < -2, "oversold"), F.when(c >= F.col("hi") * 0.98, "near high"), F.when(c <= F.col("lo") * 1.02, "near low")).alias("labels"))


@query(
    """WITH t AS (SELECT r_name, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 1 WHEN n_nationkey % 3 = 1 THEN -1 ELSE 0 END AS dir, 0.5 + r_regionkey * 0.25 AS tilt FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT r_name, round(least(greatest(sum(tilt * dir) / sum(abs(tilt)) * 100, -100), 100), 6) AS macro FROM t GROUP BY 1"""
)
def macro_tilt(spark, sf_dir):
    """Tilts times directions, over the sum of tilts."""
    t = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    d = F.when(F.col("n_nationkey") % 3 == 0, 1).when(F.col("n_nationkey") % 3 == 1, -1).otherwise(0)
    tilt = 0.5 + F.col("r_regionkey") * 0.25
    return rounded(t.groupBy("r_name").agg(numeric.clip(F.sum(tilt * d) / F.sum(F.abs(tilt)) * 100).alias("macro")))


@query(
    r"""WITH x AS (SELECT doc_id, lower(text || ' Altera a Lei n. ' || (8000 + doc_id % 900)::VARCHAR || ' de 12/0' || (1 + doc_id % 9)::VARCHAR || '/20' || (10 + doc_id % 15)::VARCHAR || ', art. 0' || (doc_id % 50)::VARCHAR) AS t FROM documents)
    SELECT doc_id, replace(regexp_extract(t, 'lei\s+(?:complementar\s+)?(?:n[oº°.]*\s*)?(\d[\d.]*)', 1), '.', '') AS law, regexp_replace(regexp_extract(t, 'art(?:igo)?s?\.?\s*(\d+)', 1), '^0+(.)', '\1') AS article, strptime(regexp_extract(t, '(\d{2}/\d{2}/\d{4})', 1), '%d/%m/%Y')::DATE AS day FROM x"""
)
def law_references(spark, sf_dir):
    """Law numbers, articles and dates out of whole texts that end with a reference."""
    i = F.col("doc_id")
    t = F.concat("text", F.lit(" Altera a Lei n. "), (8000 + i % 900).cast("string"), F.lit(" de 12/0"), (1 + i % 9).cast("string"), F.lit("/20"), (10 + i % 15).cast("string"), F.lit(", art. 0"), (i % 50).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.get(text.law_numbers(F.col("t")), F.lit(0)).alias("law"), F.get(text.article_numbers(F.col("t")), F.lit(0)).alias("article"), text.brazilian_date(F.col("t")).alias("day"))


_ACCENTS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in normaliser.ACCENTS.items()) + "}"


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(' ' || text, '[ \\t]{{2,}}', ' ', 'g'), '\\p{{L}}+|\\P{{L}}+') AS ts FROM documents),
    a AS (SELECT doc_id, array_to_string(list_transform(ts, lambda t: CASE WHEN {_ACCENTS}[lower(t)] IS NULL THEN t WHEN t = upper(t) AND length(t) > 1 THEN upper({_ACCENTS}[lower(t)]) WHEN t[1] <> lower(t[1]) THEN upper({_ACCENTS}[lower(t)][1]) || {_ACCENTS}[lower(t)][2:] ELSE {_ACCENTS}[lower(t)] END), '') AS x FROM t)
    SELECT doc_id, sha256('Conforme a Súmula Vinculante ' || (doc_id % 50)::VARCHAR || ' , o Parágrafo único da Lei 8.' || (100 + doc_id % 900)::VARCHAR || '/1990' || x) AS body_sha256 FROM a"""
)
def normalised_citations(spark, sf_dir):
    """Whole texts after a sentence of citations, as case law: accents, citations and references."""
    i = F.col("doc_id")
    raw = F.concat(F.lit("Conforme a Sumula  vinculante "), (i % 50).cast("string"), F.lit(" , o Paragrafo unico da Lei n. 8."), (100 + i % 900).cast("string"), F.lit(", de 11 de dezembro de 1990 "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normaliser.normalised(raw, "juris"), 256).alias("body_sha256"))


def _observations(spark, sf_dir) -> DataFrame:
    """One row for each day and side: the share of rising half hours, and a sign."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.when(F.col("event_type").isin("click", "view"), 1.0).otherwise(0.0).alias("x"))
    return e.agg(F.avg((F.col("value") > 30).cast("double")).alias("y"))


@query()
def permutation_test(spark, sf_dir):
    """How often shuffled outcomes reach the real skill."""
    return inference.permutation(_observations(spark, sf_dir))


@query()
def bootstrap_interval(spark, sf_dir):
    """Intervals of predicted probabilities, whole days redrawn."""
    return inference.bootstrap(_observations(spark, sf_dir))
