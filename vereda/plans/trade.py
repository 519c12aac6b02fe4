"""Composite market scores, trade joins, dates and study queries, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numeric
from ..operators import merge, series
from .common import BARS, daily_bars, rolled, rounded, table

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


def _clip(x: str) -> str:
    return f"least(greatest({x}, -100), 100)"


def _mean(parts: list[tuple[float, str]]) -> str:
    """A weighted mean of what is known."""
    top = " + ".join(f"coalesce({w} * ({x}), 0)" for w, x in parts)
    low = " + ".join(f"CASE WHEN ({x}) IS NULL THEN 0 ELSE {w} END" for w, x in parts)
    return f"(({top}) / nullif({low}, 0))"


_IND = """i AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 500 END AS pl, abs(s_acctbal) / 3000 AS pvp, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 900 END AS ev_ebitda, (s_suppkey % 13)::DOUBLE AS dy,
    CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 400 END AS roe, s_acctbal / 700 AS margem, (s_suppkey % 31 - 15)::DOUBLE AS receita, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 41 - 20)::DOUBLE END AS lucro, (s_suppkey % 190)::DOUBLE AS div_pl, s_nationkey % 5 = 0 AS bank FROM supplier)"""


@query(
    f"""WITH {_IND}, p AS (SELECT s_suppkey, {_mean([(0.40, f"CASE WHEN pl > 0 THEN {_clip('(14 - pl) * 8')} END"), (0.30, f"CASE WHEN pvp > 0 THEN {_clip('(2.2 - pvp) * 45')} END"), (0.20, f"CASE WHEN ev_ebitda > 0 AND NOT bank THEN {_clip('(8 - ev_ebitda) * 12')} END"), (0.10, _clip('dy * 8'))])} AS valor,
        {_mean([(0.55, f"CASE WHEN roe IS NOT NULL THEN {_clip('(roe - 12) * 5')} END"), (0.45, _clip('(margem - 10) * 3'))])} AS qualidade, {_mean([(0.55, _clip('receita * 4')), (0.45, f"CASE WHEN lucro IS NOT NULL THEN {_clip('lucro * 3')} END")])} AS crescimento,
        CASE WHEN NOT bank THEN {_clip('(1.0 - div_pl / 100.0) * 70')} END AS saude FROM i),
    s AS (SELECT *, round_even({_clip("coalesce(" + _mean([(0.30, "valor"), (0.35, "qualidade"), (0.20, "crescimento"), (0.15, "saude")]) + ", 0)")}, 0) AS score FROM p)
    SELECT s_suppkey, round(valor, 4) AS valor, round(qualidade, 4) AS qualidade, round(crescimento, 4) AS crescimento, round(saude, 4) AS saude, round(score, 4) AS score, CASE WHEN score >= 45 THEN 'FORTE' WHEN score >= 15 THEN 'SÓLIDA' WHEN score > -15 THEN 'NEUTRA' WHEN score > -45 THEN 'ATENÇÃO' ELSE 'FRÁGIL' END AS tag FROM s"""
)
def fundamental_scores(spark, sf_dir):
    """Value, quality, growth and health of issuers, out of the indicators that are known."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    i = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(k % 7 != 0, b / 500).alias("pl"), (F.abs(b) / 3000).alias("pvp"), F.when(k % 5 != 0, b / 900).alias("ev_ebitda"), (k % 13).cast("double").alias("dy"), F.when(k % 3 != 0, b / 400).alias("roe"),
        (b / 700).alias("margem"), (k % 31 - 15).cast("double").alias("receita"), F.when(k % 4 != 0, (k % 41 - 20).cast("double")).alias("lucro"), (k % 190).cast("double").alias("div_pl"), (F.col("s_nationkey") % 5 == 0).alias("bank"),
    )
    i = i.select("s_suppkey", numeric.fundamentals(*[F.col(c) for c in ("pl", "pvp", "ev_ebitda", "dy", "roe", "margem", "receita", "lucro", "div_pl", "bank")]).alias("f"))
    return rounded(i.select("s_suppkey", "f.*"), 4)


@query(
    """WITH l AS (SELECT l_partkey, round(avg(l_discount), 8) AS dy FROM lineitem GROUP BY 1), b AS (SELECT p_brand, round(avg(p_retailprice), 8) AS book FROM part GROUP BY 1),
    i AS (SELECT p_partkey, round(p_retailprice / book, 8) AS pvp, CASE WHEN dy < 1 THEN dy * 100 ELSE dy END AS dy FROM part JOIN b USING (p_brand) LEFT JOIN l ON l_partkey = p_partkey),
    p AS (SELECT p_partkey, CASE WHEN dy IS NULL THEN least(greatest((1.05 - pvp) * 70, -100), 100) ELSE 0.55 * least(greatest((1.05 - pvp) * 70, -100), 100) + 0.45 * least(greatest(dy * 6, -100), 100) END AS valor,
        0.6 * CASE WHEN pvp > 1.3 THEN least(greatest((pvp - 0.7) * -30, -100), 100) WHEN pvp <= 1 THEN 10 ELSE 0 END + 0.4 * CASE WHEN dy >= 8 THEN 15 WHEN dy IS NULL THEN 0 ELSE least(greatest(dy * 2, -100), 100) END AS qualidade FROM i),
    s AS (SELECT *, round_even(least(greatest(0.55 * valor + 0.45 * qualidade, -100), 100), 0) AS score FROM p)
    SELECT p_partkey, round(valor, 4)::DOUBLE AS valor, round(qualidade, 4)::DOUBLE AS qualidade, score::DOUBLE AS score, CASE WHEN score >= 45 THEN 'FORTE' WHEN score >= 15 THEN 'SÓLIDA' WHEN score > -15 THEN 'NEUTRA' WHEN score > -45 THEN 'ATENÇÃO' ELSE 'FRÁGIL' END AS tag FROM s"""
)
def real_estate_scores(spark, sf_dir):
    """Value and quality of real-estate funds: a part's price over the mean of its brand, and the
    mean discount of its lines as the yield."""
    dy = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg("l_discount"), 8).alias("dy"))
    p = table(spark, sf_dir, "part")
    book = p.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 8).alias("book"))
    i = p.join(book, "p_brand").join(dy, "p_partkey", "left").select("p_partkey", F.round(F.col("p_retailprice") / F.col("book"), 8).alias("pvp"), "dy")
    return rounded(i.select("p_partkey", numeric.real_estate(F.col("pvp"), F.col("dy")).alias("f")).select("p_partkey", "f.*"), 4)


@query(
    """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 1 + c_custkey % 5 END AS mean, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 200 END AS up FROM customer)
    SELECT c_custkey, CASE WHEN mean IS NOT NULL OR up IS NOT NULL THEN round(least(greatest((coalesce((3 - mean) / 2.0 * 100 * 0.6, 0) + CASE WHEN up IS NULL THEN 0 ELSE least(greatest(up * 3, -100), 100) * 0.4 END) / nullif(CASE WHEN mean IS NULL THEN 0 ELSE 0.6 END + CASE WHEN up IS NULL THEN 0 ELSE 0.4 END, 0), -100), 100), 6) END AS score,
        CASE WHEN abs(c_acctbal) >= 100 THEN round_even(c_acctbal, 1) WHEN abs(c_acctbal) >= 1 THEN round_even(c_acctbal, 2) ELSE round_even(c_acctbal, 4) END AS shown FROM a JOIN customer USING (c_custkey)"""
)
def analyst_scores(spark, sf_dir):
    """Recommendation and upside, weighted by what is there; figures rounded by size."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    mean, up = F.when(k % 4 != 0, 1 + k % 5), F.when(k % 3 != 0, b / 200)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(numeric.analyst_score(mean, up), 6).alias("score"), numeric.rounded_by_size(b).alias("shown"))


@query(
    f"""WITH {BARS}, f AS (SELECT symbol, ts, close, lag(close, 21) {W} AS month_ago, {rolled("avg", "close", 50)} AS sma50, {rolled("avg", "close", 200)} AS sma200, {rolled("max", "close", 252)} AS hi, {rolled("min", "close", 252)} AS lo, {rolled("avg", "volume", 20)} AS v20, volume FROM b),
    s AS (SELECT symbol, ts, 'trend' AS factor, 'technical' AS category, 3 AS w, CASE WHEN close > sma200 THEN 2 WHEN close < sma200 THEN -2 ELSE 0 END AS s FROM f WHERE sma200 IS NOT NULL
        UNION ALL SELECT symbol, ts, 'stack', 'technical', 2, CASE WHEN sma50 > sma200 THEN 2 WHEN sma50 < sma200 THEN -2 ELSE 0 END FROM f WHERE sma200 IS NOT NULL
        UNION ALL SELECT symbol, ts, 'month', 'momentum', 2, CASE WHEN close / month_ago - 1 > 0.05 THEN 2 WHEN close / month_ago - 1 > 0 THEN 1 WHEN close / month_ago - 1 < -0.05 THEN -2 ELSE -1 END FROM f WHERE month_ago IS NOT NULL
        UNION ALL SELECT symbol, ts, 'place', 'momentum', 1, CASE WHEN (close - lo) / (hi - lo) > 0.8 THEN 1 WHEN (close - lo) / (hi - lo) < 0.2 THEN -1 ELSE 0 END FROM f WHERE hi > lo
        UNION ALL SELECT symbol, ts, 'volume', 'flow', 1, CASE WHEN volume > 1.5 * v20 THEN 1 WHEN volume < 0.5 * v20 THEN -1 ELSE 0 END FROM f WHERE v20 IS NOT NULL)
    SELECT symbol, ts, category, count(*) AS factors, round(100.0 * sum(s * w) / sum(2 * w), 6) AS score FROM s GROUP BY GROUPING SETS ((symbol, ts, category), (symbol, ts))"""
)
def factor_signal(spark, sf_dir):
    """Weighted factors by day: in total and by category, over the factors that are known."""
    c = F.col("close")
    f = daily_bars(spark, sf_dir).select("symbol", "ts", "close", "volume", F.lag("close", 21).over(series.series()).alias("month_ago"), series.rolling(F.avg, c, 50).alias("sma50"), series.rolling(F.avg, c, 200).alias("sma200"), series.rolling(F.max, c, 252).alias("hi"), series.rolling(F.min, c, 252).alias("lo"), series.rolling(F.avg, F.col("volume"), 20).alias("v20"))
    sign = lambda a, b, n: F.when(a > b, n).when(a < b, -n).otherwise(0)
    month, place = c / F.col("month_ago") - 1, F.try_divide(c - F.col("lo"), F.col("hi") - F.col("lo"))
    factors = [
        ("trend", "technical", 3, F.col("sma200").isNotNull(), sign(c, F.col("sma200"), 2)),
        ("stack", "technical", 2, F.col("sma200").isNotNull(), sign(F.col("sma50"), F.col("sma200"), 2)),
        ("month", "momentum", 2, month.isNotNull(), F.when(month > 0.05, 2).when(month > 0, 1).when(month < -0.05, -2).otherwise(-1)),
        ("place", "momentum", 1, F.col("hi") > F.col("lo"), F.when(place > 0.8, 1).when(place < 0.2, -1).otherwise(0)),
        ("volume", "flow", 1, F.col("v20").isNotNull(), F.when(F.col("volume") > 1.5 * F.col("v20"), 1).when(F.col("volume") < 0.5 * F.col("v20"), -1).otherwise(0)),
    ]
    rows = F.array_compact(F.array(*[F.when(known, F.struct(F.lit(category).alias("category"), F.lit(w).alias("w"), s.alias("s"))) for _, category, w, known, s in factors]))
    g = f.select("symbol", "ts", F.inline(rows)).groupingSets([["symbol", "ts", "category"], ["symbol", "ts"]], "symbol", "ts", "category")
    return g.agg(F.count("*").alias("factors"), F.round(100.0 * F.sum(F.col("s") * F.col("w")) / F.sum(2 * F.col("w")), 6).alias("score"))


@query(
    f"""WITH {BARS}, s AS (SELECT symbol, min(ts) AS first_day, max(ts) AS last_day, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close, min(close) AS low, arg_min(ts, close) AS low_day, max(close) AS high, count(*) AS n FROM b GROUP BY 1),
    v AS (SELECT symbol, stddev_samp(r) * sqrt(252) AS vol FROM (SELECT symbol, close / lag(close) {W} - 1 AS r FROM b) GROUP BY 1)
    SELECT s.symbol, first_day, last_day, round(last_close / first_close - 1, 6) AS total, round(pow(last_close / first_close, 1.0 / 5) - 1, 6) AS yearly, round(vol, 6) AS vol, round(low, 6) AS low, low_day, round(high, 6) AS high, n FROM s JOIN v ON v.symbol = s.symbol"""
)
def series_summary(spark, sf_dir):
    """First, last, total and yearly return, volatility and extremes with their days."""
    b = daily_bars(spark, sf_dir).withColumn("r", series.change(F.col("close")))
    first, last = F.min_by("close", "ts"), F.max_by("close", "ts")
    g = b.groupBy("symbol").agg(F.min("ts").alias("first_day"), F.max("ts").alias("last_day"), (last / first - 1).alias("total"), (F.pow(last / first, F.lit(0.2)) - 1).alias("yearly"), (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"), F.min("close").alias("low"), F.min_by("ts", "close").alias("low_day"), F.max("close").alias("high"), F.count("*").alias("n"))
    return rounded(g)


@query(
    """WITH a AS (SELECT o_orderdate::DATE AS d, avg(o_totalprice) AS a FROM orders GROUP BY 1), b AS (SELECT l_shipdate::DATE AS d, avg(l_extendedprice) AS b FROM lineitem GROUP BY 1), j AS (SELECT coalesce(a.d, b.d) AS d, a, b FROM a FULL OUTER JOIN b ON a.d = b.d)
    SELECT d, round(last_value(a IGNORE NULLS) OVER (ORDER BY d), 6) AS a, round(last_value(b IGNORE NULLS) OVER (ORDER BY d), 6) AS b FROM j"""
)
def aligned_series(spark, sf_dir):
    """Two series on the union of their days, each with its last known value."""
    a = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("a"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.avg("l_extendedprice").alias("b"))
    return rounded(series.aligned(a, b, "d", ["a", "b"]))


_TRADES = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag AS asset, o_orderdate::DATE AS entry, l_shipdate::DATE AS out, l_extendedprice * (l_discount - 0.05) AS pnl FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_SHAPE = "CASE WHEN {0}.high <= {0}.low THEN 'sem amplitude' WHEN abs({0}.close - {0}.open) / ({0}.high - {0}.low) < 0.12 THEN 'doji' WHEN {0}.close >= {0}.open THEN 'alta' ELSE 'baixa' END"


@query(
    f"""WITH {BARS}, {_TRADES}, j AS (SELECT t.asset, pnl, CASE WHEN e.symbol IS NULL THEN NULL ELSE {_SHAPE.format("e")} END AS shape_in, CASE WHEN x.symbol IS NULL THEN NULL ELSE {_SHAPE.format("x")} END AS shape_out FROM t LEFT JOIN b e ON e.symbol = t.asset AND e.ts = t.entry LEFT JOIN b x ON x.symbol = t.asset AND x.ts = t.out)
    SELECT asset, shape_in, shape_out, shape_in = shape_out AS agree, count(*) AS trades, round(100.0 * count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_rate, round(sum(pnl), 2) AS net FROM j GROUP BY 1, 2, 3, 4"""
)
def candle_combinations(spark, sf_dir):
    """Trades by the shapes of the bars at entry and at exit, and whether these agree."""
    bars = daily_bars(spark, sf_dir)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    shape = F.when(h <= low, "sem amplitude").when(F.abs(c - o) / (h - low) < 0.12, "doji").when(c >= o, "alta").otherwise("baixa")
    shapes = bars.select(F.col("symbol").alias("asset"), "ts", shape.alias("shape"))
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("entry")), "l_orderkey")
    t = t.select(F.col("l_returnflag").alias("asset"), "entry", F.to_date("l_shipdate").alias("out"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"))
    for at, name in (("entry", "shape_in"), ("out", "shape_out")):
        t = t.join(shapes.select("asset", F.col("ts").alias(at), F.col("shape").alias(name)), ["asset", at], "left")
    t = t.withColumn("agree", F.col("shape_in") == F.col("shape_out"))
    return t.groupBy("asset", "shape_in", "shape_out", "agree").agg(F.count("*").alias("trades"), F.round(100.0 * F.count_if(F.col("pnl") > 0) / F.count("*"), 6).alias("win_rate"), F.round(F.sum("pnl"), 2).alias("net"))


@query(
    f"""WITH {BARS}, d AS (SELECT symbol, ts, close, lag(close, 21) {W} AS back, lag(close, 252) {W} AS year_ago, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b)
    SELECT symbol, ts, round(close, 6) AS last, round(close / back - 1, 6) AS change, round(close / year_ago - 1, 6) AS yearly, CASE WHEN close / back - 1 > 0.01 THEN 1 WHEN close / back - 1 < -0.01 THEN -1 ELSE 0 END AS dir FROM d WHERE k = 1"""
)
def macro_panel(spark, sf_dir):
    """Last value, change over a month and a year, and direction, of each series."""
    c = F.col("close")
    d = daily_bars(spark, sf_dir).select("symbol", "ts", "close", series.change(c, 21).alias("change"), series.change(c, 252).alias("yearly"))
    g = d.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "change", "yearly"), "ts").alias("x")).select("symbol", "x.*")
    return rounded(g.select("symbol", "ts", F.col("close").alias("last"), "change", "yearly", F.when(F.col("change") > 0.01, 1).when(F.col("change") < -0.01, -1).otherwise(0).alias("dir")))


@query(
    f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b)
    SELECT symbol, array_to_string(list_transform(list(close ORDER BY ts), lambda x: floor(x * 100)::BIGINT::VARCHAR), ',') AS spark, count(*) AS n FROM k WHERE k <= 30 GROUP BY symbol"""
)
def spark_lines(spark, sf_dir):
    """The last thirty closes of each series, in cents, as one array."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    k = daily_bars(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 30")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda x: F.floor(x["close"] * 100).cast("string"))
    return k.groupBy("symbol").agg(F.array_join(ordered, ",").alias("spark"), F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT p_partkey, p_type, p_retailprice AS v FROM part), l AS (SELECT l_partkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1)
    SELECT l_partkey AS p_partkey, d::DATE AS d, round(sum(l_extendedprice), 2) AS value, count(*) AS lines FROM lineitem JOIN l USING (l_partkey) WHERE l_shipdate = d GROUP BY 1, 2"""
)
def account_values(spark, sf_dir):
    """Values of each account at its last date."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_extendedprice")
    by_day = rows.groupBy("p_partkey", "l_shipdate").agg(F.sum("l_extendedprice").alias("value"), F.count("*").alias("lines"))
    last = by_day.groupBy("p_partkey").agg(F.max_by(F.struct("l_shipdate", "value", "lines"), "l_shipdate").alias("x"))
    return last.select("p_partkey", F.to_date("x.l_shipdate").alias("d"), F.round("x.value", 2).alias("value"), "x.lines")


_FILING = """CASE WHEN regexp_matches(p, 'URGENT') AND s = 'F' THEN 'resultado' WHEN regexp_matches(p, 'HIGH|MEDIUM') THEN 'comunicado' ELSE 'outros' END"""


@query(
    f"""WITH f AS (SELECT o_orderkey, year(o_orderdate) AS ano, o_orderdate::DATE AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders), m AS (SELECT max(d) AS last FROM f)
    SELECT ano, {_FILING} AS class, count(*) AS filings, count(*) FILTER (WHERE date_diff('day', d, last) <= 730) AS recent, (max(d))::DATE AS newest FROM f, m GROUP BY 1, 2"""
)
def filing_years(spark, sf_dir):
    """Filings by class and year, and how many are recent."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("ano"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    last = o.agg(F.max("d").alias("m")).first()["m"]
    kind = F.when(F.col("p").rlike("URGENT") & (F.col("s") == "F"), "resultado").when(F.col("p").rlike("HIGH|MEDIUM"), "comunicado").otherwise("outros")
    return o.groupBy("ano", kind.alias("class")).agg(F.count("*").alias("filings"), F.count_if(F.date_diff(F.lit(last), "d") <= 730).alias("recent"), F.max("d").alias("newest"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, ts, timezone('America/Sao_Paulo', timezone('UTC', ts)) AS l, max(ts) OVER () AS now FROM events)
    SELECT event_id, strftime(l, '%H:%M') AS bucket, isodow(l) <= 5 AND hour(l) >= 10 AND hour(l) < 18 AS open, date_diff('day', ts::DATE, DATE '2024-03-15')::INTEGER AS days_left, round(date_diff('day', ts::DATE, DATE '2024-03-15') / 365.0, 6) AS years, ts < now - INTERVAL 7 DAY AS stale,
        (ts::DATE - 1)::DATE AS since, (ts::DATE + (event_id % 9)::INTEGER)::DATE AS due, ts::DATE::TIMESTAMP + to_hours(9 + event_id % 8) AS slot FROM e"""
)
def date_functions(spark, sf_dir):
    """Local time, open hours, days to an expiry, staleness, look-back and schedule of events."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("m")).first()["m"]
    local, end = dates.local(F.col("ts"), "America/Sao_Paulo"), F.lit("2024-03-15").cast("date")
    i = F.col("event_id")
    return e.select(
        "event_id", F.date_format(local, "HH:mm").alias("bucket"), dates.market_open(local).alias("open"), dates.days_left(F.to_date("ts"), end).alias("days_left"), F.round(dates.years_left(F.to_date("ts"), end), 6).alias("years"),
        dates.stale(F.col("ts"), F.lit(now), 7).alias("stale"), dates.since(F.to_date("ts"), None, 1).alias("since"), F.date_add(F.to_date("ts"), (i % 9).cast("int")).alias("due"), dates.slot(F.to_date("ts"), (9 + i % 8).cast("int")).alias("slot"),
    )


@query(
    """WITH q AS (SELECT n_nationkey, (DATE '2024-01-01' + n_nationkey::INTEGER)::DATE AS start FROM nation)
    SELECT n_nationkey, m::INTEGER AS month, make_date(year(start + to_months(m::INTEGER))::BIGINT, month(start + to_months(m::INTEGER))::BIGINT, 12::BIGINT) AS release, (start + ((m * 30)::INTEGER))::DATE AS repeated FROM q, unnest(generate_series(0, 5)) AS u(m)"""
)
def release_dates(spark, sf_dir):
    """Synthetic monthly release days, and a quarterly value repeated every thirty days."""
    q = table(spark, sf_dir, "nation").select("n_nationkey", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")).alias("start"))
    q = q.select("n_nationkey", "start", F.posexplode(dates.releases(F.col("start"), 6, 12)).alias("month", "release"))
    return q.select("n_nationkey", "month", "release", F.date_add("start", F.col("month") * 30).alias("repeated"))


@query(
    """WITH d AS (SELECT user_id, event_type AS deck, count(*) AS cards, max(ts) AS last FROM events GROUP BY 1, 2), n AS (SELECT deck, count(*) AS decks FROM d GROUP BY 1)
    SELECT d.user_id, coalesce(CASE WHEN deck IN ('click', 'view') THEN deck END, 'geral') AS deck, sum(cards)::BIGINT AS cards, round(100.0 * sum(CASE WHEN last >= TIMESTAMP '2024-01-20' THEN cards ELSE 0 END) / sum(cards), 6) AS done, (sum(cards) + 1)::BIGINT AS next_place FROM d GROUP BY 1, 2"""
)
def deck_progress(spark, sf_dir):
    """Cards by deck (a default deck for the rest), the share done and the next free place."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("cards"), F.max("ts").alias("last"))
    known = spark.createDataFrame([("click",), ("view",)], "event_type string").withColumn("deck", F.col("event_type"))
    d = e.join(F.broadcast(known), "event_type", "left").withColumn("deck", F.coalesce("deck", F.lit("geral")))
    done = F.sum(F.when(F.col("last") >= F.lit("2024-01-20").cast("timestamp_ntz"), F.col("cards")).otherwise(0))
    return d.groupBy("user_id", "deck").agg(F.sum("cards").alias("cards"), F.round(100.0 * done / F.sum("cards"), 6).alias("done"), (F.sum("cards") + 1).alias("next_place"))


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
    SELECT o_custkey, count(*) AS cards, array_to_string(list(o_orderkey::VARCHAR ORDER BY k), ',') AS nested FROM c JOIN customer ON c_custkey = o_custkey GROUP BY 1"""
)
def deck_cards(spark, sf_dir):
    """Cards nested under their deck, in order; cards without a deck go."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    nested = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("cards"), F.array_join(nested, ",").alias("nested"))


@query(
    """WITH done AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT o.* FROM orders o LEFT JOIN done d ON d.o_orderkey = o.o_orderkey WHERE d.o_orderkey IS NULL AND o_totalprice >= 1000)
    SELECT o_orderpriority, count(*) AS pending, min(o_orderkey) AS first_key, round(sum(o_totalprice), 2) AS total FROM p GROUP BY 1"""
)
def pending_queue(spark, sf_dir):
    """The catalogue without what is done, large enough, by kind."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    p = table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").filter("o_totalprice >= 1000")
    return p.groupBy("o_orderpriority").agg(F.count("*").alias("pending"), F.min("o_orderkey").alias("first_key"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """WITH l AS (SELECT user_id AS key, ts AS updated, event_id AS v, 0 AS side FROM events WHERE event_type <> 'view'), r AS (SELECT user_id AS key, ts AS updated, event_id AS v, 1 AS side FROM events WHERE event_type <> 'click'), u AS (SELECT * FROM l UNION ALL SELECT * FROM r)
    SELECT key, max(updated) AS updated, arg_max(v, struct_pack(u := updated, s := -side)) AS v, arg_max(CASE WHEN side = 0 THEN 'local' ELSE 'remote' END, struct_pack(u := updated, s := -side)) AS side FROM u GROUP BY key"""
)
def last_writer_wins(spark, sf_dir):
    """The newest of local and remote rows by key; local wins ties."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("updated"), F.col("event_id").alias("v"), "event_type")
    return merge.last_writer(e.filter("event_type <> 'view'").drop("event_type"), e.filter("event_type <> 'click'").drop("event_type"), "key", "updated", ["updated", "v"])


@query(
    """WITH f AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS good, max(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts) AS good_ts, event_type FROM events)
    SELECT user_id, ts, good AS value, good_ts < ts - INTERVAL 1 DAY AS stale FROM f"""
)
def last_good_values(spark, sf_dir):
    """The last good value at each moment, and whether it is older than a day."""
    w = Window.partitionBy("user_id").orderBy("ts")
    good = F.col("event_type") != "error"
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.last(F.when(good, F.col("value")), True).over(w).alias("value"), F.max(F.when(good, F.col("ts"))).over(w).alias("good_ts"))
    return e.select("user_id", "ts", "value", (F.col("good_ts") < F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("stale"))


@query(
    """WITH d AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT n_name, n_nationkey FROM nation)
    SELECT day, n_name, sum(n) FILTER (WHERE event_type = 'purchase')::BIGINT AS sold, n_nationkey % 7 = isodow(day) - 1 AS slotted FROM d, r GROUP BY 1, 2, 4"""
)
def slot_plan(spark, sf_dir):
    """Every day with every place, the day's figures, and whether the place has its slot then."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.when(F.col("event_type") == "purchase", 1)).alias("sold"))
    # each place is dealt to every day between the first and the last; days without events drop out
    span = d.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    n = n.join(F.broadcast(span)).select("n_name", "k", F.explode(F.sequence("a", "z")).alias("day"))  # one row
    return d.join(n, "day").select("day", "n_name", "sold", (F.col("k") % 7 == F.weekday("day")).alias("slotted"))


@query(
    """WITH e AS (SELECT user_id, ts::DATE AS d, count(*) AS bars, sum(value) AS v, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1, 2), k AS (SELECT * FROM e WHERE bars >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS i FROM k)
    SELECT user_id, count(*) AS sessions, round(avg(v) FILTER (WHERE i <= 30), 6) AS mean_last, round(epoch(max(z) - min(a)) / 86400.0 / count(*), 6) AS days_each FROM r GROUP BY 1"""
)
def session_rates(spark, sf_dir):
    """Sessions that are long enough, the mean of the last thirty and the pace."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("bars"), F.sum("value").alias("v"), F.min("ts").alias("a"), F.max("ts").alias("z")).filter("bars >= 2")
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("d"))))
    seconds = F.unix_micros(F.max("z").cast("timestamp")) - F.unix_micros(F.min("a").cast("timestamp"))
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"), F.round(F.avg(F.when(F.col("i") <= 30, F.col("v"))), 6).alias("mean_last"), F.round(seconds / 1e6 / 86400.0 / F.count("*"), 6).alias("days_each"))


@query(
    """WITH c AS (SELECT p_partkey, p_brand, lower(p_name) AS a, lower(regexp_replace(p_name, ' ', '-', 'g')) AS b, p_size FROM part), o AS (SELECT p_partkey, p_brand, p_size, unnest(['x' || a, b, a]) AS candidate, unnest([1, 2, 3]) AS place FROM c), k AS (SELECT lower(regexp_replace(p_name, ' ', '-', 'g')) AS name, max(p_retailprice) AS price FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT lower(p_name) AS name, min(p_retailprice) AS price FROM part WHERE contains(p_name, ' ') GROUP BY 1)
    SELECT p_partkey, min(place)::INTEGER AS place, round(arg_min(price, place), 6) AS price FROM o JOIN k ON k.name = o.candidate GROUP BY 1"""
)
def candidate_keys(spark, sf_dir):
    """The first of several candidate keys that the other side has."""
    p = table(spark, sf_dir, "part")
    dashed, lower = F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lower("p_name")
    known = p.filter("p_size % 2 = 0").groupBy(dashed.alias("candidate")).agg(F.max("p_retailprice").alias("price")).unionByName(p.filter(F.col("p_name").contains(" ")).groupBy(lower.alias("candidate")).agg(F.min("p_retailprice").alias("price")))
    found = merge.first_candidate(p.select("p_partkey", F.array(F.concat(F.lit("x"), lower), dashed, lower).alias("keys")), "p_partkey", "keys", known, "candidate")
    return rounded(found.select("p_partkey", "place", "price"))


@query("SELECT p_partkey, 'INSERT INTO parts (id, name) VALUES (' || p_partkey::VARCHAR || ', ''' || replace(p_name, '''', '''''') || ''') ON CONFLICT (id) DO UPDATE SET name = excluded.name;' AS statement FROM part")
def insert_statements(spark, sf_dir):
    """Rows as statements that insert or update."""
    quoted = F.concat(F.lit("'"), F.replace("p_name", F.lit("'"), F.lit("''")), F.lit("'"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("INSERT INTO parts (id, name) VALUES ("), F.col("p_partkey").cast("string"), F.lit(", "), quoted, F.lit(") ON CONFLICT (id) DO UPDATE SET name = excluded.name;")).alias("statement"))


@query(
    """WITH g AS (SELECT n_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
    SELECT n_nationkey, suppliers, (suppliers * 2)::BIGINT AS twice, round(total / suppliers, 4) AS mean FROM g"""
)
def dashboard(spark, sf_dir):
    """Nested figures as JSON, and read back."""
    g = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    j = F.to_json(F.struct("n_nationkey", F.struct("suppliers", "total").alias("figures"), F.array(F.struct((F.col("suppliers") * 2).alias("twice"))).alias("rows")))
    back = F.from_json(j, "struct<n_nationkey:int,figures:struct<suppliers:long,total:double>,rows:array<struct<twice:long>>>")
    b = g.select(back.alias("b"))
    return b.select("b.n_nationkey", "b.figures.suppliers", F.col("b.rows")[0]["twice"].alias("twice"), F.round(F.col("b.figures.total") / F.col("b.figures.suppliers"), 4).alias("mean"))
