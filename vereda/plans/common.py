"""Reading the driver's tables, and SQL fragments that several oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series

PRICE_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small file dealt to as many tasks as a shuffle has, for work that is heavy for each
    row; adaptive execution does not merge a stated number again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each return flag and ship date: price is extended price over quantity."""
    rows = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return series.bars(rows, F.to_date("l_shipdate"), price, F.col("l_quantity"), PRICE_ORDER, F.col("l_returnflag"))


BARS = """
    x AS (SELECT l_returnflag AS symbol, l_shipdate::DATE AS ts, l_extendedprice / l_quantity AS p, l_quantity AS v,
                 row_number() OVER (PARTITION BY l_returnflag, l_shipdate::DATE ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS k
          FROM lineitem),
    b AS (SELECT symbol, ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(v) AS volume, count(*) AS trades FROM x GROUP BY 1, 2)
"""


def rolled(agg: str, value: str, n: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {over} = {n} THEN {agg}({value}) {over} END"


def rounded(df: DataFrame, digits: int = 6, *, only: list[str] | None = None) -> DataFrame:
    """Doubles to a fixed number of digits, so that the order of additions does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and (not only or c in only) else F.col(c) for c, t in df.dtypes])
