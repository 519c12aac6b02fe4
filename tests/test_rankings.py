"""Short lists, as-of joins, likeness and implied volatility against plain versions."""

import bisect
import datetime
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vereda.functions import numeric, similar
from vereda.operators import asof, orderstats
from vereda.operators.toplists import TopList, top_lists
from vereda.plans import rankings


def test_top_lists_in_one_scan(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([None, float("nan"), *map(float, range(20))]), rng.random()) for i in range(500)] + [(None, "a", 99.0, 0.5)]
    df = spark.createDataFrame(rows, "k int, g string, x double, y double")
    lists = [TopList("most", F.col("x")), TopList("least", F.col("x"), least=True, most=3), TopList("some", F.col("y"), where=F.col("x").between(11, 100))]
    found = top_lists(df, "k", lists, ["g"])
    got = {(r.g, r.list, r.place): (r.k, r.score) for r in found.collect()}
    known = [r for r in rows if r[0] is not None and r[2] is not None and r[2] == r[2]]
    for g in "ab":
        mine = [r for r in known if r[1] == g]
        for name, n, order in (("most", 5, lambda r: (-r[2], r[0])), ("least", 3, lambda r: (r[2], r[0]))):
            assert [got[g, name, p + 1][0] for p in range(n)] == [r[0] for r in sorted(mine, key=order)[:n]] and (g, name, n + 1) not in got
        assert [got[g, "some", p + 1][0] for p in range(5)] == [r[0] for r in sorted((r for r in mine if r[2] > 10), key=lambda r: (-r[3], r[0]))[:5]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "WindowGroupLimit" in plan  # cut before the shuffle
    assert top_lists(df.limit(0), "k", lists).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_as_of_join(spark, parts):
    rng = random.Random(parts)
    when = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(5000), microseconds=rng.choice([0, 250_000]))
    left = [(i, rng.choice(["hot", "hot", "x", "y"]), when()) for i in range(400)] + [(900, None, when()), (901, "x", None), (5, "x", datetime.datetime(2024, 1, 1, 0, 0, 1)), (5, "x", datetime.datetime(2024, 1, 1, 0, 0, 1))]
    right = [(rng.choice(["hot", "x"]), when(), rng.randrange(100)) for _ in range(150)] + [(None, when(), 1), ("x", None, 2), ("x", left[0][2], 7), ("x", left[0][2], 8)]
    got = asof.as_of(spark.createDataFrame(left, "i int, k string, ts timestamp"), spark.createDataFrame(right, "k string, ts timestamp, v int"), ["k"], "ts", ["v", "ts"], 60, parts)
    assert got.columns == ["i", "k", "ts", "v", "right_ts"]
    by = {k: sorted((t, v) for q, t, v in right if q == k and t) for k in ("hot", "x", "y")}
    want = []
    for i, k, t in left:
        place = bisect.bisect_right(by[k], (t, 1 << 30)) if k and t else 0
        hit = by[k][place - 1] if place and t - by[k][place - 1][0] <= datetime.timedelta(seconds=60) else (None, None)
        want.append((i, k, t, hit[1], hit[0]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_likeness_equals_the_library(spark, sf_dir):
    rows = rankings.title_suspects(spark, sf_dir).collect()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert len(rows) == pages and sorted(r.place for r in rows) == list(range(1, pages + 1))
    for r in rows:
        assert r.likeness == pytest.approx(difflib.SequenceMatcher(None, r.title, r.line, autojunk=False).ratio(), abs=1e-6)
    by = sorted(rows, key=lambda r: r.place)
    assert all(a.likeness <= b.likeness for a, b in zip(by, by[1:]))
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé🙂") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert 2 * similar.matching(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() * (len(a) + len(b)))
    df = spark.createDataFrame([("", ""), (None, "a"), ("a", None), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in df.select(similar.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, 1.0]


def test_implied_volatility_finds_the_price_again(spark):
    rows = [(c, s, k, t, v) for c in (True, False) for s in (80.0, 100.0, 130.0) for k in (90.0, 100.0, 120.0) for t in (0.05, 0.5, 2.0) for v in (0.1, 0.39, 1.5)]
    df = spark.createDataFrame(rows, "c boolean, s double, k double, t double, v double")
    args = [F.col("s"), F.col("k"), F.col("t"), F.lit(0.05)]
    df = df.withColumn("p", numeric.black_scholes(F.col("c"), *args, F.col("v")))
    df = df.withColumn("found", numeric.implied_volatility(F.col("c"), F.col("p"), *args)).withColumn("again", numeric.black_scholes(F.col("c"), *args, F.col("found")))
    for r in df.collect():
        if r.found is not None:
            assert r.again == pytest.approx(r.p, abs=1e-6)
        assert r.found is not None or r.p <= 1e-6 or r.p < max(0, r.s - r.k, r.k - r.s) + 1e-3
    wrong = spark.createDataFrame([(True, -1.0), (True, 0.0), (True, 1e9), (True, None)], "c boolean, p double")
    assert [r[0] for r in wrong.select(numeric.implied_volatility(F.col("c"), F.col("p"), F.lit(100.0), F.lit(100.0), F.lit(1.0), F.lit(0.1))).collect()] == [None] * 4


@pytest.mark.parametrize("stretch", [4096, 7])
def test_rolling_order_equals_sorting_each_window(spark, monkeypatch, stretch):
    monkeypatch.setattr(orderstats, "STRETCH", stretch)
    rng = random.Random(5)
    rows = [(s, t, rng.choice([None, float("nan"), *[float(rng.randrange(30)) for _ in range(40)]])) for s in "ab" for t in range(150)]
    df = spark.createDataFrame(rows + [("c", 0, 1.0)], "symbol string, ts int, v double")
    got = {(r.symbol, r.ts): r for r in orderstats.rolling_order(df.withColumn("rank", F.lit("old")), "v", 10, {"q10": 0.1, "q75": 0.75}).collect()}
    assert len(got) == len(rows) + 1
    for s in "ab":
        mine = [v for k, _, v in rows if k == s]
        for t in range(150):
            window = mine[max(0, t - 9) : t + 1]
            r = got[s, t]
            if len(window) < 10 or any(v is None or v != v for v in window):
                assert r["rank"] is None and r.q10 is None
            else:
                assert r["rank"] == pytest.approx(sum(v <= mine[t] for v in window) / 10)
                assert (r.q10, r.q75) == pytest.approx((np.quantile(window, 0.1), np.quantile(window, 0.75)))


def test_implied_volatilities_are_dealt_to_tasks(spark, sf_dir):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rankings.implied_volatilities(spark, sf_dir).rdd.getNumPartitions() == n
