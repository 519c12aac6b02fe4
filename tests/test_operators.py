import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vereda.functions import numeric, text
from vereda.operators import allocation, catalogue, fifo, inference, merge, series
from vereda.plans import market
from vereda.sources import readers, sinks
from vereda.streaming import ingest


def test_ewm_equals_recursion(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000).cumsum() + 50
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "symbol string, ts int, close double")
    for a in (2 / 13, 1 / 14, 0.5):
        got = np.array([r.y for r in series.ewm(df, "close", "y", a).orderBy("ts").collect()])
        assert np.allclose(got, pd.Series(x).ewm(alpha=a, adjust=False).mean(), atol=1e-9)


def test_rsi_is_100_without_losses(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(40)], "symbol string, ts int, close double")
    assert series.rsi(df).filter("ts = 39").first().rsi == 100.0
    assert series.rsi(df, method="simple").filter("ts = 39").first().rsi == 100.0


def test_rolling_is_null_until_full(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(5)], "symbol string, ts int, close double")
    assert [r.m for r in df.select("ts", series.rolling(F.avg, F.col("close"), 3).alias("m")).orderBy("ts").collect()] == [None, None, 1.0, 2.0, 3.0]


def test_fifo_equals_queue(spark):
    rng = np.random.default_rng(2)
    trades = [("x", i, i, float(rng.integers(1, 50)), bool(rng.integers(0, 2)), int(rng.integers(1, 200))) for i in range(120)]
    df = spark.createDataFrame(trades, "asset string, trade long, at long, price double, buy boolean, qty long")
    got = sorted((r.buy_trade, r.sell_trade, r.qty) for r in fifo.matched(df).collect())
    queue, want = [], {}
    for _, i, _, _, buy, q in trades:
        while q and queue and queue[0][1] != buy:
            n = min(q, queue[0][2])
            pair = (i, queue[0][0]) if buy else (queue[0][0], i)
            want[pair] = want.get(pair, 0) + n
            queue[0][2] -= n
            q -= n
            if not queue[0][2]:
                queue.pop(0)
        if q:
            queue.append([i, buy, q])
    merged = {}
    for b, s, n in got:
        merged[(b, s)] = merged.get((b, s), 0) + n
    assert merged == want


def test_black_scholes_and_back(spark):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (("s", 100.0), ("k", 105.0), ("t", 0.25), ("r", 0.05), ("v", 0.3))])
    args = [F.col(c) for c in "sktrv"]
    call, put = df.select(numeric.black_scholes(F.lit(True), *args).alias("c"), numeric.black_scholes(F.lit(False), *args).alias("p")).first()
    assert abs((call - put) - (100 - 105 * math.exp(-0.05 * 0.25))) < 1e-4
    back = df.select(numeric.implied_spot(F.lit(True), F.lit(call), F.col("k"), F.col("t"), F.col("r"), F.col("v")).alias("x")).first().x
    assert abs(back - 100) < 1e-4


def test_implied_spot_of_the_whole_chain(spark, sf_dir):
    got = market.implied_spot_chain(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    for r in got:
        assert abs(r.implied - r.spot) < 5e-4 and abs(r.worth - r.premium) < 1e-9
    df = spark.createDataFrame([(False, 500.0), (False, -1.0), (True, 1e6), (True, 0.0), (True, 30.0)], "call boolean, premium double")
    found = df.select(numeric.implied_spot(F.col("call"), F.col("premium"), *[F.lit(x) for x in (100.0, 0.1, 0.05, 0.3)]).alias("x")).collect()
    assert [r.x is None for r in found] == [True, True, True, True, False]


def test_bisections_work_terms_out_once(spark):
    args = [F.lit(x) for x in (100.0, 0.1, 0.05, 0.3)]
    for found in (numeric.implied_spot(F.lit(True), F.col("p"), *args), numeric.implied_volatility(F.lit(True), F.col("p"), F.lit(100.0), *args[:3])):
        plan = spark.range(1).select(F.rand().alias("p")).select(found.alias("x"))._jdf.queryExecution().analyzed().toString()
        # lambdas repeat what is written again: one price in the step, three at the bounds
        assert 1 <= plan.upper().count("LN(") <= 4


def test_implied_spots_are_dealt_to_tasks(spark, sf_dir):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert market.implied_spot(spark, sf_dir).rdd.getNumPartitions() == n


def test_implied_chain_is_dealt_to_tasks(spark, sf_dir):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert market.implied_spot_chain(spark, sf_dir).rdd.getNumPartitions() == n


def test_answer_letters(spark):
    df = spark.createDataFrame([("0",), ("1",), ("5",), ("b",), ("Alternativa B correta",), ("",), (None,)], "k string")
    assert [r.x for r in df.select(text.answer_letter(F.col("k")).alias("x")).collect()] == ["A", "B", "E", "B", "B", None, None]


def test_urls(spark):
    df = spark.createDataFrame([("http://WWW.Site.br/Lei/?a=1#x",), ("site.br",), (None,), ("  ",)], "u string")
    got = df.select(text.url_lowered(F.col("u")).alias("a"), text.url_canonical(F.col("u")).alias("b")).collect()
    assert (got[0].a, got[0].b) == ("https://www.site.br/lei/?a=1", "https://www.site.br/Lei")
    assert got[1].b == "https://site.br/" and got[2].a == "" and got[3].b == ""


def test_repair_of_encoding(spark):
    df = spark.createDataFrame([("SÃºmula",), ("Súmula",), ("日本 Ã©",)], "t string")
    assert [r.x for r in df.select(text.repaired(F.col("t")).alias("x")).collect()] == ["Súmula", "Súmula", "日本 Ã©"]


def test_document_types(spark):
    m = "map('tribunal','STF','ementa','x')"
    df = spark.sql(f"SELECT 'candidato' AS k, map('a','b') AS m UNION ALL SELECT '', {m} UNION ALL SELECT NULL, map('alternativas','x','gabarito','B') UNION ALL SELECT '', map('z','')")
    assert [r.x for r in df.select(text.document_type(F.col("k"), F.col("m")).alias("x")).collect()] == ["legislacao", "jurisprudencia", "questoes_objetivas", None]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60))
def test_chunks_keep_everything(t, size):
    pieces = catalogue.cut(t, size)
    assert all(0 < len(p) <= size for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(t.split())


def test_merge_rules(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("y", 2, "b"), ("x", 3, "c")], "k string, seq int, v string")
    got = {r.k: (r.place, r.v) for r in merge.last_value_first_place(df, "k", "seq", ["v"]).collect()}
    assert got == {"x": (1, "c"), "y": (2, "b")}
    assert {r.k for r in merge.changed(df.select("k", "v"), df.filter("seq = 2").select("k", "v"), "k", "v").collect()} == {"x"}


def test_sequential_allocation_covers_units(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 0, 10, 4, 7])], "id int, units long")
    got = allocation.sequential(df, ["id"], "units", 5, 4).collect()
    assert sum(r.n for r in got) == 24
    day = {}
    for r in got:
        day[r.day] = day.get(r.day, 0) + r.n
    assert day == {0: 5, 1: 5, 2: 5, 3: 9}


def test_matching_equals_the_greedy_rule(spark):
    rng = np.random.default_rng(8)
    for n, specs in ((60, 6), (200, 25)):
        fits = [(int(i), int(s)) for i in range(n) for s in set(rng.integers(0, specs, rng.integers(0, 6)))]
        take = {s: int(rng.integers(0, 6)) for s in range(specs)}
        prio = {s: int(k) for s, k in enumerate(rng.permutation(specs))}
        df = spark.createDataFrame([*fits, fits[0], (None, 1)], "item int, spec int")
        places = spark.createDataFrame([(s, prio[s], take[s]) for s in range(specs)], "spec int, prio int, take int")
        used, want = set(), set()
        for s in sorted(range(specs), key=prio.get):
            mine = sorted(i for i, t in fits if t == s and i not in used)[: take[s]]
            used |= set(mine)
            want |= {(i, s, k + 1) for k, i in enumerate(mine)}
        assert {tuple(r) for r in allocation.matched(df, "item", places).collect()} == want
    assert allocation.matched(df.limit(0), "item", places).count() == 0


def test_json_lines_lineage(spark, tmp_path):
    raw = b'# note\n{"id": "a", "v": 1}\r\n\nnot json\n[1]\n{"id": "b"}'
    (tmp_path / "x.jsonl").write_bytes(raw)
    got = readers.json_lines(spark, str(tmp_path)).select("source_line", "byte_offset", "payload_sha256", F.variant_get("record", "$.id", "string").alias("id")).orderBy("source_line").collect()
    assert [(r.source_line, r.id) for r in got] == [(2, "a"), (6, "b")]
    import hashlib

    assert got[0].byte_offset == raw.index(b"{") and got[0].payload_sha256 == hashlib.sha256(b'{"id": "a", "v": 1}').hexdigest()


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x":1},2,{"x":3}]')
    (tmp_path / "b.json").write_text('{"x":5}')
    (tmp_path / "c.json").write_text("{")
    got = readers.json_files(spark, str(tmp_path)).select("index", F.variant_get("record", "$.x", "int").alias("x")).collect()
    assert sorted((r["index"], r.x) for r in got) == [(0, 1), (0, 5), (2, 3)]


def test_fixed_width(spark, tmp_path):
    line = [" "] * 210
    for at, value in ((3, "20240102"), (13, "PRIOA50"), (25, "070"), (57, "0000000001234"), (109, "0000000002500"), (148, "00012"), (189, "0000000005000"), (203, "20240119")):
        line[at - 1 : at - 1 + len(value)] = value
    (tmp_path / "q.txt").write_text("".join(line) + "\nshort\n", encoding="latin-1")
    r = readers.fixed_width(spark, str(tmp_path), ["PETR", "PRIO"]).collect()
    assert len(r) == 1 and (r[0].open, r[0].close, r[0].strike, r[0].tipo, r[0].asset) == (12.34, 25.0, 50.0, "CALL", "PRIO")


def test_flash_cards(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Frente,Verso\n"a, b",c\n,x\n')
    (tmp_path / "b.txt").write_text("q1 :: a1\nbad\n")
    assert [(r.front, r.back) for r in readers.flash_cards(spark, str(tmp_path / "a.csv"), "csv").collect()] == [("a, b", "c")]
    assert [(r.front, r.back) for r in readers.flash_cards(spark, str(tmp_path / "b.txt"), "colons").collect()] == [("q1", "a1")]


def test_manifest_and_actions(spark):
    df = spark.sql("SELECT 'a' AS external_id, 't' AS title, 'b' AS body, 'lei' AS doc_type, map('ai_x','1','y','2') AS meta")
    made = json.loads(sinks.manifest(df).first().json)
    assert made["derivative"] == {"ai_x": "1"} and made["organization"]["organized"] == {"y": "2"}
    rows = spark.createDataFrame([("a", "h1", 50), ("b", "h2", 5), ("c", "h3", 50)], "k string, h string, n int")
    state = spark.createDataFrame([("a", "h1"), ("d", "h"), ("c", "old")], "k string, h string")
    assert {r.k: r.action for r in sinks.actions(rows, state, "k", "h", "n", 10).collect()} == {"a": "skipped", "b": "error", "c": "updated", "d": "removed"}


def test_stream_skips_what_it_knows(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"id":"a","texto":"x"}\n{"id":"b","texto":"y"}\n')
    run = lambda: ingest.ingest(ingest.line_stream(spark, src).transform(ingest.records), out, state, str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "2.jsonl").write_text('{"id":"a","texto":"x"}\n{"id":"b","texto":"new"}\n# c\n')
    run()
    got = spark.read.parquet(out)
    assert sorted((r.external_id, r.body) for r in got.collect()) == [("a", "x"), ("b", "new"), ("b", "y")]


def plain_weights(x, y):
    """Ridge logistic regression row by row: plain gradient steps until they vanish."""
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) + np.array([0, inference.RIDGE]) * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag([0, inference.RIDGE])
        w = w - np.linalg.solve(curve, slope)
        if np.abs(slope).max() < 1e-12:
            break
    return w


def plain_skill(x, y, day):
    """Each day's rows from a fit of the other days, day by day."""
    guess, base = np.zeros(len(y)), np.zeros(len(y))
    for d in set(day):
        rest = day != d
        base[~rest] = y[rest].mean()
        guess[~rest] = 1 / (1 + np.exp(-x[~rest] @ plain_weights(x[rest], y[rest]))) if rest.sum() >= inference.LEAST else base[~rest]
    return 1 - ((guess - y) ** 2).mean() / ((base - y) ** 2).mean()


def test_resampling_equals_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(d, x, float(np.clip(rng.normal(0.4 + 0.25 * x, 0.2), 0, 1))) for d in range(12) for x in (0, 1) if rng.random() < 0.9]
    df = spark.createDataFrame([(f"d{d:02d}", x, y) for d, x, y in rows], "day string, x int, y double")
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    x, y, day = np.array([[1.0, r[1]] for r in order]), np.array([r[2] for r in order]), np.array([r[0] for r in order])
    real = plain_skill(x, y, day)
    shuffled = [plain_skill(x, np.random.default_rng([7, i]).permutation(y), day) for i in range(60)]
    got = inference.permutation(df, replicas=60).first()
    assert got.skill == pytest.approx(real, abs=1e-7) and got.replicas == 60
    assert got.p == pytest.approx((sum(s >= real for s in shuffled) + 1) / 61)
    days = sorted(set(day))
    made = {0.0: [], 1.0: []}
    for i in range(80):
        drawn = [days[k] for k in np.random.default_rng([7, i]).integers(0, len(days), len(days))]
        at = np.concatenate([np.flatnonzero(day == d) for d in drawn])
        w = plain_weights(x[at], y[at])
        for g, out in made.items():
            out.append(1 / (1 + np.exp(-(w[0] + g * w[1]))))
    for r in inference.bootstrap(df, replicas=80).collect():
        assert (r.low, r.high) == pytest.approx(tuple(np.quantile(made[r.x], (0.025, 0.975))), abs=1e-6)


def test_ridge_and_skill():
    rng = np.random.default_rng(3)
    x = np.column_stack((np.ones(200), rng.integers(0, 2, 200)))
    y = np.clip(0.3 + 0.4 * x[:, 1] + rng.normal(0, 0.05, 200), 0, 1)
    w = inference.fit(x, y)
    gradient = x.T @ (inference.predict(x, w) - y) + np.array([0, inference.RIDGE]) * w
    assert np.abs(gradient).max() < 1e-6
    assert inference.skill(*inference.leave_one_day_out(x, y, np.arange(200) // 10), y) > 0.5


def test_bisection_of_the_spot_has_no_spotless_terms(spark):
    found = numeric.implied_spot(F.lit(True), F.col("p"), *[F.lit(x) for x in (100.0, 0.1, 0.05, 0.3)])
    plan = spark.range(1).select(F.rand().alias("p")).select(found.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("SQRT(") == 1  # worked out once a row, not once a step
