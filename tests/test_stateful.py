"""Keyed state, paged sources and incremental views: restarts, late rows, expiry, changes."""

import datetime
import json
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from vereda.operators import views
from vereda.sources.paged import PagedSource
from vereda.streaming import state

ROWS = "external_id string, content_hash string, body string, at timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def step(spark, folder, rows, make):
    """New input, then all of it through the query, which starts anew from its checkpoint."""
    if rows:
        spark.createDataFrame(rows, make.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(make.schema).parquet(f"{folder}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def test_hash_state_over_restarts_late_rows_and_expiry(spark, tmp_path):
    make = lambda s: state.tracked(s, keep="60 minutes", late="10 minutes")
    make.schema = ROWS
    folder = str(tmp_path)
    out = step(spark, folder, [("a", "1", "x", at(0)), ("a", "2", "y", at(1)), ("b", "1", "x", at(0))], make)
    assert {(r.external_id, r.content_hash, r.action) for r in out} == {("a", "2", "new"), ("b", "1", "new")}
    # unchanged, changed, older than the state's
    out = step(spark, folder, [("a", "2", "y", at(5)), ("b", "9", "z", at(6)), ("a", "1", "old", at(0))], make)
    assert {(r.external_id, r.content_hash, r.body, r.action) for r in out if r.action == "changed"} == {("b", "9", "z", "changed")} and len(out) == 3
    # the clock moves on: a and b expire, and what comes too late is dropped
    step(spark, folder, [("c", "1", "x", at(200))], make)
    out = step(spark, folder, [("d", "1", "late", at(3)), ("c", "1", "x", at(201))], make)
    assert {(r.external_id, r.content_hash) for r in out if r.action == "expired"} == {("a", "2"), ("b", "9")}
    assert not [r for r in out if r.external_id == "d"]
    out = step(spark, folder, [("a", "2", "back", at(202))], make)
    assert [r.body for r in out if r.external_id == "a" and r.action == "new"].count("back") == 1
    n = len(out)
    assert len(step(spark, folder, [], make)) == n  # a restart without input repeats nothing


def test_last_good_value(spark, tmp_path):
    make = lambda s: state.last_good(s, ttl="30 minutes")
    make.schema = "name string, value double, at timestamp"
    folder = str(tmp_path)
    out = step(spark, folder, [("x", 1.5, at(0)), ("x", None, at(10)), ("y", None, at(0))], make)
    assert {(r.name, r.value, r.stale) for r in out} == {("x", 1.5, False), ("y", None, True)}
    out = step(spark, folder, [("x", None, at(50)), ("y", 2.0, at(50)), ("y", 7.0, at(40))], make)
    assert {(r.name, r.value, r.stale) for r in out if r.asked_at == at(50)} == {("x", 1.5, True), ("y", 2.0, False)}


def test_bulk_and_snapshots(spark, tmp_path):
    groups = spark.createDataFrame([(k, k % 3) for k in range(10)], "k int, o int")
    cache = spark.createDataFrame([(0,), (3,)], "k int")
    assert [r.k for r in state.bulk(groups, cache, "k", ["o"], 3).collect()] == [6, 9, 1]
    assert [r.k for r in state.bulk(groups, cache, "k", ["o"], 3, force=True).collect()] == [0, 3, 6]
    for n in range(4):
        state.add_snapshot(spark.createDataFrame([("m", float(n)), ("w", -float(n))], "metric string, value double"), str(tmp_path / "s"), f"2024-01-0{n + 1}")
    got = {(r.metric, r.value, r.place) for r in state.latest_snapshots(spark, str(tmp_path / "s"), 2).collect()}
    assert got == {("m", 3.0, 1), ("m", 2.0, 2), ("w", -3.0, 1), ("w", -2.0, 2)}


@pytest.fixture
def service():
    table = {i: {"id": i, "name": f"n{i}", "extra": [i]} for i in random.Random(3).sample(range(1, 5000), 1234)}
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            low, high = int(q.get("after", -1)), int(q.get("upto", 1 << 60))
            asked.append((low, high))
            body = json.dumps([table[i] for i in sorted(table) if low < i <= high][: int(q["limit"])]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield table, asked, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("parts", [1, 5])
def test_paged_batch(spark, service, parts):
    table, asked, url = service
    spark.dataSource.register(PagedSource)
    read = spark.read.format("paged").schema("id long, name string").option("url", url).option("limit", 100).option("partitions", parts).option("lower", 500).option("upper", 4000)
    df = read.load()
    assert df.rdd.getNumPartitions() == parts
    assert sorted((r.id, r.name) for r in df.collect()) == [(i, f"n{i}") for i in sorted(table)]
    assert len({low for low, _ in asked}) >= 13 or parts == 1


def test_paged_stream_gives_every_row_once(spark, service, tmp_path):
    table, _, url = service
    spark.dataSource.register(PagedSource)

    def run():
        s = spark.readStream.format("paged").schema("id long, name string").option("url", url).option("limit", 100).option("pagesPerBatch", 3).load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert run() == sorted(table)
    for i in range(6000, 6450):
        table[i] = {"id": i, "name": "later"}
    assert run() == sorted(table)
    assert run() == sorted(table)


def test_view_equals_recomputation(spark, tmp_path):
    rng = random.Random(6)
    view = views.View(["k"], {"total": "v"}, {"first": "t"}, {"last": "t"}, buckets=8)
    schema = "id int, k string, v bigint, t string"
    row = lambda i: (i, rng.choice(["a", "b", "c", None, *(f"k{n}" for n in range(40))]), rng.choice([None, *range(-5, 50)]), f"{rng.randrange(1000):04d}")
    base = {i: row(i) for i in range(400)}
    df = lambda rows: spark.createDataFrame(list(rows), schema)
    root = str(tmp_path / "v")
    views.create(view, df(base.values()), root)
    kept = {}
    for turn in range(4):
        gone, come = [], []
        for i in rng.sample(sorted(base), 25):
            gone.append(base.pop(i))
            if rng.random() < 0.5:
                base[i] = row(i)
                come.append(base[i])
        new = [row(1000 * (turn + 1) + n) for n in range(20)] if turn < 3 else []
        base |= {r[0]: r for r in new}
        if turn == 2:
            gone += [r for r in base.values() if r[1] == "k7"]  # a whole key goes
            base = {i: r for i, r in base.items() if r[1] != "k7"}
            come = [r for r in come if r[1] != "k7"]
            new = [r for r in new if r[1] != "k7"]
            gone = [r for r in gone if not (r[1] == "k7" and r[0] >= 3000)]
        version = views.refresh(view, df(gone), df(come + new), df(base.values()), root)
        assert version == turn + 1
        rows = lambda d: sorted((tuple(r) for r in d.select(*view.names).collect()), key=str)
        kept[version] = rows(views.computed(view, df(base.values())))
        assert rows(views.current(spark, view, df(base.values()), root)) == kept[version]
    assert rows(views.current(spark, view, df(base.values()), root, 2)) == kept[2]
    before = views._layout(spark, root, None)[1]
    assert views.refresh(view, df([]), df([]), df(base.values()), root) == 5
    one = next(r for r in base.values() if r[1] == "a")
    views.refresh(view, df([one]), df([(one[0], "a", 99, "zzz")]), df([r for r in base.values() if r is not one] + [(one[0], "a", 99, "zzz")]), root)
    assert sum(before[b] != f for b, f in views._layout(spark, root, None)[1].items()) == 1  # one bucket is rewritten
