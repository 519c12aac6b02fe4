"""Readers, writers and streaming helpers on small files and tables."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from vereda.sources import readers, sinks
from vereda.streaming import ingest


def test_lines_of_split_files(spark, tmp_path):
    rng = random.Random(1)
    raw = b"".join(("é" * rng.randint(0, 30)).encode() + rng.choice([b"\n", b"\r\n"]) for _ in range(4000))
    (tmp_path / "a.txt").write_bytes(raw)
    (tmp_path / "b.txt").write_bytes(b"one\n\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, content in (("a.txt", raw), ("b.txt", b"one\n\ntwo")):
        want, at = [], 0
        for n, line in enumerate(content.split(b"\n")[: None if not content.endswith(b"\n") else -1], 1):
            want.append((n, at, line.rstrip(b"\r").decode()))
            at += len(line) + 1
        assert sorted((r.source_line, r.byte_offset, r.raw) for r in got if r.source_file.endswith(name)) == want


def test_listing(spark, tmp_path):
    for name in ("a.jsonl", "b.json", "c.txt"):
        (tmp_path / name).write_text("{}")
    names = lambda **k: [r.path.rsplit("/", 1)[1] for r in readers.listing(spark, str(tmp_path), **k).collect()]
    assert names() == ["a.jsonl"] and names(with_json=True) == ["a.jsonl", "b.json"] and names(pattern="?.txt") == ["c.txt"]


def test_kinds_of_card_files_are_found_out(spark, tmp_path):
    files = {"a.txt": "q1\tx\nq2\ty\n", "b.txt": "q :: a\n", "c.txt": "q | a\nr | b\n", "d.txt": "front\nback 1\nback 2\n\nf2\nb2\n", "e.csv": 'front,back\n"a, b",c\n', "f.json": '{"name":"d","cards":[{"q":"1","a":"2"},{"q":"3","a":""}]}', "g.txt": '{"front":"x","back":"y"}\n{"front":"z"}\n'}
    want = {"a.txt": 2, "b.txt": 1, "c.txt": 2, "d.txt": 2, "e.csv": 1, "f.json": 1, "g.txt": 1}
    for name, content in files.items():
        (tmp_path / name).write_text(content)
        assert readers.any_cards(spark, str(tmp_path / name)).count() == want[name], name
    assert readers.card_blocks(spark, str(tmp_path / "d.txt")).orderBy("front").first().back == "b2"


def test_struck_text_is_marked(spark):
    html = "<html><style>x</style><p>Art. 1 <s>old <b>text</b></s> new</p><span style='text-decoration:line-through'>gone</span></b><div>a&nbsp;&amp; b</div><script>z</script>"
    got = readers.html_pages(spark.createDataFrame([(1, html), (2, None)], "k int, html string"), "k").orderBy("k").collect()
    assert got[0].body == "Art. 1 ~~old text~~ new\n~~gone~~\na & b" and got[1].body == ""


def test_word_and_zip_files(spark, tmp_path):
    doc = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", doc)
    assert [(r.place, r.text) for r in readers.docx(spark, str(tmp_path / "a.docx")).orderBy("place").collect()] == [(0, "One two"), (1, "Three")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dfp_2024.csv", "CD;VL\n1;ação\n2;x\n".encode("latin-1"))
        z.writestr("other.csv", "CD;VL\n9;y\n")
    assert sorted((r.row["CD"], r.row["VL"]) for r in readers.zipped_csv(spark, str(tmp_path / "a.zip"), "dfp").collect()) == [("1", "ação"), ("2", "x")]


def test_price_regional_and_markdown_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ts,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,1,2,0.5,,10\n")
    assert [(r.symbol, r.close) for r in readers.bars_csv(spark, str(tmp_path / "p.csv"), "P").collect()] == [("P", 1.5)]
    (tmp_path / "r.csv").write_bytes("NOME;VALOR\nação;1,5\n".encode("latin-1"))
    assert readers.regional_csv(spark, str(tmp_path / "r.csv")).first().asDict() == {"NOME": "ação", "VALOR": "1,5"}
    (tmp_path / "m.md").write_text("# A title\n\nFonte: https://x.example/lei\n\n" + "text " * 20)
    (tmp_path / "s.md").write_text("short")
    got = readers.markdown(spark, str(tmp_path / "*.md")).collect()
    assert [(r.title, r.url) for r in got] == [("A title", "https://x.example/lei")]
    (tmp_path / "c.json").write_text('{"count": 42, "rows": []}')
    (tmp_path / "d.json").write_text("[]")
    assert sorted(r.n for r in readers.count_peek(spark, str(tmp_path / "[cd].json"), 7).collect()) == [7, 42]


def test_corpus_keeps_first_places(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 3, "z"), ("c", 4, "w")], "k string, at int, v string")
    sinks.corpus(new, old, "k", "at", str(tmp_path / "s"))
    assert sorted((r["at"], r.k, r.v) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, "a", "z"), (2, "b", "y"), (4, "c", "w")]


def test_copies_of_equal_names_get_other_names(spark):
    files = spark.createDataFrame([("/a/x.json",), ("/b/x.json",), ("/b/y.json",)], "path string")
    got = {r.path: r.name for r in sinks.preserved(files).collect()}
    assert got["/a/x.json"] == "x.json" and got["/b/y.json"] == "y.json" and got["/b/x.json"].startswith("x_") and got["/b/x.json"].endswith(".json")


def test_replacement_and_merges(spark):
    old = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1), ("w", 1)], "doc string, i int")
    new = spark.createDataFrame([("u", 9), ("v", 9)], "doc string, i int")
    plan = spark.createDataFrame([("u", "updated"), ("v", "skipped"), ("w", "removed")], "doc string, action string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(sinks.replaced(old, new, plan, "doc")) == [("u", 9), ("v", 1)]
    assert rows(sinks.replaced(old, new, plan, "doc", dry_run=True)) == rows(old)
    assert rows(sinks.merged_cache(old, new.withColumn("i", F.lit(1)), ["doc", "i"])) == [("u", 1), ("u", 2), ("v", 1), ("w", 1)]
    urls = spark.createDataFrame([("http://x.example/a/",)], "u string").select(sinks.url_forms(F.col("u")).alias("f")).first().f
    assert urls == ["http://x.example/a/", "http://x.example/a", "https://x.example/a"]
    cat = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    notes = spark.createDataFrame([("a", ""), ("b", "n"), ("c", "m")], "k string, v string")
    assert rows(sinks.sidecar(cat, notes, "k", ["v"])) == [("a", "x"), ("b", "n"), ("c", "m")]


def test_snapshots_and_degraded_results(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    sinks.upsert_snapshot(new, old, "k", str(tmp_path / "n"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "n")).collect()) == [("a", 1), ("b", 2), ("c", 2)]
    sinks.append_partitioned(new, str(tmp_path / "p"), "k")
    sinks.append_partitioned(old, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).filter("k = 'b'").count() == 2
    assert {r.stale for r in sinks.keep_if_covered(new, old, 4, "k").collect()} == {False}
    assert {(r.k, r.stale) for r in sinks.keep_if_covered(new, old, 5, "k").collect()} == {("a", True), ("b", True)}


def test_what_is_left_after_a_stop(spark):
    todo = spark.createDataFrame([(i,) for i in range(5)], "id int")
    done = spark.createDataFrame([(0,), (1,), (2,)], "id int")
    log = spark.createDataFrame([(1, "abandoned"), (2, "ok")], "id int, status string")
    left = lambda **k: sorted(r.id for r in ingest.resumed(todo, done, log, "id", **k).collect())
    assert left() == [1, 3, 4] and left(retry=False) == [3, 4]
    rows = iter([5, 0, 2, 0, 0, 9])
    assert ingest.until_idle(lambda: next(rows), idle=2) == 5


def test_records_of_cycles_and_the_outbox(spark):
    rows = spark.createDataFrame([("lei",), ("lei",), (None,)], "doc_type string")
    r = ingest.evolution(rows, 3).first()
    assert (r.by_type, r.total, r.cycle) == ('{"":1,"lei":2}', 3, 3)
    frame = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    got = ingest.outbox(frame(("a", 1)), frame(("b", 2), ("c", 2)), frame(("a", 1), ("b", 1), ("d", 1)), "k").collect()
    assert sorted(tuple(r) for r in got) == [("b", 2), ("c", 2), ("d", 1)]


def test_state_is_compacted(spark, tmp_path):
    rows = [("a", "1", 0), ("a", "2", 1), ("b", "1", 0)]
    spark.createDataFrame(rows, "external_id string, content_hash string, batch long").write.parquet(str(tmp_path / "s"))
    ingest.compact(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    assert sorted((r.external_id, r.content_hash) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", "2"), ("b", "1")]
