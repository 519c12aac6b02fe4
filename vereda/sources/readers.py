"""Tolerant readers: lines, JSON, Markdown, fixed-width and delimited files.

Paths are only ever opened by Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def listing(spark: SparkSession, path: str, pattern: str = "*.jsonl", with_json: bool = False) -> DataFrame:
    """(path, length, modified) of the files that fit, each once, whatever their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    like = lambda glob: "^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    wanted = name.rlike(like(pattern)) | (F.lit(with_json) & name.rlike(r"\.json$"))
    return files.filter(wanted).dropDuplicates(["path"]).orderBy("path")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_line, byte_offset, raw) of every line; raw is without CR and LF.

    Files are read as text and split among tasks.  The lines of a split are numbered there, and
    a split starts with the lines and bytes of the splits before it: one row for each split."""
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("_size", F.octet_length("value") + 1)
    inside = Window.partitionBy("source_file", "_block").orderBy("_at")
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_file", "_block").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    starts = sums.select("source_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    rows = rows.join(starts, ["source_file", "_block"])
    number, offset = F.col("_n") + F.row_number().over(inside), F.col("_s") + F.sum("_size").over(inside) - F.col("_size")
    return rows.select("source_file", number.alias("source_line"), offset.alias("byte_offset"), F.regexp_replace("value", r"\r+$", "").alias("raw"))


def json_lines(spark: SparkSession, path: str, lineage: bool = True) -> DataFrame:
    """JSON objects of a JSONL folder as variants.

    Blank lines, lines that begin with ``#``, invalid JSON and non-objects are skipped.  With
    ``lineage`` each row has its file, line, byte offset and the SHA-256 of its raw bytes.
    """
    if lineage:
        rows = lines(spark, path).filter(F.is_valid_utf8("raw")).withColumn("payload_sha256", F.sha2("raw", 256)).withColumnRenamed("raw", "line")
    else:
        rows = spark.read.text(path).withColumnRenamed("value", "line")
    rows = rows.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("record", F.try_parse_json("line"))
    return rows.filter(F.schema_of_variant("record").startswith("OBJECT")).drop("line")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files: an array gives a row for each object, an object one row."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    parsed = files.withColumn("record", F.try_parse_json("value")).filter("record is not null")
    kind = F.schema_of_variant("record")
    one = parsed.filter(kind.startswith("OBJECT")).select("source_file", F.lit(0).alias("index"), "record")
    parsed.filter(kind.startswith("ARRAY")).createOrReplaceTempView("_json_arrays")
    many = spark.sql("SELECT source_file, e.pos AS index, e.value AS record FROM _json_arrays, LATERAL variant_explode(record) AS e").filter(F.schema_of_variant("record").startswith("OBJECT"))
    return one.unionByName(many).withColumn("payload_sha256", F.sha2(F.to_json("record"), 256))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files of at least forty characters: their URL and title."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.trim("value").alias("body")).filter(F.length("body") >= 40)
    head = F.array_join(F.slice(F.split("body", "\n"), 1, 12), "\n")
    url = text.first_known(F.regexp_extract("body", r"(?im)^key:\s*(https?://\S+)", 1), F.regexp_extract("body", r"(?im)^\**Fonte:?\**:?\s*<?(https?://[^\s>]+)", 1), F.regexp_extract("body", r"(https?://[^\s)>\]]+)", 1))
    return files.select("source_file", url.alias("url"), text.blank_to_null(F.regexp_extract(head, r"(?m)^# +(.+)$", 1)).alias("title"), "body")


#: Fixed values of the exchange's record: name, first place (from 1), width, decimals.
QUOTE_LAYOUT = [("data", 3, 8, None), ("cod", 13, 12, None), ("market", 25, 3, None), ("open", 57, 13, 2), ("close", 109, 13, 2), ("neg", 148, 5, 0), ("qtd", 153, 18, 0), ("vol", 171, 18, 2), ("strike", 189, 13, 2), ("venc", 203, 8, None)]


def fixed_width(spark: SparkSession, path: str, roots: list[str] | None = None) -> DataFrame:
    """Option quotes of fixed-width lines; lines under 210 characters are dropped.

    ``roots`` keeps option markets whose code begins with one of them; the first that fits
    names the asset."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).filter(F.length("value") >= 209)

    def field(name: str, at: int, width: int, decimals: int | None):
        s = F.trim(F.substring("value", at, width))
        if decimals is None:
            return s.alias(name)
        return (F.coalesce(s.try_cast("double"), F.lit(0.0)) / 10**decimals).alias(name)

    rows = lines.select(*[field(*f) for f in QUOTE_LAYOUT])
    for c in ("data", "venc"):
        rows = rows.withColumn(c, F.try_to_date(c, "yyyyMMdd"))
    rows = rows.withColumn("tipo", F.when(F.col("market") == "070", "CALL").otherwise("PUT"))
    if roots:
        asset = F.coalesce(*[F.when(F.col("cod").startswith(r), r) for r in roots])
        rows = rows.filter(F.col("market").isin("070", "080")).withColumn("asset", asset).filter("asset is not null")
    return rows


BARS = T.StructType([T.StructField("ts", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])


def bars_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A price file with an explicit schema; NaN becomes NULL, rows without a close go."""
    df = spark.read.csv(path, header=True, schema=BARS, enforceSchema=True)
    clean = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in BARS.fieldNames()[1:]]
    return df.select(F.lit(symbol).alias("symbol"), "ts", *clean).filter("close is not null")


def regional_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated Latin-1 text, every column a string."""
    return spark.read.csv(path, header=True, sep=";", encoding="ISO-8859-1", inferSchema=False)


def flash_cards(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(front, back) from ``jsonl``, ``csv``, ``tsv``, ``pipe`` or ``colons`` files; rows without both go."""
    if kind == "jsonl":
        rec = json_lines(spark, path, lineage=False)
        pick = lambda *names: text.first_known(*[F.try_variant_get("record", f"$.{n}", "string") for n in names])
        rows = rec.select(pick("front", "frente", "pergunta", "question", "q").alias("front"), pick("back", "verso", "resposta", "answer", "a").alias("back"))
    elif kind == "csv":
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        names = {c.lower(): c for c in rows.columns}
        find = lambda *options: next((F.col(f"`{names[o]}`") for o in options if o in names), F.lit(None).cast("string"))
        rows = rows.select(find("front", "frente", "pergunta").alias("front"), find("back", "verso", "resposta").alias("back"))
    else:
        sep = {"tsv": "\t", "pipe": r"\|", "colons": "::"}[kind]
        parts = F.split("value", sep, 2)
        rows = spark.read.text(path).select(F.trim(F.get(parts, F.lit(0))).alias("front"), F.trim(F.get(parts, F.lit(1))).alias("back"))
    return rows.select(text.blank_to_null(F.col("front")).alias("front"), text.blank_to_null(F.col("back")).alias("back")).filter("front is not null and back is not null")


def sniffed(sample: str, name: str = "") -> str:
    """What kind of card file a sample of its text is: by its name, else by its first lines."""
    for end, kind in ((".jsonl", "jsonl"), (".json", "json"), (".tsv", "tsv")):
        if name.lower().endswith(end):
            return kind
    lines_ = [x.strip() for x in sample.splitlines() if x.strip()][:5]
    first = lines_[0] if lines_ else ""
    if first.startswith("["):
        return "json"
    if first.startswith("{"):
        return "jsonl" if all(x.startswith("{") for x in lines_) else "json"
    for sep, kind in (("\t", "tsv"), ("::", "colons"), ("|", "pipe")):
        if lines_ and all(sep in x for x in lines_):
            return kind
    return "blocks" if "\n\n" in sample and not any("," in x for x in lines_) else "csv"


def card_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(front, back) of text whose cards are parted by blank lines: first line and the rest."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.trim(F.regexp_replace("value", r"^\n+|\n+$", "")).alias("b"))
    parts = F.split("b", "\n", 2)
    return blocks.select(text.blank_to_null(F.get(parts, F.lit(0))).alias("front"), text.blank_to_null(F.get(parts, F.lit(1))).alias("back")).filter("front is not null and back is not null")


def any_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a file whose kind is found out from its first lines."""
    sample = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())
    kind = sniffed(sample, path)
    if kind == "blocks":
        return card_blocks(spark, path)
    if kind == "json":
        rec = json_files(spark, path)
        inner = F.coalesce(F.try_variant_get("record", "$.cards", "array<variant>"), F.array(F.col("record")))
        pick = lambda *names: text.first_known(*[F.try_variant_get("c", f"$.{n}", "string") for n in names])
        rows = rec.select(F.explode(inner).alias("c"))
        return rows.select(pick("front", "frente", "pergunta", "q").alias("front"), pick("back", "verso", "resposta", "a").alias("back")).filter("front is not null and back is not null")
    return flash_cards(spark, path, kind)


def count_peek(spark: SparkSession, path: str, fallback: int = 0) -> DataFrame:
    """(source_file, n): the count that a JSON file states in its first 800 characters."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.substring("value", 1, 800).alias("head"))
    return files.select("source_file", F.coalesce(F.regexp_extract("head", r'"count"\s*:\s*(\d+)', 1).try_cast("int"), F.lit(fallback)).alias("n"))


class _Struck(HTMLParser):
    """Text of a page; blocks end lines, and what is struck out stands between ~~."""

    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "ul", "ol", "blockquote"}
    STRIKES = {"s", "strike", "del"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        struck = tag in self.STRIKES or (tag == "span" and "line-through" in (dict(attrs).get("style") or ""))
        if tag in self.BLOCKS:
            self.out.append("\n")
        elif tag in self.STRIKES or tag == "span":
            self.open.append((tag, struck))
            if struck:
                self.out.append("~~")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BLOCKS:
            self.out.append("\n")
        for i in range(len(self.open) - 1, -1, -1):  # the innermost of that name; a stray one is ignored
            if self.open[i][0] == tag:
                if self.open.pop(i)[1]:
                    self.out.append("~~")
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def struck_text(html: str | None) -> str:
    parser = _Struck()
    parser.feed(html or "")
    parser.close()
    rows = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(rows)).strip()


def html_pages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, body) with struck-out text marked.  Tags nest, so the parser runs in Python on
    Arrow batches."""
    kind = pages.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({key: b.column(key), "body": pa.array([struck_text(x) for x in b.column(html).to_pylist()], pa.string())})

    return pages.select(key, html).mapInArrow(rows, f"{key} {kind}, body string")


def _paragraphs(content: bytes) -> list[str]:
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ["".join(t.text or "" for t in p.iter(name + "t")).strip() for p in root.iter(name + "p")]
    return [p for p in found if p]


def docx(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, place, text): the paragraphs of Word files that are not blank."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = _paragraphs(content)
                yield pa.record_batch({"source_file": pa.array([file] * len(found), pa.string()), "place": pa.array(range(len(found)), pa.int32()), "text": pa.array(found, pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "source_file string, place int, text string")


def zipped_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(source_file, row): rows of the members of ZIP files whose name holds ``member``, as maps
    of strings; semicolons, Latin-1."""
    import csv

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if member in n):
                        with z.open(name) as f:
                            held = []
                            for r in csv.DictReader(io.TextIOWrapper(f, "ISO-8859-1", newline=""), delimiter=";"):
                                held.append([(k, v) for k, v in r.items() if k])
                                if len(held) == 4096:
                                    yield _maps(file, held)
                                    held = []
                            if held:
                                yield _maps(file, held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "source_file string, row map<string,string>")


def _maps(file: str, rows: list) -> pa.RecordBatch:
    return pa.record_batch({"source_file": pa.array([file] * len(rows), pa.string()), "row": pa.array(rows, pa.map_(pa.string(), pa.string()))})


def last_per_file_order(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with the same key the one of the last file, then of the last line."""
    w = Window.partitionBy(key).orderBy(F.desc("source_file"), F.desc("source_line"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
