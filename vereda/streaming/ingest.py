"""Incremental ingestion: a folder as a stream, state of hashes, and windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of new files with the file that each came from."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("source_file")).filter("line <> '' and not startswith(line, '#')")


def records(lines: DataFrame) -> DataFrame:
    """(external_id, content_hash, body) of JSON objects; other lines are skipped."""
    get = lambda name: F.try_variant_get("record", f"$.{name}", "string")
    rows = lines.withColumn("record", F.try_parse_json("line")).filter(F.schema_of_variant("record").startswith("OBJECT"))
    body = F.coalesce(get("texto"), get("body"), get("text"), F.lit(""))
    key = F.coalesce(get("id"), get("external_id"), F.substring(F.sha2(body, 256), 1, 32))
    return rows.select(key.alias("external_id"), F.sha2(body, 256).alias("content_hash"), body.alias("body"))


def ingest(stream: DataFrame, out: str, state: str, checkpoint: str) -> StreamingQuery:
    """Write what is new or changed, then note its hashes.

    A batch first drops what the state holds, then writes its output under the batch's number
    (so a repeated batch replaces itself), and appends to the state last.  A crash in between
    repeats a batch, which changes nothing.  The state is compacted by ``current``.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = merge.best(df, ["external_id"], F.col("content_hash"), ["content_hash", "body"])
        known = spark.read.schema("external_id string, content_hash string, batch long").parquet(state)
        fresh = merge.changed(rows, current(known.filter(F.col("batch") < number)), "external_id", "content_hash")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done = spark.read.parquet(f"{out}/batch={number}")
        done.select("external_id", "content_hash", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(state)

    spark = stream.sparkSession
    spark.createDataFrame([], "external_id string, content_hash string, batch long").write.mode("append").parquet(state)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(state: DataFrame) -> DataFrame:
    """The latest hash of each key."""
    return merge.best(state, ["external_id"], F.col("batch"), ["content_hash"])


def windowed(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Counts and means by event-time window and kind, for streams and tables alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", window).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def compact(spark: SparkSession, state: str, path: str) -> None:
    """Write the latest hash of each key to a new folder; readers move to it when it is complete."""
    current(spark.read.parquet(state)).select("external_id", "content_hash", F.lit(-1).cast("long").alias("batch")).write.parquet(path)


def resumed(todo: DataFrame, done: DataFrame, log: DataFrame, key: str, retry: bool = True) -> DataFrame:
    """What is left to do: rows that are not done, and, with ``retry``, those too that the log
    calls abandoned even where an output exists."""
    abandoned = log.filter("status = 'abandoned'").select(key).distinct()
    finished = done.select(key).distinct()
    if retry:
        finished = finished.join(abandoned, key, "left_anti")
    return todo.join(finished, key, "left_anti")


def until_idle(cycle, idle: int = 3, most: int = 1000) -> int:
    """Run ``cycle()`` (which gives the number of rows it wrote) until so many cycles in a row wrote
    none; the number of cycles."""
    quiet = 0
    for n in range(1, most + 1):
        quiet = 0 if cycle() else quiet + 1
        if quiet >= idle:
            return n
    return most


def evolution(rows: DataFrame, cycle: int) -> DataFrame:
    """One record of a cycle: how many rows of each type, with sorted names, as JSON."""
    g = rows.groupBy("doc_type").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.coalesce("doc_type", F.lit("")).alias("key"), F.col("n").alias("value"))))
    return g.agg(F.to_json(F.map_from_entries(pairs)).alias("by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("cycle", F.lit(cycle))


def outbox(sent: DataFrame, failed: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """The outbox after a round: what waited, without what was sent, and with what failed; the
    newest of equal keys stays."""
    return merge.upsert(pending.join(sent.select(key), key, "left_anti"), failed, key)
