"""Writers: snapshots that replace each other, partitioned appends, nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge


def upsert_snapshot(new: DataFrame, old: DataFrame | None, key: str, path: str) -> None:
    """Write the next snapshot: new rows replace old ones by key.  ``path`` is a new folder;
    readers move to it when it is complete."""
    (merge.upsert(old, new, key) if old is not None else new).write.parquet(path)


def append_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Append under one folder for each value; rows of a value are written by few tasks."""
    rows.repartition(*by).write.partitionBy(*by).mode("append").parquet(path)


def manifest(rows: DataFrame, derived_prefix: str = "ai") -> DataFrame:
    """(external_id, json): verbatim fields, organisation and derivatives apart; keys of
    ``meta`` that begin with ``derived_prefix`` are derivatives."""
    derived = lambda k, _: k.startswith(derived_prefix)
    body = F.struct(
        "external_id",
        F.struct("title", "body").alias("verbatim"),
        F.struct("doc_type", F.map_filter("meta", lambda k, v: ~derived(k, v)).alias("organized")).alias("organization"),
        F.map_filter("meta", derived).alias("derivative"),
    )
    return rows.select("external_id", F.to_json(body).alias("json"))


def keep_if_covered(new: DataFrame, previous: DataFrame, universe: int, key: str) -> DataFrame:
    """The previous result, marked stale, where the new one covers under half the universe."""
    enough = new.select(key).distinct().count() * 2 >= universe
    return (new if enough else previous).withColumn("stale", F.lit(not enough))


def actions(rows: DataFrame, state: DataFrame, key: str, digest: str, length: str, least: int) -> DataFrame:
    """What to do with each document: error (too short), skipped (same hash), updated, removed."""
    s = state.select(F.col(key).alias("_k"), F.col(digest).alias("_h"))
    j = rows.join(s, F.col(key) == F.col("_k"), "full_outer")
    action = F.when(F.col(key).isNull(), "removed").when(F.col(length) < least, "error").when(F.col(digest) == F.col("_h"), "skipped").otherwise("updated")
    return j.select(F.coalesce(key, "_k").alias(key), action.alias("action"))


def corpus(new: DataFrame, old: DataFrame | None, key: str, at: str, path: str) -> None:
    """The next snapshot of a corpus in which a key's last value stands at the place of its first:
    ``old(key, at, ...)`` and ``new`` are ordered by ``at``."""
    rows = new if old is None else old.unionByName(new)
    columns = [c for c in rows.columns if c != key]
    kept = merge.last_value_first_place(rows, key, at, columns).drop(at).withColumnRenamed("place", at)
    kept.write.parquet(path)


def preserved(files: DataFrame) -> DataFrame:
    """(path, name) for copies of files: their own names, and for names that several files have a
    prefix of the path's SHA-256 before the ending."""
    own = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select("path", own.alias("own")).distinct()
    again = rows.groupBy("own").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    suffix = F.concat(F.regexp_extract("own", r"^(.*?)(\.[^.]*)?$", 1), F.lit("_"), F.substring(F.sha2("path", 256), 1, 8), F.regexp_extract("own", r"(\.[^.]*)?$", 1))
    return rows.join(again, "own").select("path", F.when((F.col("n") == 1) | (F.col("path") == F.col("first")), F.col("own")).otherwise(suffix).alias("name"))


def merged_cache(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and new rows, of equal keys the new one."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def sidecar(catalogue: DataFrame, notes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The catalogue with fields of a sidecar written over it where they are known; keys that
    only the sidecar has are added."""
    return merge.filled_from(catalogue.select(key, *columns), notes.select(key, *columns), key, columns)


def replaced(old: DataFrame, new: DataFrame, planned: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """The chunks after a replacement: those of documents that ``planned(key, action)`` updates or
    removes go, the new chunks of updated ones come.  A dry run changes nothing."""
    if dry_run:
        return old
    gone = planned.filter(F.col("action").isin("updated", "removed")).select(key)
    come = planned.filter("action = 'updated'").select(key)
    return old.join(gone, key, "left_anti").unionByName(new.join(come, key, "left_semi"))


def url_forms(url):
    """The three forms under which a document's chunks may be stored."""
    bare = F.regexp_replace(F.trim(url), "/+$", "")
    return F.array_distinct(F.array(F.trim(url), bare, F.regexp_replace(bare, "(?i)^http://", "https://")))
