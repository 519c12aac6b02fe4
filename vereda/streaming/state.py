"""Keyed state with timers: hashes that expire, values with a last good one, bounded bulk runs.

Spark keeps the state (RocksDB, with a changelog in the checkpoint) and deals keys to tasks, so a
batch touches the keys that it has and not the whole state; state and output move on together,
so a restart neither loses nor repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.identity import top_of_each

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Stateful operators need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _millis(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def _stamp(millis: int) -> pd.Timestamp:
    return pd.Timestamp(millis, unit="ms")


class _Hashes(StatefulProcessor):
    """Newest hash of a key, forgotten ``keep`` milliseconds of event time after it was last seen."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "content_hash string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for frame in rows:  # the newest row alone is held, however many a key has
            row = frame.sort_values(["at", "content_hash"]).iloc[-1]
            if newest is None or (row["at"], row["content_hash"]) > (newest["at"], newest["content_hash"]):
                newest = row
        at, old = _millis(newest["at"]), self.seen.get() if self.seen.exists() else None
        if old and at < old[1]:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + self.keep)
        self.seen.update((newest["content_hash"], at))
        if not old or old[0] != newest["content_hash"]:
            yield pd.DataFrame({"external_id": [key[0]], "content_hash": [newest["content_hash"]], "body": [newest["body"]], "at": [newest["at"]], "action": ["changed" if old else "new"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"external_id": [key[0]], "content_hash": [old[0]], "body": [None], "at": [_stamp(expiredTimerInfo.getExpiryTimeInMs())], "action": ["expired"]})

    def close(self) -> None:
        pass


def tracked(stream: DataFrame, keep: str = "7 days", late: str = "1 hour") -> DataFrame:
    """``stream(external_id, content_hash, body, at)`` → what is new, changed or expired, with
    ``action``.  A batch gives at most one row of a key: its newest one, if its hash differs from
    the state's.  Rows older than the state's are passed over, rows later than ``late`` are
    dropped, and a key that is not seen for ``keep`` of event time expires.

    Defined cases: null keys are one key; equal times are decided by the larger hash; an expired
    key that returns is new."""
    use_state(stream.sparkSession)
    keep_millis = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = stream.select("external_id", "content_hash", "body", "at").withWatermark("at", late)
    out = "external_id string, content_hash string, body string, at timestamp, action string"
    return rows.groupBy("external_id").transformWithStateInPandas(statefulProcessor=_Hashes(keep_millis), outputStructType=out, outputMode="Append", timeMode="EventTime")


class _LastGood(StatefulProcessor):
    """The last value that was not null, and when."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.good = handle.getValueState("good", "value double, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, at = self.good.get() if self.good.exists() else (None, None)
        asked = None
        for frame in rows:
            asked = frame["at"].max() if asked is None else max(asked, frame["at"].max())
            good = frame.dropna(subset=["value"])
            if len(good):
                best = good.sort_values(["at", "value"]).iloc[-1]
                if at is None or _millis(best["at"]) >= at:
                    value, at = float(best["value"]), _millis(best["at"])
        if at is not None:
            self.good.update((value, at))
        stale = at is None or _millis(asked) - at > self.ttl
        yield pd.DataFrame({"name": [key[0]], "value": [value], "good_at": [None if at is None else _stamp(at)], "asked_at": [asked], "stale": [stale]})

    def close(self) -> None:
        pass


def last_good(stream: DataFrame, ttl: str = "30 minutes") -> DataFrame:
    """``stream(name, value, at)`` → one row of each name in a batch: its last value that is known,
    also where newer ones failed (null), and whether that is older than ``ttl``.

    Defined cases: a name without any known value gives null, stale; values that arrive late do
    not replace newer ones."""
    use_state(stream.sparkSession)
    processor = _LastGood(int(pd.Timedelta(ttl).total_seconds() * 1000))
    rows = stream.select("name", F.col("value").cast("double").alias("value"), "at")
    return rows.groupBy("name").transformWithStateInPandas(statefulProcessor=processor, outputStructType="name string, value double, good_at timestamp, asked_at timestamp, stale boolean", outputMode="Append", timeMode="None")


def bulk(groups: DataFrame, cache: DataFrame, key: str, order: list[str], most: int, force: bool = False) -> DataFrame:
    """The first ``most`` groups that the cache does not hold yet (all count with ``force``)."""
    left = groups if force else groups.join(cache.select(key), key, "left_anti")
    return left.orderBy(*order, key).limit(most)


def add_snapshot(metrics: DataFrame, path: str, captured_at: str) -> None:
    """Append ``metrics(metric, value)`` as of a time."""
    metrics.select("metric", "value", F.lit(captured_at).cast("timestamp").alias("captured_at")).write.mode("append").parquet(path)


def latest_snapshots(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n newest snapshots of each metric, newest first by ``place``."""
    return top_of_each(spark.read.parquet(path), ["metric"], [F.desc("captured_at"), F.desc("value")], n)
