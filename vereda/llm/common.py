"""What the operators of this package share: shared storage, batching, settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into arrays at once; bounds its memory.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir if it is set.

    Only in a local session, whose workers are on this machine, is a temporary folder made
    where none is set; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vereda-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage so that a
    lost executor costs a re-read and not a recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file:").lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            delete(spark, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def repeated_ids(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether an id is null or stands in more than one row."""
    return docs.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).limit(1).count() > 0


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of the column
    (a longer single text stays whole), and at most ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        _, offsets = text_bytes(texts)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(batch.num_rows, at + rows, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its row offsets; null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    golden = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * golden)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


class Lookup:
    """Integer keys → row numbers, for whole arrays: open addressing at half load."""

    def __init__(self, keys: np.ndarray | None = None):
        self.n, self.bits = 0, 4
        self._clear()
        if keys is not None:
            self.add(keys)

    def _clear(self) -> None:
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros(1 << self.bits, np.uint64)

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not held yet; they get the next row numbers."""
        keys = np.ascontiguousarray(keys, np.uint64)
        n = self.n + len(keys)
        if 2 * n > len(self.row):
            used = np.flatnonzero(self.row >= 0)
            old = self.key[used], self.row[used]
            self.bits = max(4, int(2 * n).bit_length())
            self._clear()
            self._put(*old)
        self._put(keys, np.arange(self.n, n, dtype=np.int32))
        self.n = n

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self.row[slot] < 0
            _, at = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[at]
            self.row[slot[put]] = rows[put]
            self.key[slot[put]] = keys[put]
            stay = np.ones(len(keys), bool)
            stay[put] = False
            keys, rows, slot = keys[stay], rows[stay], (slot[stay] + 1) & (len(self.row) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        slot = self._slot(keys)
        out = self.row[slot]
        wrong = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & (len(self.row) - 1)
            row = self.row[slot]
            good = (row < 0) | (self.key[slot] == keys[wrong])
            out[wrong[good]] = row[good]
            wrong, slot = wrong[~good], slot[~good]
        return out
