"""A content-addressed store of token ids.

Each text is encoded and closed with an end id.  A rolling hash of the last 32 ids cuts the
stream into chunks (about 256 ids), so equal passages give equal chunks wherever they stand.  A chunk is
named by the BLAKE2b digest of its ids and stored once.  The store is a folder:

    chunks/    pack, shared, digest, ids     unique chunks, ids as little-endian unsigned 16-bit
    recipes/   shard, place, doc_id, start, n_tokens, root, digests, pack, foreign
               in ascending doc_id, shard by shard; root is the hash of the digests
    manifest/  shard, n_docs, n_tokens, start, root, buckets
               the Merkle root of the shard over its documents' roots, blocks of 1024 at a time;
               the row of shard -1 has the sums and the root over all shards

A *pack* is what one task made of neighbouring documents, about 4 MB of ids.  A chunk stays in
the first pack that has it; only digests are shuffled to find that out, and tables bucketed by
pack let chunks meet their documents without an exchange.  Packs get from others, once each,
the chunks that several share; ``foreign`` has their places among a recipe's digests.

Reading compares the recipes' Merkle roots with the manifest's, row by row from both sides, so
that a shard that is missing, extra or altered raises.  Each chunk's ids are then hashed and
each document's root and length checked; a chunk that is missing, or that no recipe reads,
raises too.

Encoding works on the distinct pieces that the tokenizer's own pattern would cut; a worker
remembers their ids.  The result equals the library's; a file with another pattern, a prefix
space or a normaliser is refused.

Defined cases: null text counts as empty and gives the end id alone; rows with the same doc_id
are ordered by their roots, null ids come first; rows equal in both follow each other; the
literal text of a special token becomes its id, as the library does; an empty table gives an
empty store; a text longer than a pack is a pack of its own; other columns of the input are
ignored.  Ids need a vocabulary of up to 65536.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, drop_settled, partitions, settle, shared_dir, slices, stream
from .ordered import range_bounds, range_of
from .units import Memory

WINDOW, MASK, LONGEST = 32, np.uint64(255), 4096
#: Bytes of ids, and documents, after which a pack is closed.
PACK, PACK_DOCS = 4 << 20, 1 << 14
#: Bits of a chunk's number in its pack, and of a pack's number in its task.
_NO, _NTH = 22, 20
_GEAR = stream(1 << 16, 41)
#: Unicode's White_Space, which the pattern's \s stands for (fixed values).
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


def _kinds() -> np.ndarray:
    import unicodedata

    kind = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        kind[i] = _LETTER if c == "L" else _NUMBER if c == "N" else _OTHER
    kind[_WHITE] = _SPACE
    return kind


def cuts(points: np.ndarray, edge: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE's usual pattern begin, for texts laid end to end:
    runs of letters, of numbers or of other characters, each with one space before it;
    English contractions; and runs of white space."""
    n = len(points)
    k = kind[points]
    first = np.zeros(n + 1, bool)
    first[edge[:-1]] = True
    first[n] = True
    change = np.ones(n, bool)
    change[1:] = k[1:] != k[:-1]
    begin = change | first[:n]
    white = k == _SPACE
    last_white = white.copy()  # the last of its run, with something after it in the text
    last_white[:-1] &= ~white[1:]
    last_white[n - 1 :] = False
    last_white &= ~first[1:]
    begin |= last_white
    joined = last_white & (points == 32)  # a space that goes with what follows
    at = np.flatnonzero(joined) + 1
    begin[at] = False
    # contractions: an apostrophe that begins a piece, with its letters
    quote = np.flatnonzero((points == 39) & begin)
    if len(quote):
        end = edge[np.searchsorted(edge, quote, side="right")]
        pad = np.concatenate((points, np.zeros(3, points.dtype)))
        a = np.where(quote + 1 < end, pad[quote + 1], 0)
        b = np.where(quote + 2 < end, pad[quote + 2], 0)
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((two, 2), (three & ~two, 3)):
            q = quote[hit]
            begin[q + 1] = False
            after = q + size
            after = after[after < n]
            begin[after[(k[after] == _LETTER) & ~first[after]]] = True
    return np.flatnonzero(begin)


@dataclass
class Encoder:
    """The tokenizer's file, loaded when a worker first needs it."""

    path: str
    kind: np.ndarray
    special: list[str]
    size: np.ndarray
    memory: Memory = field(default_factory=Memory)
    _loaded: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Encoder:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        made = json.loads(t.to_str())
        cutter = made["pre_tokenizer"] or {}
        if made["normalizer"] or made["truncation"] or made["padding"] or (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path}: not a byte-level tokenizer with the usual pattern and nothing before it")
        vocab = t.get_vocab(with_added_tokens=True)
        if len(vocab) > 1 << 16:
            raise ValueError("ids need more than sixteen bits")
        size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            size[i] = len(token)  # one character of the byte alphabet for each byte
        return cls(path, _kinds(), [str(x) for x in (a.content for a in t.get_added_tokens_decoder().values())], size)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": {}, "memory": Memory()}

    def _tokenizer(self, by_unit: bool):
        """The library's tokenizer as it is, or one that takes units parted by zero bytes; each
        is loaded only when it is needed, since it takes tens of megabytes."""
        if by_unit not in self._loaded:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer, pre_tokenizers

            made = Tokenizer.from_file(self.path)
            if by_unit:
                made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\x00", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
                made.encode_special_tokens = True
            self._loaded[by_unit] = made
        return self._loaded[by_unit]

    def _units(self, held: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(size + 1)
        if held.count(0) > len(size):  # a text has zero bytes of its own
            got = [x.ids for x in self._tokenizer(False).encode_batch_fast([held[z - n - 1 : z - 1].decode() for z, n in zip(end.tolist(), size.tolist(), strict=True)], add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint16), np.concatenate(([0], np.cumsum([len(x) for x in got])))
        cut = [0, *end[63:-1:64].tolist(), int(end[-1])]
        joined = [held[a : z - 1].decode() for a, z in zip(cut[:-1], cut[1:], strict=True)]
        ids = np.concatenate([np.array(x.ids, np.uint16) for x in self._tokenizer(True).encode_batch_fast(joined, add_special_tokens=False)])
        return ids, np.searchsorted(np.concatenate(([0], np.cumsum(self.size[ids]))), np.concatenate(([0], np.cumsum(size))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = ["" if i in set(odd) else t for i, t in enumerate(texts)] if odd else texts
        raw = "".join(plain)
        chars = np.concatenate(([0], np.cumsum([len(t) for t in plain])))
        if raw:
            points = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
            begin = cuts(points, np.unique(chars), self.kind)
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            byte = np.concatenate(([0], np.cumsum(width)))
            ids, first = self.memory.encode(raw.encode(), byte[begin], self._units, 1 << 17)
            edge = first[np.searchsorted(begin, chars)]
        else:
            ids, edge = np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        if odd:
            parts = [ids[edge[i] : edge[i + 1]] for i in range(len(texts))]
            for i in odd:
                parts[i] = np.array(self._tokenizer(False).encode(texts[i], add_special_tokens=False).ids, np.uint16)
            ids, edge = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, edge


def with_end(ids: np.ndarray, edge: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(edge) - 1
    out = np.full(len(ids) + n, end, np.uint16)
    keep = np.ones(len(out), bool)
    keep[edge[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, edge + np.arange(n + 1)


def chunk_bounds(ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end: at texts' bounds, after ids where the rolling hash of
    the last WINDOW ids has eight low zero bits, and every LONGEST ids without such a place."""
    h, size = _GEAR[ids], 1
    while size < WINDOW:
        longer = h.copy()
        longer[size:] += h[: len(h) - size] * np.uint64(pow(3, size, 1 << 64))
        h, size = longer, size * 2
    hit = np.flatnonzero((h >> np.uint64(40)) & MASK == 0) + 1
    own = np.searchsorted(edge, hit - 1, side="right") - 1
    hit = hit[hit - edge[own] >= WINDOW] if len(hit) else hit
    bounds = np.union1d(edge, hit)
    gap = np.diff(bounds)
    if len(gap) and gap.max() > LONGEST:
        bounds = np.union1d(bounds, np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > LONGEST]))
    return bounds


def _root(digests: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(digests), digest_size=16).digest()


class _Pack:
    """Documents one after the other, and their distinct chunks."""

    def __init__(self) -> None:
        self.doc_id: list[int | None] = []
        self.n_tokens: list[int] = []
        self.root: list[bytes] = []
        self.which: list[int] = []
        self.cut = [0]
        self.number: dict[bytes, int] = {}
        self.blobs: list[bytes] = []
        self.bytes = 0

    def add(self, doc_id: list[int | None], ids: np.ndarray, edge: np.ndarray) -> None:
        bound = chunk_bounds(ids, edge)
        raw, digests = ids.astype("<u2").tobytes(), []
        for a, z in zip((2 * bound[:-1]).tolist(), (2 * bound[1:]).tolist(), strict=True):
            digest = hashlib.blake2b(raw[a:z], digest_size=16).digest()
            digests.append(digest)
            no = self.number.setdefault(digest, len(self.blobs))
            if no == len(self.blobs):
                self.blobs.append(raw[a:z])
            self.which.append(no)
        cut = np.searchsorted(bound, edge).tolist()
        self.root += [_root(digests[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        self.cut += [self.cut[-1] + c for c in cut[1:]]
        self.doc_id += doc_id
        self.n_tokens += np.diff(edge).tolist()
        self.bytes += len(raw)
        if len(self.blobs) >= 1 << _NO:
            raise ValueError("a pack has too many chunks")

    def full(self) -> bool:
        return self.bytes >= PACK or len(self.doc_id) >= PACK_DOCS

    def row(self, pack: int) -> pa.RecordBatch:
        ints, longs, blobs = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())
        cells = [([pack], pa.int64()), ([self.doc_id], longs), ([self.n_tokens], longs), ([self.root], blobs), ([self.cut], ints), ([self.which], ints)]
        cells += [([list(self.number)], blobs), ([[len(x) for x in self.blobs]], ints), ([b"".join(self.blobs)], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in cells], names=[c.split()[0] for c in _STAGED.split(", ")])


_STAGED = "pack long, doc_id array<long>, n_tokens array<long>, root array<binary>, cut array<int>, which array<int>, digest array<binary>, size array<int>, ids binary"
_CHUNKS = "pack long, shared boolean, digest binary, ids binary"


def _write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    """Files bucketed by pack; the table's name is needed for that only while writing."""
    name = f"packs_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "pack").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def _read_bucketed(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    name = f"packs_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (pack) INTO {buckets} BUCKETS LOCATION '{path}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks that stay in each pack; the shared ones come first."""
    for b in batches:
        for i in range(b.num_rows):
            digest, size = b.column("digest")[i].as_py(), b.column("size")[i].as_py()
            raw, edge = b.column("ids")[i].as_py(), np.concatenate(([0], np.cumsum(size))).tolist()
            lost, shared = (set(b.column(c)[i].as_py() or ()) for c in ("lost", "shared"))
            stay = [*sorted(shared), *(n for n in range(len(digest)) if n not in lost and n not in shared)]
            for at in range(0, len(stay), 4096):
                some = stay[at : at + 4096]
                columns = [pa.array([b.column("pack")[i].as_py()] * len(some), pa.int64()), pa.array([n in shared for n in some], pa.bool_())]
                columns += [pa.array([digest[n] for n in some], pa.binary()), pa.array([raw[edge[n] : edge[n + 1]] for n in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["pack", "shared", "digest", "ids"])


def _recipe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            digest, lost = b.column("digest")[i].as_py(), set(b.column("lost")[i].as_py() or ())
            cut, which = b.column("cut")[i].as_py(), b.column("which")[i].as_py()
            n = len(cut) - 1
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id")[i].values,
                    "n_tokens": b.column("n_tokens")[i].values,
                    "root": b.column("root")[i].values,
                    "digests": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array([digest[k] for k in which], pa.binary())),
                    "pack": pa.array([b.column("pack")[i].as_py()] * n, pa.int64()),
                    "foreign": pa.array([[at for at, k in enumerate(which[a:z]) if k in lost] for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int32())),
                }
            )


def write(docs: DataFrame, tokenizer: str, path: str, end: int = 2) -> None:
    """Encode ``docs(doc_id, text)`` and write the store to ``path``."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(Encoder.load(tokenizer))
    bounds, buckets = range_bounds(base), max(8, partitions(spark))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held = TaskContext.get().partitionId() << _NTH, 0, _Pack()
        for b in slices(batches, limit=1 << 18, rows=PACK_DOCS):
            ids, edge = with_end(*shared.value.encode([t or "" for t in b.column("text").to_pylist()]), end)
            held.add(b.column("doc_id").to_pylist(), ids, edge)
            if held.full():
                yield held.row(task + nth)
                nth, held = nth + 1, _Pack()
        if held.doc_id:
            yield held.row(task + nth)

    staged_at = f"{path}/staged"
    _write_bucketed(base.mapInArrow(stage, _STAGED), staged_at, buckets)
    staged = _read_bucketed(spark, staged_at, _STAGED, buckets)

    # digests alone meet: a chunk stays where its place is smallest
    places = staged.select(F.posexplode("digest").alias("no", "digest"), "pack").select("digest", (F.shiftleft("pack", _NO) + F.col("no")).alias("place"))
    homes = places.groupBy("digest").agg(F.min("place").alias("home"), F.count("*").alias("k")).filter("k > 1").drop("k")
    no = (F.col("place") % (1 << _NO)).cast("int")
    marks = places.join(homes, "digest").groupBy(F.shiftright("place", _NO).alias("pack"))
    marks = settle(marks.agg(F.collect_list(F.when(F.col("place") != F.col("home"), no)).alias("lost"), F.collect_list(F.when(F.col("place") == F.col("home"), no)).alias("shared")), "marks")

    kept = staged.select("pack", "digest", "size", "ids").join(marks.hint("shuffle_hash"), "pack", "left")
    _write_bucketed(kept.mapInArrow(_chunk_rows, _CHUNKS), f"{path}/chunks", buckets)
    listed = staged.select("pack", "doc_id", "n_tokens", "root", "cut", "which", "digest").join(marks.select("pack", "lost").hint("shuffle_hash"), "pack", "left")
    listed = listed.mapInArrow(_recipe_rows, "doc_id long, n_tokens long, root binary, digests array<binary>, pack long, foreign array<int>")
    recipes = settle(listed.select(range_of("doc_id", bounds).alias("shard"), "*"), "recipes")
    delete(spark, staged_at)
    drop_settled(marks)

    sums = recipes.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).orderBy("shard").collect()
    before, total = [], 0
    for r in sums:  # one row for each shard
        before.append((r["shard"], total))
        total += r["n_tokens"]
    offset = F.broadcast(spark.createDataFrame(before, "shard int, _before long"))
    in_order = Window.partitionBy("shard").orderBy("doc_id", "root")
    placed = recipes.join(offset, "shard").withColumn("start", F.col("_before") + F.sum("n_tokens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    placed = placed.withColumn("place", F.row_number().over(in_order) - 1)
    placed.select("shard", "place", "doc_id", "start", "n_tokens", "root", "digests", "pack", "foreign").write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_settled(recipes)
    roots = _roots(spark.read.parquet(f"{path}/recipes"))
    spark.createDataFrame([(*r, buckets) for r in roots], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


_MANIFEST = "shard int, n_docs long, n_tokens long, start long, root string, buckets int"


def _roots(recipes: DataFrame) -> list[tuple]:
    """A row for each shard and one for all of them; there are no more shards than ranges."""
    rows = [(r["shard"], r["n_docs"], r["n_tokens"], r["start"], r["root"]) for r in shard_roots(recipes).orderBy("shard").collect()]
    whole = hashlib.sha256(repr(rows).encode()).hexdigest()
    return [(-1, sum(r[1] for r in rows), sum(r[2] for r in rows), 0, whole), *rows]


def shard_roots(recipes: DataFrame) -> DataFrame:
    """(shard, n_docs, n_tokens, start, root) from recipes, a bounded number at each level."""
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens"), F.hex("root")), 256)
    level = recipes.select("shard", "start", "n_tokens", F.floor(F.col("place") / 1024).alias("block"), F.struct("place", leaf.alias("h")).alias("x"))
    joined = lambda column: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda s: s["h"]), ""), 256)
    level = level.groupBy("shard", "block").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("start"), joined("x").alias("h"))
    level = level.select("shard", "n_docs", "n_tokens", "start", F.struct(F.col("block").alias("place"), "h").alias("x"))
    return level.groupBy("shard").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("start"), joined("x").alias("root"))


def _checked(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The recipes, if they have the manifest's roots, and the number of buckets."""
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = {tuple(r)[:5]: r["buckets"] for r in spark.read.parquet(f"{path}/manifest").select(*[c.split()[0] for c in _MANIFEST.split(", ")]).collect()}
    found = _roots(recipes)
    if set(found) != set(manifest):
        wrong = sorted({r[0] for r in set(found) ^ set(manifest)})
        raise ValueError(f"{path}: recipes and manifest differ in shards {wrong[:10]}")
    return recipes, max(manifest.values())


def _put_together(chunks: pa.Table, rows: pa.Table) -> Iterator[tuple[int | None, int, int, bytes]]:
    """(doc_id, start, n_tokens, ids) of the documents of one pack."""
    pack = (chunks if chunks.num_rows else rows).column("pack")[0].as_py()
    own = dict(zip(chunks.column("digest").to_pylist(), chunks.column("ids").to_pylist(), strict=True))
    unread = {d for d, s in zip(own, chunks.column("shared").to_pylist(), strict=True) if not s}
    sent = rows.filter(pa.compute.is_valid(rows.column("digest")))
    own |= dict(zip(sent.column("digest").to_pylist(), sent.column("ids").to_pylist(), strict=True))
    if any(x is None or hashlib.blake2b(x, digest_size=16).digest() != d for d, x in own.items()):
        raise ValueError(f"pack {pack}: a chunk is missing or differs from its digest")
    docs = rows.filter(pa.compute.is_null(rows.column("digest")))
    for doc_id, start, size, root, digests in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root", "digests")), strict=True):
        if any(d not in own for d in digests) or _root(digests) != root:
            raise ValueError(f"pack {pack}: document {doc_id} cannot be put together")
        unread.difference_update(digests)
        ids = b"".join([own[d] for d in digests])
        if len(ids) != 2 * size:
            raise ValueError(f"pack {pack}: document {doc_id} has another length")
        yield doc_id, start, size, ids
    if unread:
        raise ValueError(f"pack {pack}: {len(unread)} chunks belong to no document")


def _read(spark: SparkSession, path: str, name: str, kind: str, last: Callable[[bytes], object]) -> DataFrame:
    recipes, buckets = _checked(spark, path)
    chunks = _read_bucketed(spark, f"{path}/chunks", _CHUNKS, buckets)
    wanted = recipes.select("pack", F.explode(F.transform("foreign", lambda i: F.get("digests", i))).alias("digest")).distinct()
    sent = wanted.join(chunks.filter("shared").select("digest", "ids"), "digest", "left")
    rows = recipes.select("pack", "doc_id", "start", "n_tokens", "root", "digests").unionByName(sent, allowMissingColumns=True)
    arrow = {"binary": pa.binary(), "long": pa.int64()}[kind]

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(zip(*_put_together(left, right), strict=True)) or [(), (), (), ()]
        columns = [*(pa.array(x, pa.int64()) for x in found[:3]), pa.array([last(x) for x in found[3]], arrow)]
        return pa.Table.from_arrays(columns, names=["doc_id", "start", "n_tokens", name])

    return chunks.groupBy("pack").cogroup(rows.groupBy("pack")).applyInArrow(build, f"doc_id long, start long, n_tokens long, {name} {kind}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, put together and checked."""
    return _read(spark, path, "ids", "binary", bytes)


def _crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with ids_crc32 (of the ids as little-endian 32-bit integers) in place of
    the ids, so that these don't leave the worker."""
    return _read(spark, path, "ids_crc32", "long", _crc)


def checksums(read_back: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 of the ids as little-endian 32-bit integers)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [_crc(x.as_py()) for x in b.column("ids")]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "start": b.column("start"), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    return read_back.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
