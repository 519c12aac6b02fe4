"""Language-model scores from a log-frequency Bloom filter.

Tokens are ASCII-lower-cased words and one end for each text; a text begins after an end.
Unigrams and bigrams are counted over all training texts.  Each count is quantised on a
logarithmic scale, and an n-gram of level q sets its bits for each of the levels 1 to q in a
Bloom filter.  Reading a count means probing level after level until one fails.  A token's
probability is the interpolation

    share * min(1, c(h w) / c(h)) + (1 - share) * (c(w) + 1) / (N + V + 1)

where the bigram was seen, and the second part, with 1 - share where the history was, else.
The share is given, or fitted to the corpus: a bigram token is new with probability n1 / N by
Good and Turing's estimate (n1 bigrams were met once), and the bigrams get what is left.

All n-grams are kept, from a count of 1, and counted in Spark: tasks combine their own counts
and deal them by hash to buckets, whose merged counts stay on the executors.  The number of
buckets follows the bytes of text, so that a bucket holds the n-grams of BUCKET_BYTES at most
however large the corpus is.  The filter is
cut likewise: where a bucket is merged it fills its filter once, in parts of at most ``bits``
bits, and these are what is stored; the counts and keys of bigrams are dropped there, so that
scoring has nothing but the filter to read them from.  (A filter of all n-grams of a large corpus
has no size that could be broadcast: the number of parts grows with the n-grams.)  Probes go
to the stored parts: the distinct words of each batch of texts meet the unigrams of their
bucket and go back with their levels, and then the batch's bigrams, with the levels of both
words, meet the bigrams of their bucket and go back as one sum for each text of the batch.
Bigrams of a word that has level 0 were not seen and are not asked for.

The base score is exact: the words come back with their exact counts, too.  The most
frequent words (a bounded number) are broadcast with counts and levels and need no exchange.

Defined cases: null text is empty and has the end alone; without training texts N and V are 0;
repeated rows each count and are each scored; a null id hashes as the empty text; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Lookup, drop_settled, mix, partitions, settle, slices

#: Tokens that a task counts, or asks for, before it hands on what it has.
FLUSH, ASKED = 3 << 20, 1 << 21
HOT, BITS, HASHES, SHARE = 1 << 16, 1 << 28, 3, 0.1
#: Bytes of text to a bucket of n-grams.
BUCKET_BYTES = 16 << 20
#: Bits of the filter for each level of an n-gram: less than a quarter of them are set.
WIDTH = 12
_END = np.uint64(0x5851F42D4C957F2D)
_A = np.uint64(0x9FB21C651E98DF25)
UNI, BI = 0, 1
#: Steps of the scales: a level is this many to a doubling.
_STEPS = {UNI: 2, BI: 1}
_TOP = 96


def level_of(count: np.ndarray, kind: int) -> np.ndarray:
    return (np.floor(_STEPS[kind] * np.log2(np.maximum(count, 1)) + 1e-9) + 1).astype(np.int64).clip(0, _TOP)


def values(kind: int) -> np.ndarray:
    """What a level stands for: the middle of the counts that it holds; 0 for level 0."""
    low = np.ceil(2.0 ** (np.arange(_TOP + 1) / _STEPS[kind]) - 1e-6)
    out = np.zeros(_TOP + 1)
    out[1:] = np.maximum((low[:-1] + low[1:] - 1) / 2, low[:-1])
    return out


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end, and where each text begins."""
    w = words.split(texts, lower=True)
    n = len(texts)
    out = np.full(len(w.start) + n, _END)
    keep = np.ones(len(out), bool)
    keep[w.first[1:] + np.arange(n)] = False
    out[keep] = words.hashes(w)
    return out, w.first + np.arange(n + 1)


def bigrams(tokens: np.ndarray) -> np.ndarray:
    before = np.concatenate(([_END], tokens[:-1]))
    return mix(before * _A + (tokens ^ np.uint64(0xC2B2AE3D27D4EB4F)))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """An array as few bytes: differences if it ascends, byte after byte, compressed."""
    x = np.ascontiguousarray(x)
    ascends = len(x) > 1 and x.dtype.kind == "u" and bool((x[1:] >= x[:-1]).all())
    if ascends:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return bytes([ascends]) + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(data[1:9], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[9:], size, "zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if data[0] else x


_COUNTS = "bucket int, kind int, keys binary, counts binary"


def _stretches(to: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The values of a sorted array, and where each begins and ends."""
    edge = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])) if len(to) else np.zeros(1, np.int64)
    return zip(to[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def _dealt(kind: int, h: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    to = bucket_of(h, buckets)
    if kind == BI:
        h = h.astype(np.uint32)
    order = np.argsort(to.astype(np.uint64) << np.uint64(32) | h) if kind == BI else np.argsort(to, kind="stable")
    h, n = h[order], n[order].astype(np.uint32)
    own = list(_stretches(to[order]))
    yield pa.record_batch(
        {
            "bucket": pa.array([b for b, _, _ in own], pa.int32()),
            "kind": pa.array([kind] * len(own), pa.int32()),
            "keys": pa.array([pack(h[a:z]) for _, a, z in own], pa.binary()),
            "counts": pa.array([pack(n[a:z]) for _, a, z in own], pa.binary()),
        }
    )


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    if not len(keys):
        return keys, counts
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new)


def _counted(t: pa.Table, keys: type, counts: type) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.zeros(0, k), *(unpack(x, k) for x in t.column(c).to_pylist())]) for c, k in (("keys", keys), ("counts", counts)))


def _merge(t: pa.Table, bits: int) -> pa.Table:
    """A bucket's n-grams: its filters, the exact counts of words, and sums."""
    out: dict[str, list] = {c: [] for c in ("bucket", "kind", "keys", "counts", "parts", "filter", "tokens", "types", "single")}
    kinds = t.column("kind").to_numpy()
    for kind in (UNI, BI):
        rows = np.flatnonzero(kinds == kind)
        take = t.take(pa.array(rows))
        keys, n = _merged(*_counted(take, np.uint64 if kind == UNI else np.uint32, np.uint32))
        parts, held = filled(keys, level_of(n, kind), kind, bits)
        exact = kind == UNI  # the base score needs them
        cells = {"bucket": t.column("bucket")[0].as_py(), "kind": kind, "keys": pack(keys) if exact else None, "counts": pack(n.astype(np.int64)) if exact else None, "parts": parts, "filter": held, "tokens": int(n.sum()), "types": len(keys), "single": int((n == 1).sum())}
        for c, v in cells.items():
            out[c].append(v)
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), types, strict=True)})


_MERGED = "bucket int, kind int, keys binary, counts binary, parts int, filter binary, tokens long, types long, single long"


class Filter:
    """``parts[b]`` holds the bits of bucket b."""

    def __init__(self, buckets: int, size: int, held: bool = True):
        self.buckets, self.size = buckets, size
        self.bytes = np.zeros(buckets * size // 8 if held else 0, np.uint8)

    def places(self, ident: np.ndarray, level: int, kind: int) -> list[np.ndarray]:
        base = (ident >> np.uint64(32)) * np.uint64(self.size)
        h = mix((ident + np.uint64(level << 1 | kind)) * _A + np.uint64(level))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [base + ((h + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) % np.uint64(self.size) for i in range(HASHES)]

    @staticmethod
    def ident(h: np.ndarray, buckets: int) -> np.ndarray:
        return bucket_of(h, buckets).astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))

    def level(self, h: np.ndarray, kind: int, lowest: int) -> np.ndarray:
        """The highest level up to which every probe finds its bits."""
        ident = self.ident(h, self.buckets)
        out, todo, level = np.zeros(len(h), np.int64), np.arange(len(h)), lowest
        while len(todo) and level <= _TOP:
            good = np.ones(len(todo), bool)
            for at in self.places(ident, level, kind):
                good &= (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            todo, ident = todo[good], ident[good]
            out[todo] = level
            level += 1
        return out


def filled(keys: np.ndarray, levels: np.ndarray, kind: int, bits: int) -> tuple[int, bytes]:
    """The filter of a bucket's keys, in equal parts of at most ``bits`` bits: their number, and
    their bits one after the other."""
    need = int(levels.sum()) * WIDTH
    parts = max(1, -(-need // (bits // 8 * 8)))
    size = max(1 << 12, -(-need // parts // 8) * 8)
    own = mix(keys.astype(np.uint64) * _A)
    part_of, out = bucket_of(own, parts), []
    for part in range(parts):
        mine = part_of == part
        f = Filter(1, size, False)
        ident, level, held = f.ident(own[mine], 1), levels[mine], np.zeros(size, bool)
        for k in range(1, int(level.max(initial=0)) + 1):
            for place in f.places(ident[level >= k], k, kind):
                held[place.astype(np.int64)] = True
        out.append(np.packbits(held, bitorder="little").tobytes())
    return parts, b"".join(out)


def probed(parts: int, held: bytes, kind: int, probes: np.ndarray) -> np.ndarray:
    """The levels that a stored filter has for the probes."""
    asked = mix(probes.astype(np.uint64) * _A)
    part_of, out = bucket_of(asked, parts), np.zeros(len(probes), np.int64)
    width = len(held) // parts
    for part in range(parts):
        if len(at := np.flatnonzero(part_of == part)):
            f = Filter(1, 8 * width, False)
            f.bytes = np.frombuffer(held, np.uint8, width, part * width)
            out[at] = f.level(asked[at], kind, 1)
    return out


def _stored(t: pa.Table, kind: int, probes: np.ndarray) -> np.ndarray:
    """The same from the one row that a bucket has, or has not."""
    if not t.num_rows:
        return np.zeros(len(probes), np.int64)
    return probed(t.column("parts")[0].as_py(), t.column("filter")[0].as_py(), kind, probes)


@dataclass
class Model:
    tokens: int
    types: int
    hot: np.ndarray
    hot_n: np.ndarray
    hot_level: np.ndarray
    buckets: int
    share: float


def fit(docs: DataFrame, training: Column, bits: int = BITS, hot: int = HOT) -> tuple[Model, DataFrame]:
    """Count and merge; the frequent words, and by bucket the filters and the words' counts."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(8, partitions(docs.sparkSession), -(-size // BUCKET_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        have = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held)
            yield from _dealt(UNI, *np.unique(tokens, return_counts=True), buckets)
            pair = bigrams(tokens)
            yield from _dealt(BI, *np.unique(pair, return_counts=True), buckets)

        for b in slices(batches):
            held.append(sequence(b.column("text"))[0])
            have += len(held[-1])
            if have >= FLUSH:
                yield from hand_on()
                held, have = [], 0
        if held:
            yield from hand_on()

    counted = docs.filter(training).select("text").mapInArrow(count, _COUNTS)
    merged = settle(counted.groupBy("bucket").applyInArrow(lambda t: _merge(t, bits), _MERGED), "ngrams")
    sums = {r["kind"]: r for r in merged.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("tokens", "types", "single")]).collect()}
    count_of = lambda kind, what: int(sums[kind][what] or 0) if kind in sums else 0
    share = 1 - count_of(BI, "single") / max(1, count_of(BI, "tokens"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, n = (unpack(b.column(c)[i].as_py(), k) for c, k in (("keys", np.uint64), ("counts", np.int64)))
                top = np.argsort(-n, kind="stable")[: 4 * hot // buckets + 64]
                level = probed(b.column("parts")[i].as_py(), b.column("filter")[i].as_py(), UNI, keys[top])
                yield pa.record_batch({"h": keys[top].view(np.int64), "n": n[top], "level": level})

    top = merged.filter(F.col("kind") == UNI).select("keys", "counts", "parts", "filter").mapInArrow(frequent, "h long, n long, level long").orderBy(F.desc("n"), "h").limit(hot).toPandas()
    columns = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["level"].to_numpy(np.int64)
    model = Model(count_of(UNI, "tokens"), count_of(UNI, "types"), *columns, buckets, min(max(share, 0.05), 0.95))
    return model, merged


_SCORED = "flush string, bucket int, a binary, b binary, c binary, d binary, e binary, ids array<long>"


def _row(flush: str, bucket: int, parts: list[np.ndarray], ids: list | None = None) -> pa.RecordBatch:
    cells = {"flush": pa.array([flush]), "bucket": pa.array([bucket], pa.int32())}
    parts = [*(pack(x) for x in parts), *[None] * (5 - len(parts))]
    cells |= {c: pa.array([x], pa.binary()) for c, x in zip("abcde", parts, strict=True)}
    return pa.record_batch(cells | {"ids": pa.array([ids], pa.list_(pa.int64()))})


def _cells(t: pa.Table, kinds: tuple) -> Iterator[tuple[str, int, list[np.ndarray]]]:
    for i in range(t.num_rows):
        yield t.column("flush")[i].as_py(), t.column("bucket")[i].as_py(), [unpack(t.column(c)[i].as_py(), k) for c, k in zip("abcde", kinds, strict=False)]


_EMPTY = _row("", 0, []).schema.empty_table()


def scores(docs: DataFrame, training: Column, share: float | None = SHARE, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every text; without a
    share for the bigrams it is fitted to the corpus."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, merged = fit(base, training, bits, hot)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    buckets, tokens, mass = model.buckets, model.tokens, model.tokens + model.types + 1
    share = model.share if share is None else share

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = Lookup(own.hot)
        flushes = 0
        held: list[tuple] = []
        have = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            flush = f"{TaskContext.get().partitionId()}-{flushes}"
            ids = [i for x in held for i in x[0]]
            size = np.concatenate([np.diff(x[2]) for x in held])
            kinds, back, n = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which take less room
            kinds, back = kinds[order], np.argsort(order)[back]
            row = known.find(kinds)
            n, level = np.full(len(kinds), -1), np.zeros(len(kinds), np.uint8)
            n[row >= 0], level[row >= 0] = own.hot_n[row[row >= 0]], own.hot_level[row[row >= 0]]
            yield _row(flush, -1, [size, kinds, back.astype(np.uint32), n, level], ids)
            cold = np.flatnonzero(row < 0).astype(np.uint32)
            to = bucket_of(kinds[cold], buckets)
            order = np.argsort(to, kind="stable")
            cold = cold[order]
            for b, a, z in _stretches(to[order]):
                yield _row(flush, b, [cold[a:z], kinds[cold[a:z]]])

        for b in slices(batches):
            held.append((b.column("doc_id").to_pylist(), *sequence(b.column("text"))))
            have += len(held[-1][1])
            if have >= ASKED:
                yield from hand_on()
                flushes, held, have = flushes + 1, [], 0
        if held:
            yield from hand_on()

    def words_met(counts: pa.Table, cold: pa.Table) -> pa.Table:
        """The exact counts and the levels of words."""
        keys, n = _counted(counts, np.uint64, np.int64)
        rows = list(_cells(cold, (np.uint32, np.uint64)))
        if not rows:
            return _EMPTY
        h = np.concatenate([x[1] for _, _, x in rows])
        count = np.zeros(len(h), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            count = np.where(keys[at] == h, n[at], 0)
        level = _stored(counts, UNI, h).astype(np.uint8)
        edge = np.cumsum([0, *(len(x[0]) for _, _, x in rows)])
        return pa.Table.from_batches([_row(f, 0, [x[0], count[a:z], level[a:z]]) for (f, _, x), a, z in zip(rows, edge, edge[1:], strict=False)])

    def pair(t: pa.Table) -> pa.Table:
        """What the words alone decide, and the bigrams to ask for, by bucket."""
        main = t.column("bucket").to_pylist().index(-1)
        ids = t.column("ids")[main].as_py()
        ((flush, _, (size, kinds, back, n, level)),) = _cells(t.slice(main, 1), (np.int64, np.uint64, np.uint32, np.int64, np.uint8))
        n, level, back = n.copy(), level.copy(), back.astype(np.int64)
        for rest in (t.slice(0, main), t.slice(main + 1)):
            for _, _, (at, count, own) in _cells(rest, (np.uint32, np.int64, np.uint8)):
                n[at], level[at] = count, own
        start = np.cumsum(size) - size
        whole = np.add.reduceat(np.log10(n + 1.0)[back], start) - size * np.log10(mass)
        known = np.add.reduceat((n > 0)[back].astype(np.int64), start)
        before = level[np.concatenate((np.flatnonzero(kinds == _END), back[:-1]))]
        after = level[back]
        alone = ((values(UNI)[level] + 1) / mass)[back]
        asked = (before > 0) & (after > 0)
        with np.errstate(divide="ignore"):
            total = np.where(asked, 0.0, np.log10(np.where(before > 0, (1 - share) * alone, alone)))
        out = [_row(flush, -1, [size, whole, known, np.add.reduceat(total, start)], ids)]
        at = np.flatnonzero(asked)
        h = bigrams(kinds[back])[at]
        to = bucket_of(h, buckets)
        code = (h & np.uint64(0xFFFFFFFF)) << np.uint64(14) | before[at].astype(np.uint64) << np.uint64(7) | after[at].astype(np.uint64)
        order = np.lexsort((code, to))
        code, text = code[order], np.repeat(np.arange(len(size), dtype=np.uint32), size)[at][order]
        for b, a, z in _stretches(to[order]):
            own = code[a:z]
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            times = np.diff(np.append(new, len(own))).astype(np.uint32)
            own = own[new]
            two = [(own >> np.uint64(k) & np.uint64(127)).astype(np.uint8) for k in (7, 0)]
            out.append(_row(flush, b, [(own >> np.uint64(14)).astype(np.uint32), *two, times, text[a:z]]))
        return pa.Table.from_batches(out)

    def pairs_met(filters: pa.Table, asked: pa.Table) -> pa.Table:
        """The sums of the bigrams' log probabilities for each text."""
        rows = list(_cells(asked, (np.uint32, np.uint8, np.uint8, np.uint32, np.uint32)))
        if not rows:
            return _EMPTY
        found = values(BI)[_stored(filters, BI, np.concatenate([x[0] for _, _, x in rows]))]
        edge = np.cumsum([0, *(len(x[0]) for _, _, x in rows)])
        out = []
        for (flush, _, (_, before, after, times, text)), a, z in zip(rows, edge, edge[1:], strict=False):
            seen = np.minimum(1.0, found[a:z] / values(UNI)[before])
            with np.errstate(divide="ignore"):
                cost = np.log10(share * seen + (1 - share) * (values(UNI)[after] + 1) / mass)
            own, back = np.unique(text, return_inverse=True)
            out.append(_row(flush, 0, [own, np.bincount(back, np.repeat(cost, times), len(own))]))
        return pa.Table.from_batches(out)

    def gather(t: pa.Table) -> pa.Table:
        main = t.column("bucket").to_pylist().index(-1)
        ((_, _, (size, whole, known, total)),) = _cells(t.slice(main, 1), (np.int64, np.float64, np.int64, np.float64))
        total = total.copy()
        for rest in (t.slice(0, main), t.slice(main + 1)):
            for _, _, (text, more) in _cells(rest, (np.uint32, np.float64)):
                total[text] += more
        ids = t.column("ids")[main].as_py()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": size, "n_known": known, "train_tokens": np.full(len(size), tokens), "base_score": whole, "score": total})

    def met(rows: DataFrame, kind: int, f) -> DataFrame:
        """Rows of the flushes themselves, and what their other rows find in the buckets."""
        stored = merged.filter(F.col("kind") == kind).select("bucket", "parts", "filter", *(["keys", "counts"] if kind == UNI else []))
        found = stored.groupBy("bucket").cogroup(rows.filter("bucket >= 0").groupBy("bucket")).applyInArrow(f, _SCORED)
        return rows.filter("bucket < 0").unionByName(found)

    first = settle(base.mapInArrow(ask, _SCORED), "words")
    second = settle(met(first, UNI, words_met).groupBy("flush").applyInArrow(pair, _SCORED), "bigrams")
    drop_settled(first)
    return met(second, BI, pairs_met).groupBy("flush").applyInArrow(gather, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
