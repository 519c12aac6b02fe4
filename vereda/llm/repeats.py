"""Removal of repeated word passages, by seed and extend.

A window is 20 consecutive words of one text.  A word goes if some window that covers it also
starts earlier (in a smaller doc_id, or earlier in the same text).

Seeds.  Each window chooses the least of its sixteen five-word hashes (the leftmost of equals)
as its anchor: winnowing, so equal windows choose equal anchors at equal places, and about one
word in eight is an anchor.  An anchor's *run* is the stretch of consecutive windows that chose
it, and the run's text is all words that they cover.

Extension.  Occurrences of an anchor are grouped by the hash of their run's text.  Where all
occurrences have the same run they match over its whole length both ways, and all but the
first go: no pair of occurrences is ever formed, however many there are.  Where an anchor stands in different
runs, one occurrence of each (the earliest) is extended word by word: the windows of its run
are hashed, and the earliest of each window decides.  A group thus costs as many rows as it
has different surroundings.  Overlapping and touching windows unite to maximal repeats.

Defined cases: null or empty text has no words; texts under 20 words keep all; rows that
share a doc_id are ordered by a hash of their text, and rows equal in both count as one
document; null ids come first; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import SLICE_BYTES, drop_settled, mix, repeated_ids, settle, slices

LENGTH, SEED = 20, 5
CHOICES = LENGTH - SEED + 1


def _least(h: np.ndarray, w: int) -> np.ndarray:
    low, size = h, 1
    while size * 2 <= w:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    n = len(h) - w + 1
    return np.minimum(low[:n], low[w - size : w - size + n])


def anchors(h: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with a common anchor: anchor hash, hash of the run's words, the text,
    the first window (as a word number in its text) and the number of windows."""
    none = np.zeros(0, np.int64)
    inside = np.flatnonzero(words.within(first, LENGTH))
    if not len(inside):
        return {"anchor": none.astype(np.uint64), "run": none.astype(np.uint64), "text": none, "at": none, "n": none}
    seed = words.runs(h, SEED)
    low = _least(seed, CHOICES)
    n = len(h) - LENGTH + 1
    place = np.full(n, -1, np.int64)
    todo = np.arange(n)
    for j in range(CHOICES):
        hit = seed[todo + j] == low[todo]
        place[todo[hit]] = todo[hit] + j
        todo = todo[~hit]
        if not len(todo):
            break
    place = place[inside]
    owner = np.searchsorted(first, inside, side="right") - 1
    new = np.ones(len(inside), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(inside)))
    start = inside[begin]
    # hash of a variable number of words: two overlapping windows that cover them, and the length
    window = words.runs(h, LENGTH)
    run = mix(window[start] * np.uint64(0x9FB21C651E98DF25) + mix(window[start + count - 1] + count.astype(np.uint64)) + (place[begin] - start).astype(np.uint64))
    return {"anchor": seed[place[begin]], "run": run, "text": owner[begin], "at": start - first[owner[begin]], "n": count}


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = words.split(b.column("text"))
        a = anchors(words.hashes(w), w.first)
        yield pa.record_batch({"anchor": a["anchor"].view(np.int64), "run": a["run"].view(np.int64), "key": b.column("key").take(pa.array(a["text"])), "at": a["at"].astype(np.int32), "n": a["n"].astype(np.int32)})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for b in slices(batches):
        yield pa.record_batch({"key": b.column("key"), "rest": b.column("rest"), "packed": pa.array([press.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a text column, in slices of bounded size."""
    press = zstandard.ZstdDecompressor()
    for b in batches:
        at, held = 0, 0
        texts: list[bytes] = []
        for i, blob in enumerate(b.column("packed")):
            texts.append(press.decompress(blob.as_buffer()))
            held += len(texts[-1])
            if held >= SLICE_BYTES or i == b.num_rows - 1:
                yield b.slice(at, i + 1 - at).append_column("text", pa.array(texts, pa.binary()))
                at, held, texts = i + 1, 0, []


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of the runs that are asked for."""
    for b in _unpacked(batches):
        w = words.split(b.column("text"))
        window = words.runs(words.hashes(w), LENGTH)
        asked = b.column("asked")
        flat, cut = asked.flatten(), np.diff(asked.offsets.to_numpy())
        at, n, anchor = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "anchor"))
        text = np.repeat(np.arange(b.num_rows), cut)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place, owner = np.repeat(at, n) + step, np.repeat(text, n)
        yield pa.record_batch({"anchor": np.repeat(anchor, n), "window": window[w.first[owner] + place].view(np.int64), "key": b.column("key").take(pa.array(owner)), "at": place.astype(np.int32)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _unpacked(batches):
        w = words.split(b.column("text"))
        gone = np.zeros(len(w.start) + 1, np.int64)
        spans = b.column("spans")
        flat, cut = spans.flatten(), np.diff(spans.offsets.to_numpy()) * np.asarray(spans.is_valid())
        text = np.repeat(np.arange(b.num_rows), cut)
        at, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
        np.add.at(gone, w.first[text] + at, 1)
        np.add.at(gone, w.first[text] + at + n, -1)
        keep = np.cumsum(gone)[:-1] <= 0
        raw, kept, sums = w.data.tobytes(), [], np.concatenate(([0], np.cumsum(keep)))
        for i in range(b.num_rows):
            own = np.flatnonzero(keep[w.first[i] : w.first[i + 1]]) + w.first[i]
            kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]))
        size = np.diff(w.first)
        yield pa.record_batch({"rest": b.column("rest"), "n_words": size, "n_removed": size - np.diff(sums[w.first]), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def repeated_spans(keyed: DataFrame, packed: DataFrame) -> DataFrame:
    """``keyed(key, text)`` in the order of its keys → (key, spans): stretches (at, n) of words
    that windows with an earlier equal cover; they may overlap."""
    kind = keyed.schema["key"].dataType.simpleString()
    place = F.struct("key", "at")
    # Occurrences are combined by anchor, and by (anchor, run), before they are shuffled.  Both
    # sides of every join are written first: it then has two plain exchanges, and the rows of
    # a hot anchor can be dealt to several tasks.
    seeds = settle(keyed.mapInArrow(_seeds, f"anchor long, run long, key {kind}, at int, n int"), "seeds")
    again = seeds.groupBy("anchor").agg(F.count("*").alias("k"), (F.min("run") != F.max("run")).alias("mixed")).filter("k > 1").drop("k")
    again = settle(again, "anchors")
    met = settle(seeds.join(again, "anchor"), "met")
    drop_settled(seeds)
    drop_settled(again)
    runs = settle(met.groupBy("anchor", "run").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.max("mixed").alias("mixed"), F.count("*").alias("k")), "runs")
    later = met.join(runs.filter("k > 1").select("anchor", "run", "first"), ["anchor", "run"]).filter(place > F.col("first"))
    known = later.select("key", "at", (F.col("n") + LENGTH - 1).alias("n"))
    # one occurrence of each run of a mixed anchor is extended
    asked = runs.filter("mixed").groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "n", "anchor")).alias("asked"))
    windows = packed.join(asked, "key").mapInArrow(_windows, f"anchor long, window long, key {kind}, at int")
    windows = settle(windows, "windows")
    often = windows.groupBy("anchor", "window").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    often = settle(often, "often")
    found = windows.join(often, ["anchor", "window"]).filter(place > F.col("first")).select("key", "at", F.lit(LENGTH).alias("n"))
    spans = settle(known.unionByName(found).groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    for done in (met, runs, windows, often):
        drop_settled(done)
    return spans


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with text replaced by the words that stay (joined by one space), and with
    n_words and n_removed; columns of these names are replaced.

    Texts are ordered by their id, or by (id, hash of the text) where ids are repeated or
    null.  They cross the network compressed."""
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    base = docs.select(F.struct(*rest).alias("rest"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    odd = repeated_ids(base, "id")
    key = F.struct("id", F.xxhash64("text").alias("h")) if odd else F.col("id")
    keyed = base.select(key.alias("key"), "rest", "text")
    kind, other = (keyed.schema[c].dataType.simpleString() for c in ("key", "rest"))
    packed = keyed.mapInArrow(_pack, f"key {kind}, rest {other}, packed binary")
    spans = repeated_spans(keyed.select("key", "text"), packed.select("key", "packed"))
    if odd:  # null ids must meet too
        joined = packed.alias("p").join(spans.alias("s"), F.col("p.key").eqNullSafe(F.col("s.key")), "left").select("rest", "packed", "spans")
    else:
        joined = packed.join(spans, "key", "left").select("rest", "packed", "spans")
    out = joined.mapInArrow(_cut, f"rest {other}, n_words long, n_removed long, kept string")
    return out.select("rest.*", "n_words", "n_removed", F.col("kept").alias("text"))
