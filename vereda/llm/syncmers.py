"""Document fingerprints from closed syncmers.

A k-mer of code points is a *closed syncmer* if the smallest hash among its inner s-mers
is at its first or last place.  Whether a k-mer is one depends on the k-mer alone, so two
texts choose the same anchors wherever they agree, however far apart those places are.

``anchors`` gives the anchors with their positions; ``fingerprints`` keeps, in each of 128
registers, eight bits of the smallest anchor hash that falls into it and eight bits of that
anchor's position, in steps of 64 code points.  Two registers match if their hashes agree;
matches are *positional*: each has a displacement, the difference of its two positions, and
only those within one step of the displacement that most of them share count.  Likeness is
their share of the used registers, corrected for chance agreement of eight bits: for texts
that agree in place, or shifted as a whole, it estimates the Jaccard index of the anchor sets,
and for texts with the same passages in another order it is lower.

Defined cases: a null text counts as empty; an empty text has an all-zero fingerprint,
likeness 1 to another empty text and 0 to any other; a text shorter than k is one anchor;
repeated rows are kept, ordered by (doc_id, text), and null ids come first.  Other columns
of the input are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices
from .ordered import with_heads
from .words import runs

K, S, REGISTERS = 16, 8, 128
#: Code points to a step of position.
STEP = 64
#: Code points that are hashed at once.
SLICE_CHARS = 1 << 20


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of one array of code points."""
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    one = mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    inner, w = runs(one, s), k - s + 1
    low, size = inner, 1
    while size * 2 <= w:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    n = len(points) - k + 1
    low = np.minimum(low[:n], low[w - size : w - size + n])
    at = np.flatnonzero((inner[:n] == low) | (inner[w - 1 : w - 1 + n] == low))
    whole = mix((inner[at] ^ np.uint64(0xA24BAED4963EE407)) * np.uint64(0x9FB21C651E98DF25) + inner[at + k - s])
    if k > 2 * s:
        whole = runs(one, k)[at]
    return at, whole


def _short(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def fingerprints(texts: list[str], k: int = K, s: int = S) -> np.ndarray:
    """A row for each text: REGISTERS bytes of hash (0 is an empty register) and as many of
    position."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(len(texts) * REGISTERS, top)

    def put(owner: np.ndarray, h: np.ndarray, place: np.ndarray) -> None:
        step = (place // STEP).astype(np.uint64) & np.uint64(255)
        np.minimum.at(low, owner * REGISTERS + (h >> np.uint64(57)).astype(np.int64), (h & np.uint64((1 << 57) - 1)) & ~np.uint64(255) | step)

    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE_CHARS):
            chars += len(texts[to])
            to += 1
        size = np.array([len(t) for t in texts[at:to]])
        edge = np.concatenate(([0], np.cumsum(size)))
        points = np.frombuffer("".join(texts[at:to]).encode("utf-32-le"), np.uint32)
        place, h = syncmers(points, k, s)
        owner = np.searchsorted(edge, place, side="right") - 1
        good = place + k <= edge[owner + 1] if len(place) else np.zeros(0, bool)
        put(owner[good] + at, h[good], (place - edge[owner])[good])
        if short := [i for i in range(at, to) if 0 < len(texts[i]) < k]:
            put(np.array(short), np.array([_short(texts[i]) for i in short], np.uint64), np.zeros(len(short), np.int64))
        at = to
    print_ = ((low >> np.uint64(8)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    step = low.astype(np.uint8)
    print_[low == top] = step[low == top] = 0
    return np.concatenate((print_.reshape(-1, REGISTERS), step.reshape(-1, REGISTERS)), axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints row by row: the share of registers that match at the common displacement."""
    one, two = a[:, :REGISTERS], b[:, :REGISTERS]
    used = ((one > 0) | (two > 0)).sum(1)
    row, at = np.nonzero((one > 0) & (one == two))
    shift = a[row, REGISTERS + at] - b[row, REGISTERS + at]  # eight bits, which wrap
    votes = np.bincount(row * 256 + shift.astype(np.int64), minlength=256 * len(a)).reshape(-1, 256)
    same = (votes + np.roll(votes, 1, 1) + np.roll(votes, -1, 1)).max(1, initial=0)
    raw = same / np.maximum(used, 1)
    return np.where(used == 0, 1.0, np.clip((raw - 1 / 255) / (1 - 1 / 255), 0, 1))


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, pos, hash) of every closed syncmer of every text; pos counts code points."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE_CHARS):
            for key, text in zip(b.column("doc_id"), b.column("text").to_pylist(), strict=True):
                at, h = syncmers(np.frombuffer((text or "").encode("utf-32-le"), np.uint32), k, s)
                yield pa.record_batch({"doc_id": pa.array([key.as_py()] * len(at), pa.int64()), "pos": at.astype(np.int64), "hash": h.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, pos long, hash long")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprint each text, and the text whose last quarter is replaced by the beginning
    of the next document's; likeness to that edited text and to the next document.

    Texts cross the network once, dealt by ranges of ids; every task then streams its
    range in order and holds one slice of text at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far: (id, text, part, tail, fingerprint)
        for b in slices(batches, limit=SLICE_CHARS):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, parts, tails = (b.column(c).to_pylist() for c in ("doc_id", "part", "tail"))
            prints = fingerprints(texts, k, s)
            if held:
                ids, texts, parts, tails = [held[0], *ids], [held[1], *texts], [held[2], *parts], [held[3], *tails]
                prints = np.concatenate((held[4], prints))
            held = ids[-1], texts[-1], parts[-1], tails[-1], prints[-1:]
            own = np.array([i for i in range(len(ids) - 1) if not tails[i]], np.int64)
            if not len(own):
                continue
            edited = []
            for i in own:
                n = len(texts[i])
                edited.append(texts[i][: n - n // 4] + texts[i + 1][: n // 4])
            other = fingerprints(edited, k, s)
            yield pa.record_batch(
                {
                    "doc_id": pa.array([ids[i] for i in own], pa.int64()),
                    "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                    "fingerprint": [prints[i].tobytes().hex() for i in own],
                    "edited_fingerprint": [x.tobytes().hex() for x in other],
                    "near_edited": likeness(prints[own], other),
                    "near_next": likeness(prints[own], prints[own + 1]),
                }
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_heads(base).select("doc_id", "text", "part", "tail").mapInArrow(rows, _OUT)
