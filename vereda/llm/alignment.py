"""Aligning the tokens of two tokenizers over the same bytes.

1. Each text is encoded by both tokenizers, A over a space and the text, B over the text (it
   puts the space there itself).  The bytes of both sides' tokens must be those of the space
   and the text; else the text has no tokens.
2. Both sides' tokens end at ascending byte offsets.  A two-pointer merge of these ends, for
   whole slices of texts at once in mapInPandas, cuts the bytes at every end of either side.
   Each stretch between two cuts lies in one token of each side, which is a link; no two
   stretches link the same two occurrences, so there are n_a + n_b - n_groups links and never
   more.  Cuts where both sides end close a group.
3. A document keeps its distinct id pairs and how often it links each.  Spark sums these over
   the corpus (combined in each task first), takes the maximum of every A id and B id, and
   joins both to the pairs.
4. The table of pairs is joined back to the documents.  The ``FREQUENT`` most frequent pairs,
   which make up nearly all links, go by broadcast: a bounded table, and the one in which hot
   keys are.  The other pairs go by a shuffled join, whose keys are thus never hot.

Bounds: what is held of a text is its tokens, a few times; a worker's tables hold both
vocabularies; the broadcast table has ``FREQUENT`` rows of 17 bytes.

Defined cases: null and empty texts, and texts with U+2581 (which B reads as a space), have no
tokens: zeros, and an empty groups_sha256; the strings of special tokens are plain text; rows
that share an id are aligned each for itself, and repeated rows count in the corpus again; null
ids are kept; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .pieces import Tables
from .store import Encoder

#: Pairs whose counts are broadcast.
FREQUENT = 1 << 16
#: Bytes of text that are aligned at once, and distinct pairs that a task sums before it passes them on.
SLICE, HELD = 1 << 20, 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """The bytes of each id, and each id's decimal digits with room for a separator."""

    blob: np.ndarray
    at: np.ndarray

    @classmethod
    def of_bytes(cls, path: str) -> Vocabulary:
        from tokenizers import Tokenizer

        byte = _byte_alphabet()
        tokens = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        made = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            made[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return cls(np.frombuffer(b"".join(made), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in made]))))

    @classmethod
    def of_pieces(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        made = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())]
        return cls(np.frombuffer(b"".join(made), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in made]))))

    def __len__(self) -> int:
        return len(self.at) - 1

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return np.diff(self.at)[ids]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes(ids)
        first = np.cumsum(size) - size
        return self.blob[np.repeat(self.at[ids] - first, size) + np.arange(int(size.sum()))]


@dataclass
class Merged:
    """Tokens of several texts; ``edge_a``/``edge_b`` part the texts, ``close_a``/``close_b`` mark
    tokens that end a group; link k joins the tokens ``link_a[k]`` and ``link_b[k]``."""

    edge_a: np.ndarray
    edge_b: np.ndarray
    close_a: np.ndarray
    close_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def merge_ends(end_a: np.ndarray, end_b: np.ndarray, edge_a: np.ndarray, edge_b: np.ndarray) -> Merged:
    """Both sides' cumulative ends, ascending over the same bytes, merged.  ``at`` is where the
    pointer into A stands when B's ends are passed in turn, and the other way round."""
    at = np.searchsorted(end_a, end_b)
    close_b = end_a[at] == end_b if len(end_b) else np.zeros(0, bool)
    close_a = np.zeros(len(end_a), bool)
    close_a[at[close_b]] = True
    inner = np.flatnonzero(~close_a)
    back = np.searchsorted(end_b, end_a[inner])
    return Merged(edge_a, edge_b, close_a, close_b, np.concatenate((at, inner)), np.concatenate((np.arange(len(end_b)), back)))


class Digits:
    """Decimal ids with separators, as bytes, for whole arrays."""

    def __init__(self, n: int):
        self.width = len(str(max(n - 1, 0))) + 1
        self.size = np.array([len(str(i)) for i in range(n)], np.int64)
        self.text = np.frombuffer("".join(str(i).ljust(self.width) for i in range(n)).encode(), np.uint8).reshape(n, self.width)
        self.used = np.arange(self.width) <= self.size[:, None]

    def join(self, ids: np.ndarray, separator: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids with their separators after them, and where each one's bytes begin."""
        made = self.text[ids]
        made[np.arange(len(ids)), self.size[ids]] = separator
        return made[self.used[ids]].tobytes(), np.concatenate(([0], np.cumsum(self.size[ids] + 1)))


def group_texts(m: Merged, ids_a: np.ndarray, ids_b: np.ndarray, digits: Digits) -> list[bytes]:
    """Each text's groups: A ids, a bar, B ids; groups are parted by semicolons."""
    last_a, last_b = np.flatnonzero(m.close_a), np.flatnonzero(m.close_b)
    group_a, group_b = np.cumsum(m.close_a) - m.close_a, np.cumsum(m.close_b) - m.close_b
    first_b = np.concatenate(([0], last_b + 1))
    place_a = np.arange(len(ids_a)) + first_b[group_a]
    place_b = np.arange(len(ids_b)) + last_a[group_b] + 1
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    separator = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    separator[place_a[m.close_a]], separator[place_b[m.close_b]] = ord("|"), ord(";")
    raw, first = digits.join(ids, separator)
    edge = first[m.edge_a + m.edge_b]
    return [raw[a : max(a, z - 1)] for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


@dataclass
class Aligner:
    """Both tokenizers and what is derived from their files."""

    a: Encoder
    b: Tables
    bytes_a: Vocabulary
    bytes_b: Vocabulary

    @classmethod
    def load(cls, tokenizer: str, model: str) -> Aligner:
        made = cls(replace(Encoder.load(tokenizer), special=[]), Tables.load(model), Vocabulary.of_bytes(tokenizer), Vocabulary.of_pieces(model))
        if len(made.bytes_a) * len(made.bytes_b) > 1 << 32:
            raise ValueError("a pair of ids needs more than 32 bits")
        return made

    def pair(self, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
        return ids_b.astype(np.uint64) * np.uint64(len(self.bytes_a)) + ids_a.astype(np.uint64)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and the texts' edges in them; none where the bytes differ."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        ids_a, edge_a = self.a.encode([" " + t if t else "" for t in texts])
        ids_b, edge_b = self.b.encode(texts)
        want = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        got_a, got_b = self.bytes_a.bytes_of(ids_a), self.bytes_b.bytes_of(ids_b)
        if np.array_equal(got_a, want) and np.array_equal(got_b, want) and all(np.array_equal(self._per_text(v, i, e), size) for v, i, e in ((self.bytes_a, ids_a, edge_a), (self.bytes_b, ids_b, edge_b))):
            return ids_a, edge_a, ids_b, edge_b
        good = np.ones(len(texts), bool)
        for got, v, ids, edge in ((got_a, self.bytes_a, ids_a, edge_a), (got_b, self.bytes_b, ids_b, edge_b)):
            at = np.concatenate(([0], np.cumsum(self._per_text(v, ids, edge))))
            data = got.tobytes()
            good &= [data[at[i] : at[i + 1]] == raw[i] for i in range(len(raw))]
        keep = []
        for ids, edge in ((ids_a, edge_a), (ids_b, edge_b)):
            n = np.diff(edge)
            keep += [ids[np.repeat(good, n)], np.concatenate(([0], np.cumsum(n * good)))]
        return keep[0], keep[1], keep[2], keep[3]

    @staticmethod
    def _per_text(v: Vocabulary, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(v.sizes(ids))))[edge])

    def align(self, texts: list[str]) -> tuple[Merged, np.ndarray, np.ndarray]:
        ids_a, edge_a, ids_b, edge_b = self.tokens(texts)
        return merge_ends(np.cumsum(self.bytes_a.sizes(ids_a)), np.cumsum(self.bytes_b.sizes(ids_b)), edge_a, edge_b), ids_a, ids_b


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _cut(texts: list[str]) -> Iterator[slice]:
    a, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield slice(a, i)
            a, held = i, 0
        held += len(t)
    if a < len(texts):
        yield slice(a, len(texts))


def aligned(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """``docs(doc_id, text)`` → a row for each, with its groups, links and distinct id pairs
    (``pairs``, ascending, as 32-bit numbers, and how often it has each, ``times``)."""
    shared = docs.sparkSession.sparkContext.broadcast(Aligner.load(tokenizer, model))

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        digits = Digits(max(len(own.bytes_a), len(own.bytes_b)))
        row = TaskContext.get().partitionId() << 33
        for frame in frames:
            every = frame["text"].fillna("").tolist()
            for part in _cut(every):
                m, ids_a, ids_b = own.align(every[part])
                n = part.stop - part.start
                closed = np.concatenate(([0], np.cumsum(m.close_b)))[m.edge_b]
                owner = np.searchsorted(m.edge_b, m.link_b, side="right") - 1
                key = np.sort(owner.astype(np.uint64) << np.uint64(32) | own.pair(ids_a[m.link_a], ids_b[m.link_b]))
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(key))).astype("<u4")
                at = np.searchsorted(key[first], np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
                pairs = (key[first] & np.uint64(0xFFFFFFFF)).astype("<u4")
                texts = group_texts(m, ids_a, ids_b, digits)
                yield pd.DataFrame(
                    {
                        "row": np.arange(row, row + n),
                        "doc_id": frame["doc_id"].iloc[part].astype("Int64").to_numpy(dtype=object, na_value=None),
                        "n_a": np.diff(m.edge_a),
                        "n_b": np.diff(m.edge_b),
                        "n_groups": np.diff(closed),
                        "n_links": np.bincount(owner, minlength=n),
                        "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in texts],
                        "pairs": [pairs[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)],
                        "times": [times[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)],
                    }
                )
                row += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(stage, _ALIGNED)


def _unpack(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers in the batch, pairs and times."""
    pairs = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column("pairs")]
    times = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column("times")]
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, "<u4")
    return np.repeat(np.arange(len(pairs)), [len(x) for x in pairs]), np.concatenate(pairs), np.concatenate(times)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = [(keys, n)]
    count = 0

    def folded() -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([k for k, _ in held])
        own, back = np.unique(key, return_inverse=True)
        return own, np.bincount(back, np.concatenate([x for _, x in held]), len(own)).astype(np.int64)

    for b in _small(batches):
        _, pairs, times = _unpack(b)
        held.append((pairs.astype(np.int64), times.astype(np.int64)))
        count += len(pairs)
        if count > 2 * HELD:
            held = [folded()]
            count = len(held[0][0])
            if count > HELD:
                yield pa.record_batch({"pair": held[0][0], "n": held[0][1]})
                held, count = [(keys, n)], 0
    own, total = folded()
    yield pa.record_batch({"pair": own, "n": total})


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``rows(pairs, times)`` → (pair, a, b, n, best_of_a, best_of_b): how many links of the
    corpus hold an id pair, and whether no other pair of its A id, or of its B id, has more."""
    counts = rows.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select("pair", (F.col("pair") % width).cast("int").alias("a"), F.expr(f"int(pair div {width})").alias("b"), "n")
    counts = settle(counts, "pairs")
    for side in ("a", "b"):  # a side's ids are a vocabulary, and an id has at most the other one's size in pairs
        counts = counts.join(counts.groupBy(side).agg(F.max("n").alias(f"top_{side}")), side)
    return settle(counts.select("pair", "a", "b", "n", (F.col("n") == F.col("top_a")).alias("best_of_a"), (F.col("n") == F.col("top_b")).alias("best_of_b")), "pairs")


def _joined_back(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of every row that has links."""
    spark = rows.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(FREQUENT).select("pair", "n", "best_of_b").toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best_of_b"].to_numpy(bool)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What frequent pairs give, one record a row (pair null); other pairs one by one."""
        pair, n, best = shared.value
        for b in _small(batches):
            at, keys, times = _unpack(b)
            if not len(keys):
                continue
            keys, times, row = keys.astype(np.int64), times.astype(np.int64), b.column("row").to_numpy()
            found = np.minimum(np.searchsorted(pair, keys), len(pair) - 1)
            hit = pair[found] == keys
            use, links = found[hit], times[hit]
            has = np.unique(at)
            sums = [np.bincount(at[hit], w, b.num_rows).astype(np.int64)[has] for w in (links * best[use], links * n[use])]
            rare = ~hit
            yield pa.record_batch(
                {
                    "row": np.concatenate((row[has], row[at[rare]])),
                    "pair": pa.array(np.concatenate((np.zeros(len(has), np.int64), keys[rare])), mask=np.arange(len(has) + int(rare.sum())) < len(has)),
                    "n_best": np.concatenate((sums[0], times[rare])),
                    "count_sum": np.concatenate((sums[1], times[rare])),
                }
            )

    given = settle(rows.select("row", "pairs", "times").mapInArrow(known, "row long, pair long, n_best long, count_sum long"), "links")
    rare = given.filter("pair is not null").join(counts.select("pair", "n", "best_of_b"), "pair")
    rare = rare.select("row", F.when(F.col("best_of_b"), F.col("n_best")).otherwise(0).alias("n_best"), (F.col("count_sum") * F.col("n")).alias("count_sum"))
    every = given.filter("pair is null").select("row", "n_best", "count_sum").unionByName(rare)
    return every.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(docs: DataFrame, tokenizer: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and
    the corpus's table of id pairs (see ``pair_counts``)."""
    rows = settle(aligned(docs, tokenizer, model), "aligned")
    counts = pair_counts(rows, len(Vocabulary.of_bytes(tokenizer)))
    out = rows.drop("pairs", "times").join(_joined_back(rows, counts), "row", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256"), counts
