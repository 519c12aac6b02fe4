"""Texts that share at least so many words, counted in blocks of posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import folded
from .identity import top_of_each
from .ordered import checkpoint_dir

#: Words that say nothing about a question's subject.
SILENT = ["sobre", "como", "para", "pela", "pelo", "uma", "com", "direito", "questao", "alternativa"]
#: Tokens of a block of the right side, on average; it bounds a task's memory.  A set counts as so many tokens more.
BLOCK, EACH = 1 << 24, 32
#: Tasks that smaller sides are dealt to, if each has as much to do: products of tokens of either side.
TASKS, WORK = 24, 1 << 33
#: The longest right sets, with so small a part of all tokens, are counted first: what they reach need not be counted of the others.
LONGEST = 64
#: Frequent tokens of a block that have a bit in each of its sets; a token of that many sets may be one.
BITS, FREQUENT = 512, 128
#: Common tokens outside the bits that a pair has at least, to be looked at, and pairs that are returned at once.
SEEN, PAIRS = 4, 1 << 18
#: Sets are counted by sorting where the lists have not one in so many of a block's.
SPARSE = 3
#: Equal sets are met once if that spares one in so many.
SPARED = 8


def tokens(text: Column, shortest: int = 5) -> Column:
    """Distinct words of letters and digits, without accents, that say something."""
    found = F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]{{{shortest},}}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(SILENT)))


def number(token: Column, salt: int) -> Column:
    """A token as a number of 64 bits."""
    return F.xxhash64(token, F.lit(salt))


class Block:
    """Posting lists of right sets: for each token the numbers of the sets that hold it."""

    def __init__(self, tokens: np.ndarray, row: np.ndarray, m: int):
        self.m, self.row = m, row[np.argsort(tokens)]
        tokens.sort()
        self.first = np.flatnonzero(np.concatenate([np.ones(min(len(tokens), 1), bool), tokens[1:] != tokens[:-1]]))
        self.tokens, self.n = tokens[self.first], np.diff(self.first, append=len(tokens))
        # frequent tokens have bits; any of them is in more sets than all tokens without
        cut = np.partition(self.n, -BITS)[-BITS] if len(self.n) > BITS else 0
        frequent = np.flatnonzero((self.n > cut) & (self.n * FREQUENT > m))
        self.bit = np.full(len(self.n), -1, np.int32)
        self.bit[frequent] = np.arange(len(frequent))
        self.bits = np.zeros((m, -(-len(frequent) // 64)), np.uint64)
        for j, k in enumerate(frequent.tolist()):
            self.bits[self.row[self.first[k] : self.first[k] + self.n[k]], j >> 6] |= np.uint64(1 << (j & 63))

    def _counted(self, lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Right sets that are in at least so many of the lists, ascending, and in how many."""
        found = np.concatenate(lists)
        if len(found) * SPARSE > self.m:
            n = np.bincount(found, minlength=self.m)  # a set holds a token once
            right = np.flatnonzero(n >= least)
            return right, n[right]
        found.sort()
        again = found[least - 1 :]
        again = again[again == found[: len(again)]]  # a set is here once for each list from the least-th on
        ends = np.flatnonzero(np.append(again[1:] != again[:-1], np.ones(min(len(again), 1), bool)))
        return again[ends], np.diff(ends, prepend=-1) + (least - 1)

    def shared(self, asked: np.ndarray, sizes: np.ndarray, least: np.ndarray, top: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Number of the left set, of the right set, and common tokens, of all pairs with at least
        the left set's ``least``; with ``top`` only that many of a left set, the first of equals.

        A left set's most frequent tokens are not counted: what has enough in common has some of
        the others too, and of such pairs alone the frequent ones are looked up in the bits."""
        if not len(self.tokens):
            return
        at = np.minimum(np.searchsorted(self.tokens, asked), len(self.tokens) - 1)
        known = self.tokens[at] == asked
        at, of = at[known], np.repeat(np.arange(len(sizes)), sizes)[known]
        at = at[np.lexsort((self.n[at], of))]  # a set's rarest tokens first
        bounds = np.searchsorted(of, np.arange(len(sizes) + 1)).tolist()
        first, after, bit = self.first[at].tolist(), (self.first[at] + self.n[at]).tolist(), self.bit[at]
        n_bits = np.bincount(of[bit >= 0], minlength=len(sizes)).tolist()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for i, t in enumerate(least.tolist()):
            a, b = bounds[i], bounds[i + 1]
            if b - a < t:
                continue
            left_out = max(min(t - SEEN, n_bits[i]), 0)
            right, n = self._counted([self.row[x:y] for x, y in zip(first[a : b - left_out], after[a : b - left_out], strict=True)], t - left_out)
            if left_out and len(right):
                flags = np.zeros(self.bits.shape[1] * 64, np.uint8)
                flags[bit[b - left_out : b]] = 1
                n = n + np.bitwise_count(self.bits[right] & np.packbits(flags, bitorder="little").view("<u8")).sum(1, dtype=np.int64)
                right, n = right[n >= t], n[n >= t]
            if top is not None and len(right) > top:
                best = np.lexsort((right, -n))[:top]
                right, n = right[best], n[best]
            found.append((np.full(len(right), i), right, n))
            held += len(right)
            if held >= PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
                found, held = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens end to end, and the size of each set."""
    return sets.flatten().to_numpy(zero_copy_only=False), np.diff(sets.offsets.to_numpy())


def _met(asked: DataFrame, held: DataFrame, n_asked: int, n_held: int, top: int | None) -> DataFrame:
    """``asked(id, tokens, least)`` and ``held(id, tokens)`` with so many tokens → (l, r, overlap).

    The right side is dealt to blocks, the left one to slices, and each slice meets each block in
    a task: it reads the block first, then the slice's sets batch by batch."""
    tasks = max(1, min(TASKS, n_asked * n_held // WORK))
    slices = max(1, round(sqrt(tasks * n_asked / max(n_held, 1))))
    slices = min(slices, tasks)
    blocks = max(-(-n_held // BLOCK), -(-tasks // slices), 1)
    kinds = {"l": asked.schema["id"].dataType, "r": held.schema["id"].dataType}
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blank = lambda k: F.lit(None).cast(kinds[k]).alias(k)
    a = asked.select(F.col("id").alias("l"), blank("r"), "tokens", "least", part(slices).alias("slice"), every(blocks).alias("block"))
    b = held.select(blank("l"), F.col("id").alias("r"), "tokens", F.lit(0).alias("least"), every(slices).alias("slice"), part(blocks).alias("block"))
    both = a.unionByName(b).withColumn("cell", F.col("block") * slices + F.col("slice")).drop("block", "slice")
    # right sets come first (what they ask is 0), by id, so that the first of equals has the smallest
    both = both.repartitionById(blocks * slices, "cell").sortWithinPartitions(F.col("least") > 0, "r").drop("cell")

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flat, row, m, block = [], [], [], 0, None
        for found in rows:
            n_right = int((found.column("least").to_numpy() == 0).sum())
            if n_right:
                some, sizes = _flat(found.column("tokens").slice(0, n_right))
                ids.append(found.column("r").slice(0, n_right))
                flat.append(some)
                row.append(np.repeat(np.arange(m, m + n_right, dtype=np.int32), sizes))
                m += n_right
            if n_right == found.num_rows or not m:
                continue
            if block is None:
                flat = np.concatenate(flat)  # one after the other, so that the parts go in between
                row = np.concatenate(row)
                ids, block = pa.concat_arrays(ids), Block(flat, row, m)
                del flat, row
            ls = found.column("l").slice(n_right)
            some, sizes = _flat(found.column("tokens").slice(n_right))
            for l_at, r_at, n in block.shared(some, sizes, found.column("least").slice(n_right).to_numpy(), top):
                yield pa.RecordBatch.from_arrays([ls.take(pa.array(l_at)), ids.take(pa.array(r_at)), pa.array(n.astype(np.int32))], ["l", "r", "overlap"])

    return both.mapInArrow(counted, StructType([StructField("l", kinds["l"]), StructField("r", kinds["r"]), StructField("overlap", IntegerType())]))


def _longest(sets: DataFrame, n: int) -> int | None:
    """The size beyond which sets have no more than ``n`` tokens together; none, if no set is
    beyond.  The sizes are fewer than the square root of twice all tokens."""
    size, total = None, 0
    for r in sorted(sets.groupBy(F.size("tokens").alias("size")).count().collect(), reverse=True):
        total += r["size"] * r["count"]
        if total > n:
            return r["size"] if size else None
        size = r["size"]
    return None


def overlapping(left: DataFrame, right: DataFrame, least: int = 7, top: int | None = None) -> DataFrame:
    """``left(l, tokens)`` and ``right(r, tokens)``, distinct tokens → (l, r, overlap) of all pairs
    with at least ``least`` tokens in common; with ``top`` at least those among the ``top`` largest
    overlaps of a left set (ties: smaller r).

    Tokens become numbers of 64 bits; were two of them equal, others would be taken.  The right
    side is dealt to blocks of posting lists, the left one is passed by each of them, set by set,
    and no pair is shuffled but those that are returned.  With ``top`` the longest right sets come
    first, and a pair of the others is returned only if it reaches what a left set found there;
    equal sets are met once, if there are many.  The steps are as many as pairs of equal tokens
    that are not too frequent; memory is bounded by a block, whatever the sides.

    Defined cases: null ids and sets that are too small are in no pair; repeated ids count as
    one set, the union of theirs; null tokens are in no set."""
    checkpoint_dir(left.sparkSession)
    some = lambda rows: bool(rows.head(1))

    def prepared(side: DataFrame, key: str) -> DataFrame:
        return side.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.filter("tokens", lambda t: t.isNotNull()).alias("tokens"))

    a, b = prepared(left, "l"), prepared(right, "r")
    # explode and filters on tokens would have Spark make the tokens once more for a condition
    words = a.select(F.explode_outer("tokens").alias("token")).unionByName(b.select(F.explode_outer("tokens").alias("token"))).distinct()
    salt = 0
    while some(words.filter("token is not null").groupBy(number(F.col("token"), salt).alias("number")).count().filter("count > 1")):
        salt += 1

    def numbered(side: DataFrame) -> DataFrame:
        sets = side.select("id", F.transform("tokens", lambda t: number(t, salt)).alias("tokens"))
        if some(side.groupBy("id").count().filter("count > 1")):
            sets = sets.groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        return sets.select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).checkpoint().filter(F.size("tokens") >= least)

    def total(side: DataFrame) -> int:
        return side.agg(F.sum(F.size("tokens") + EACH)).first()[0] or 0

    def spared(side: DataFrame, kept: int) -> bool:
        n = side.groupBy(F.xxhash64("tokens").alias("set")).count().agg(F.sum("count").alias("n"), F.sum(F.greatest(F.col("count") - kept, F.lit(0))).alias("more")).first()
        return (n["more"] or 0) * SPARED >= (n["n"] or 0) > 0

    a, b = numbered(a), numbered(b)
    alike = None
    if spared(a, 1):
        leads = a.groupBy("tokens").agg(F.min("id").alias("lead")).checkpoint()
        alike = a.join(leads, "tokens").select("id", "lead").checkpoint()
        a = leads.select(F.col("lead").alias("id"), "tokens")
    if top is not None and spared(b, top):
        b = top_of_each(b, ["tokens"], [F.col("id")], top).select("id", "tokens").checkpoint()
    n_asked, n_held = total(a), total(b)
    asked = a.withColumn("least", F.lit(least))
    size = _longest(b, n_held // LONGEST) if top is not None and n_asked * n_held >= WORK else None
    if size is None:
        found = _met(asked, b, n_asked, n_held, top)
    else:
        long, short = b.filter(F.size("tokens") > size), b.filter(F.size("tokens") <= size)
        n_long = total(long)
        best = top_of_each(_met(asked, long, n_asked, n_long, top), ["l"], [F.desc("overlap"), F.col("r")], top).select("l", "r", "overlap").checkpoint()
        reached = best.groupBy("l").agg(F.count("*").alias("n"), F.min("overlap").alias("reached")).filter(F.col("n") == top)
        asked = a.join(reached, F.col("id") == F.col("l"), "left").select("id", "tokens", F.coalesce("reached", F.lit(least)).alias("least"))
        found = best.unionByName(_met(asked, short, n_asked, n_held - n_long, top))
    if alike is None:
        return found
    return found.join(alike, F.col("l") == F.col("lead")).select(F.col("id").alias("l"), "r", "overlap")


def most_overlapping(left: DataFrame, right: DataFrame, least: int = 7, top: int = 3) -> DataFrame:
    """(l, r, overlap, place): the ``top`` sets with the largest overlap, ties to the smaller id."""
    return top_of_each(overlapping(left, right, least, top), ["l"], [F.desc("overlap"), F.col("r")], top)
