"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

A text's set holds its distinct runs of five words (ASCII lower case); with one to four
words it holds the whole sequence; without words it is empty and linked with nothing.  Two
texts are linked if their sets have a Jaccard index of at least 0.75.

1. One pass over the texts gives each the size of its set, a 128-bit hash of the set, 32 band
   keys (four minima each) and a packed signature (two low bits of each of 128 minima).
2. Texts with equal sets are one class, with a number of its own; all that follows sees a class
   once, so copies cost nothing however many they are.
3. Classes that share a band key are compared with two leads of the bucket, those with the
   smallest and the largest number (numbers follow a hash, so these are any two): two stars,
   twice as many pairs as members.  What the bit counts estimate far below the threshold goes;
   the rest is confirmed on full sets.  The links give components.
4. In buckets that still hold several components, the members outside the largest are
   compared with the members of the others: estimate, then the estimate from a signature of
   1024 minima made for these classes alone, then full sets; a pair counts in the first band
   that it shares.  Pairs inside a component need no
   test, so no link between different texts that would change a component is lost and no
   group is expanded into its pairs.  (Classes that share all four minima of a band and yet
   are not linked are compared with each other: their number is what this step costs.)

Two texts at the threshold share no band with probability 5e-6, and the estimates drop a
pair at the threshold with probability below 1e-5.

Groups are combined before they are shuffled, and what is joined on a key that may be hot (a
band, a class, a component) is written first, so that a join has two plain exchanges and its
hot rows can be dealt to several tasks.

Defined cases: null text is empty; an empty text is its own component; repeated rows are one
class; rows that share an id but not their text are linked by their texts, each for itself; a
row with a null id is linked with nothing (component_id null, kept); an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import drop_settled, mix, repeated_ids, settle, slices, stream, text_bytes
from .components import components

SHINGLE, PERMS, ROWS, WIDE = 5, 128, 4, 1024
BANDS = PERMS // ROWS
_ODD = stream(WIDE, 21) | np.uint64(1)
_MASK = np.uint64((1 << 52) - 1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (52 bits), ascending within each text, and the texts' bounds.
    At most 4095 texts at once."""
    w = words.split(texts, lower=True)
    h = words.hashes(w)
    at = np.flatnonzero(words.within(w.first, k))
    owner = np.searchsorted(w.first, at, side="right") - 1
    value = words.runs(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    owners, found = [owner], [value]
    size = np.diff(w.first)
    for n in range(1, k):
        if len(own := np.flatnonzero(size == n)):
            owners.append(own)
            found.append(mix(words.runs(h, n)[w.first[own]] + np.uint64(n)))
    key = np.sort(np.concatenate(owners).astype(np.uint64) << np.uint64(52) | np.concatenate(found) >> np.uint64(12))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    edge = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(52))
    return key & _MASK, edge


def signatures(texts: pa.Array) -> dict[str, np.ndarray]:
    h, edge = shingle_sets(texts)
    size = np.diff(edge)
    has = np.flatnonzero(size)
    start = edge[:-1][has]
    low = np.empty((PERMS, len(has)), np.uint64)
    if len(has):
        wide = mix(h.copy())
        one = np.add.reduceat(wide, start)
        two = np.add.reduceat(mix(wide ^ np.uint64(0xD1B54A32D192ED03)), start)
        for j in range(PERMS):
            low[j] = np.minimum.reduceat(wide * _ODD[j], start)
    else:
        one = two = np.zeros(0, np.uint64)
    band = np.zeros((BANDS, len(has)), np.uint64)
    for j in range(PERMS):
        band[j // ROWS] = mix(band[j // ROWS] * np.uint64(0x9FB21C651E98DF25) + low[j] + np.uint64(j))
    bits = np.zeros((4, len(has)), np.uint64)
    for j in range(PERMS):
        bits[j // 32] |= ((low[j] >> np.uint64(24)) & np.uint64(3)) << np.uint64(2 * (j % 32))
    return {"has": has, "size": size, "one": one, "two": two, "band": band, "bits": bits}


_SIGNED = "doc_id long, h long, n_shingles long, s1 long, s2 long, g0 long, g1 long, g2 long, g3 long, bands binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, rows=4000):
        s = signatures(b.column("text"))
        spread = np.full(b.num_rows, -1)
        spread[s["has"]] = np.arange(len(s["has"]))
        take = pa.array(spread, mask=spread < 0)
        columns = {"doc_id": b.column("doc_id"), "h": b.column("h"), "n_shingles": s["size"].astype(np.int64)}
        for name, v in [("s1", s["one"]), ("s2", s["two"]), *((f"g{i}", s["bits"][i]) for i in range(4))]:
            columns[name] = pa.array(v.view(np.int64)).take(take)
        columns["bands"] = pa.array([x.tobytes() for x in np.ascontiguousarray(s["band"].T)], pa.binary()).take(take)
        yield pa.record_batch(columns)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.int64)
            place = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys), place, b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], names=["band", "j", "id"])


def estimate(a: str, b: str, name: str = "g", longs: int = PERMS // 32) -> Column:
    """Collision-corrected Jaccard index from two packed signatures of two-bit minima."""
    differ = F.lit(0)
    for i in range(longs):
        x = F.col(f"{a}.{name}{i}").bitwiseXOR(F.col(f"{b}.{name}{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (1 - differ / F.lit(32.0 * longs) - 0.25) / 0.75


def _likely(a: str, b: str) -> Column:
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * 75) & (estimate(a, b) >= 0.5)


def _first_shared() -> Column:
    """No band before this one is shared, too."""
    at = lambda side, i: F.substring(F.col(f"{side}.bands"), 8 * i + 1, F.lit(8))
    return (F.col("a.j") == 0) | ~F.exists(F.sequence(F.lit(0), F.greatest(F.col("a.j") - 1, F.lit(0))), lambda i: at("a", i) == at("b", i))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of classes, from the texts that have their hash."""
    for b in slices(batches, rows=4000):
        h, edge = shingle_sets(b.column("text"))
        s1 = np.zeros(b.num_rows, np.uint64)
        if has := np.flatnonzero(np.diff(edge)).tolist():
            s1[has] = np.add.reduceat(mix(h.copy()), edge[:-1][has])
        good = np.flatnonzero(s1.view(np.int64) == b.column("s1").to_numpy()).tolist()
        yield pa.record_batch({"id": b.column("id").take(pa.array(good, pa.int64())), "shingles": pa.array([h[edge[i] : edge[i + 1]].tobytes() for i in good], pa.binary())})


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low bits of WIDE minima of full sets, 32 of them to an integer."""
    for b in slices(batches, "shingles"):
        data, offsets = text_bytes(b.column("shingles"))
        h = mix(np.frombuffer(data.tobytes(), np.uint64).copy())
        start = offsets[:-1] // 8
        bits = np.zeros((WIDE // 32, b.num_rows), np.uint64)
        for j in range(WIDE):
            low = np.minimum.reduceat(h * _ODD[j], start)
            bits[j // 32] |= ((low >> np.uint64(24)) & np.uint64(3)) << np.uint64(2 * (j % 32))
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x.view(np.int64)) for x in bits)], names=["id", *(f"w{i}" for i in range(WIDE // 32))])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_key, last = None, None
    for b in batches:
        us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
        good = []
        for i, (one, two) in enumerate(zip(b.column("one"), b.column("two"), strict=True)):
            if us[i] != last_key:
                last_key, last = us[i], np.frombuffer(one.as_buffer(), np.uint64)
            other = np.frombuffer(two.as_buffer(), np.uint64)
            merged = np.sort(np.concatenate((last, other)))
            common = int((merged[1:] == merged[:-1]).sum())
            if 100 * common >= 75 * (len(last) + len(other) - common):
                good.append(i)
        yield pa.record_batch({"u": pa.array([us[i] for i in good], pa.int64()), "v": pa.array([vs[i] for i in good], pa.int64())})


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    one = sets.select(F.col("id").alias("u"), F.col("shingles").alias("one"))
    two = sets.select(F.col("id").alias("v"), F.col("shingles").alias("two"))
    return pairs.join(two, "v").join(one, "u").select("u", "v", "one", "two").mapInArrow(_confirm, "u long, v long")


_SKETCH = ("id", "n", "g0", "g1", "g2", "g3")


def _linked(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, first): the hash of the row's text, the smallest id
    of its component, and the smallest (doc_id, h) of it."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    signed = settle(base.mapInArrow(_sign, _SIGNED), "signatures")
    named = signed.filter("s1 is not null and doc_id is not null")
    same = [F.min(c).alias(c) for c in ("g0", "g1", "g2", "g3", "bands")]
    classes = named.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.min("n_shingles").alias("n"), *same)
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    sketch = classes.select(*_SKETCH)

    members = classes.select("id", "bands").mapInArrow(_explode, "band long, j int, id long")
    groups = settle(members.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last"), "groups")
    shared = settle(members.join(groups, "band"), "bands")
    drop_settled(groups)
    # texts are needed again only for classes that share a band
    wanted = classes.join(shared.select("id").distinct(), "id", "left_semi").select(F.col("first.doc_id").alias("doc_id"), "id", "s1")
    texts = base.select("doc_id", "text").join(wanted, "doc_id").select("id", "s1", "text").mapInArrow(_sets, "id long, shingles binary")
    sets = settle(texts.dropDuplicates(["id"]), "sets")

    pairs = shared.select("id", F.explode(F.array("lead", "last")).alias("other")).filter("id <> other")
    pairs = pairs.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()
    pairs = pairs.join(sketch.alias("a"), F.col("u") == F.col("a.id")).join(sketch.alias("b"), F.col("v") == F.col("b.id"))
    stars = settle(pairs.filter(_likely("a", "b")).select("u", "v"), "stars")
    links = settle(confirmed(stars, sets), "links")
    found = components(links)

    labelled = shared.select("band", "j", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = labelled.groupBy("band", "component").agg(F.count("*").alias("k"))
    largest = parts.groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "component")).alias("top")).filter("kinds > 1")
    largest = settle(largest.select("band", F.col("top.component").alias("major")), "largest")
    open_rows = labelled.join(largest, "band").withColumn("major", F.col("component") == F.col("major"))
    open_rows = settle(open_rows, "open")
    wide = sets.join(open_rows.select("id").distinct(), "id", "left_semi").mapInArrow(_widen, "id long, " + ", ".join(f"w{i} long" for i in range(WIDE // 32)))
    full = open_rows.join(sketch.join(classes.select("id", "bands"), "id").join(wide, "id"), "id")
    minor = full.filter("not major").alias("a")
    pairs = (
        minor.join(full.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.component") != F.col("b.component")) & (F.col("b.major") | (F.col("a.id") < F.col("b.id"))) & _likely("a", "b") & (estimate("a", "b", "w", WIDE // 32) >= 0.68) & _first_shared())
        .select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))
        .join(stars, ["u", "v"], "left_anti")
    )
    more = settle(confirmed(pairs, sets), "links")
    for done in (sets, stars, shared, largest, open_rows):
        drop_settled(done)
    if more.limit(1).count():
        drop_settled(found)
        found = components(links.unionByName(more))
    drop_settled(links)
    drop_settled(more)

    named = classes.select("s1", "s2", "id", "first").join(found.withColumnRenamed("node", "id"), "id", "left")
    named = settle(named.select("s1", "s2", "first", F.coalesce("component", "id").alias("component")), "named")
    least = settle(named.groupBy("component").agg(F.min("first").alias("first")), "least")
    named = settle(named.drop("first").join(least, "component").select("s1", "s2", "first"), "components")
    for done in (classes, least, found):
        drop_settled(done)
    out = signed.select("doc_id", "h", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2").join(named, ["s1", "s2"], "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce(F.col("first.doc_id"), "doc_id").alias("component_id"), "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → (doc_id, n_shingles, component_id, kept), one row for each."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _linked(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest (doc_id,
    hash of the text).  Rows equal in both id and text count once; texts without words and
    rows with a null id, which are linked with nothing, stay."""
    if repeated_ids(docs):
        docs = docs.dropDuplicates(["doc_id", "text"])
    gone = _linked(docs).filter("first is not null and struct(doc_id, h) <> first").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    rows = docs.alias("d").join(gone, (F.col("d.doc_id").cast("long") == F.col("_id")) & (F.xxhash64("d.text") == F.col("_h")), "left_anti")
    return rows.select(*[F.col(f"d.`{c}`") for c in docs.columns])
