"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of orders 0 to 3 counts which byte follows which context.
A byte seen in its context costs log(c / (n + d)), with c its count, n the context's count
and d the number of different bytes seen there; a byte not seen costs the escape d / (n + d)
and is then looked for in the next shorter context, at last among 256 equal bytes (escape
method C, without exclusion).  The statistics are frozen after training, so a text's cost is
a sum over its bytes, and the language with the lowest cost is predicted.

The trees of all languages are merged: for each n-gram that any language has seen the exact
cost under every language is worked out beforehand, so that a byte needs one look-up and not
one for each language.

Training reads about ``per_lang`` documents of each language, chosen by a hash of their ids
and texts (equal rows once).  In the order of that hash, a language's texts are taken, each
whole, until they come to its share of ``sample_bytes`` bytes, the last of them included
(documented bounds: the model has a size that does not follow the corpus).  There may be up
to MOST_LANGS languages; more raise an error.  A language without any text to learn from is none.
Prediction reads whole texts; a long one is cut into pieces whose costs are added.

Defined cases: a letter is a character of Unicode's category L (numerals such as 12½ or Ⅷ are
none); null text or text without letters is ``und`` with score 0; with no training
language every text is; equal costs go to the smaller name; repeated rows are each scored; null
ids take part like any other; other columns are kept, and those named lang_pred or score are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Lookup, slices

ORDER = 3
PAD = b" " * ORDER
MOST_LANGS = 1024
LETTER = regex.compile(r"\p{L}")
_WIDE = np.uint64(256)


def grams(texts: list[bytes], before: list[bytes] | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of the byte n-grams that end at each byte, by order; and each text's bounds.
    ``before`` has the ORDER bytes that stand before each text."""
    raw = np.frombuffer(b"".join([x for pair in zip(before, texts, strict=True) for x in pair]) if before else PAD + PAD.join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size + ORDER)
    keys = [raw.astype(np.uint64)]
    for _ in range(ORDER):
        longer = keys[-1].copy()
        longer[len(keys) :] += raw[: -len(keys)].astype(np.uint64) << np.uint64(8 * len(keys))
        keys.append(longer)
    return keys, end - size, end


@dataclass
class Model:
    langs: list[str]
    find: list[Lookup]
    cost: list[np.ndarray]
    context: list[Lookup | None]
    escape: list[np.ndarray]

    @classmethod
    def build(cls, langs: list[str], lang: np.ndarray, order: np.ndarray, key: np.ndarray, n: np.ndarray) -> Model:
        out = cls(langs, [], [], [], [])
        below, find_below = np.full((1, len(langs)), np.log(1 / 256)), None
        for k in range(ORDER + 1):
            at = order == k
            keys, row = np.unique(key[at], return_inverse=True)
            count = np.zeros((len(keys), len(langs)))
            np.add.at(count, (row, lang[at]), n[at])
            ctx, owner = np.unique(keys // _WIDE, return_inverse=True)
            total, kinds = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
            np.add.at(total, owner, count)
            np.add.at(kinds, owner, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log(kinds / (total + kinds)), 0.0)
                seen = np.log(count / (total + kinds)[owner])
            shorter = below[find_below.find(keys % (_WIDE ** np.uint64(k)))] if find_below else np.repeat(below, len(keys), 0)
            cost = np.where(count > 0, seen, escape[owner] + shorter)
            find = Lookup(keys)
            out.find.append(find)
            out.cost.append(cost.astype(np.float32))
            out.context.append(Lookup(ctx) if k else None)
            out.escape.append(escape.astype(np.float32))
            below, find_below = cost, find
        return out

    def costs(self, texts: list[bytes], most: int = SLICE_BYTES) -> np.ndarray:
        """Log likelihood of each text under each language; texts are cut into pieces, and no
        more than ``most`` bytes are worked on at once."""
        out = np.zeros((len(texts), len(self.langs)))
        some: list[bytes] = []
        before: list[bytes] = []
        owner: list[int] = []
        have = 0
        for i, t in enumerate(texts):
            for a in range(0, max(len(t), 1), most):
                some.append(t[a : a + most])
                before.append(t[a - ORDER : a] if a else PAD)
                owner.append(i)
                have += len(some[-1])
                if have >= most:
                    np.add.at(out, owner, self._costs(some, before))
                    some, before, owner, have = [], [], [], 0
        if some:
            np.add.at(out, owner, self._costs(some, before))
        return out

    def _costs(self, texts: list[bytes], before: list[bytes]) -> np.ndarray:
        keys, start, end = grams(texts, before)
        total = np.zeros((len(keys[0]) + 1, len(self.langs)), np.float32)
        left = None  # the bytes not yet found in any longer context
        for k in range(ORDER, -1, -1):
            own = keys[k] if left is None else keys[k][left]
            row = self.find[k].find(own)
            hit = row >= 0
            if left is None:
                left = np.arange(len(own))
            total[left[hit]] += self.cost[k][row[hit]]
            left = left[~hit]
            if not len(left):
                break
            if k:
                ctx = self.context[k].find(keys[k][left] // _WIDE)
                known = ctx >= 0
                total[left[known]] += self.escape[k][ctx[known]]
            else:
                total[left] += self.escape[0][0] + np.float32(np.log(1 / 256))
        bounds = np.stack((start, end), 1).ravel()
        return np.add.reduceat(total, bounds, axis=0, dtype=np.float64)[::2] * (end > start)[:, None]


def fit(docs: DataFrame, training: Column, per_lang: int = 400, sample_bytes: int = 1 << 25) -> Model | None:
    """Count n-grams of the sampled training rows in Spark and build the trees."""
    rows = docs.filter(training & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(min(1.0, per_lang / sizes[name])))])
    hashed = rows.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit("ppm"), F.col("text")).alias("h"))
    chosen = hashed.filter(F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20)) < share[F.col("lang")])
    # equal rows are chosen alike, however many they are, and count once
    sample = chosen.select("lang", "h", F.col("text").cast("binary").alias("text")).dropDuplicates(["lang", "h"])
    before = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)  # some per_lang rows
    taken = F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))
    sample = sample.withColumn("taken", taken).filter(F.col("taken") < max(1, sample_bytes // len(langs))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            name = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for own in sorted(set(name)):
                keys, start, end = grams([t for t, x in zip(texts, name, strict=True) if x == own])
                real = np.ones(len(keys[0]), bool)
                for s in start:
                    real[s - ORDER : s] = False
                for k, found in enumerate(keys):
                    value, n = np.unique(found[real], return_counts=True)
                    yield pa.record_batch({"lang": [own] * len(value), "k": pa.array([k] * len(value), pa.int32()), "key": value.astype(np.int64), "n": n.astype(np.int64)})

    counted = sample.mapInArrow(count, "lang string, k int, key long, n long").groupBy("lang", "k", "key").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return None
    langs = sorted(set(counted["lang"]))
    place = {name: i for i, name in enumerate(langs)}
    return Model.build(langs, counted["lang"].map(place).to_numpy(), counted["k"].to_numpy(), counted["key"].to_numpy().astype(np.uint64), counted["n"].to_numpy())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score in place of the text."""
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            lettered = np.array([LETTER.search(t) is not None for t in texts])
            name, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if own is not None and lettered.any():
                cost = own.costs([t.encode() for t in texts])
                best = cost.argmax(1)
                chance = 1 / np.exp(cost - cost.max(1, keepdims=True)).sum(1)
                name = np.where(lettered, np.array(own.langs, object)[best], "und")
                score = np.where(lettered, chance, 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(name.tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(rows, schema)
