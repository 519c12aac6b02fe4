"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and documents of unknown kind (U) train a linear classifier
with the class-prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with logistic loss.  The prior is the share of toxic rows among all training labels, or what
the best features say of their share in U, if that is less.  The features are the presence of byte n-grams (5 and 6 bytes, letters only, lower case) that P
has much oftener than the non-toxic part of U would.

Training reads at most ``positives`` toxic and ``unlabelled`` other documents, chosen by a
hash of their ids (documented bounds), and each of them whole; their ids are the only thing that
is broadcast for it.  Training and scoring cut a long text into overlapping pieces whose
features unite.

Defined cases: null and empty texts have no features and get the score of the bias alone;
with no toxic label every score is 0; repeated labels of a document count as toxic if one
is; null labels and null ids are not learnt from; of rows that share an id the smallest text is
learnt from; repeated rows are each scored; other columns are kept, and those named score or
predicted are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Lookup, slices, text_bytes

SIZES = (5, 6)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def keys(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each place on, and k itself, as one integer."""
    out = np.full(max(0, len(data) - k + 1), k << 56, np.uint64)
    for j in range(k):
        out |= data[j : j + len(out)].astype(np.uint64) << np.uint64(8 * j)
    return out


class Chosen:
    """The n-grams that are features; a small bit table sorts out nearly all others first."""

    def __init__(self, chosen: list[int]):
        self.find = Lookup(np.array(chosen, np.uint64))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.slot(np.array(chosen, np.uint64))] = True

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(46)


def features(texts: pa.Array, chosen: Chosen | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram key) pairs; with ``chosen`` (text, feature number) pairs."""
    data, edge = text_bytes(texts)
    data = _PLAIN[data]
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in SIZES:
        key = keys(data, k)
        at = np.arange(len(key)) if chosen is None else np.flatnonzero(chosen.maybe[chosen.slot(key)])
        key = key[at]
        if chosen is not None:
            row = chosen.find.find(key)
            at, key = at[row >= 0], row[row >= 0].astype(np.uint64)
        owner = np.searchsorted(edge, at, side="right") - 1
        good = at + k <= edge[np.minimum(owner + 1, len(edge) - 1)]
        owners.append(owner[good])
        found.append(key[good])
    owner, key = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[new], key[new].astype(np.int64)


def present(texts: pa.Array, chosen: Chosen | None, most: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """As ``features``, but a text of more than ``most`` bytes is worked on piece by piece."""
    data, edge = text_bytes(texts)
    if not len(texts) or int(np.diff(edge).max()) <= most:
        return features(texts, chosen)
    rows, found = [], []
    for i, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        own = [features(pa.array([data[at : min(at + most + SIZES[-1] - 1, z)].tobytes()], pa.binary()), chosen)[1] for at in range(a, z, most)]
        if own:
            found.append(np.unique(np.concatenate(own)))
            rows.append(np.full(len(found[-1]), i))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    chosen: Chosen
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, most: int = SLICE_BYTES) -> np.ndarray:
        logit = np.full(len(texts), self.bias)
        if len(self.weight):
            row, feature = present(texts, self.chosen, most)
            logit += np.bincount(row, self.weight[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(row: np.ndarray, feature: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk.  Where the corrected negative part falls
    below zero, its gradient is taken with the opposite sign, which undoes over-fitting."""
    weight, bias = np.zeros(n_features), np.log(prior / (1 - prior))
    moment, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    p, u = positive, ~positive
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weight[feature], len(positive))
        s = 1 / (1 + np.exp(-z))
        softplus = np.logaddexp(0, z)
        negative = softplus[u].mean() - prior * softplus[p].mean()
        sign = 1.0 if negative >= 0 else -1.0
        slope = np.where(p, prior * ((s - 1) * (sign > 0) - sign * s) / p.sum(), sign * s / u.sum())
        g = np.append(np.bincount(feature, slope[row], n_features) + ridge * weight, slope.sum())
        moment += 0.1 * (g - moment)
        square += 0.001 * (g * g - square)
        change = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weight -= change[:-1]
        bias -= change[-1]
    return weight, float(bias)


def fit(docs: DataFrame, labels: DataFrame, training: Column, positives: int = 4000, unlabelled: int = 8000, n_features: int = 2048, min_gain: float = 18.0, min_ratio: float = 5.0) -> Model:
    """Learn from the documents and labels for which ``training`` (on doc_id) holds.

    ``min_gain`` is the log likelihood ratio that an n-gram needs: about the logarithm of
    the number of n-grams that are tried, so that few enter by chance; ``min_ratio`` is how many times oftener toxic texts must
    hold it, which keeps out what merely tells languages or lengths apart."""
    spark = docs.sparkSession
    empty = Model(Chosen([]), np.zeros(0), -500.0)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(training & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("prior")).first()["prior"]
    if not found:
        return empty
    prior = min(max(found, 1e-3), 0.9)
    order = F.xxhash64(F.col("doc_id"), F.lit("pu"))
    some = known.filter("toxic = 1").orderBy(order, "doc_id").select("doc_id", F.lit(True).alias("positive")).limit(positives)
    other = base.filter(training & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").select("doc_id", F.lit(False).alias("positive")).limit(unlabelled)
    # at most positives + unlabelled ids: a bounded table
    ids = spark.createDataFrame(some.unionByName(other).collect(), "doc_id long, positive boolean")
    sample = base.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    sample = sample.select("positive", "text").repartition(6)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, key = present(b.column("text"), None)
            mark = b.column("positive").to_numpy(zero_copy_only=False)[row]
            for side in (True, False):
                value, n = np.unique(key[mark == side], return_counts=True)
                yield pa.record_batch({"key": value, "positive": pa.array([side] * len(value), pa.bool_()), "n": n})

    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return empty
    share_p, share_u = F.col("p") / F.lit(float(n_p)), F.col("u") / F.lit(float(n_u))
    clean = F.greatest(F.lit(0.0), share_u - F.lit(prior) * share_p) / F.lit(1 - prior)
    top = (
        sample.mapInArrow(frequency, "key long, positive boolean, n long")
        .groupBy("key")
        .agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("u"))
        .filter(F.col("p") >= max(2, n_p // 500))
        .withColumn("gain", F.col("p") * F.log((share_p + 1.0 / n_u) / (clean + 1.0 / n_u)))
        .filter((F.col("gain") >= min_gain) & (share_p >= min_ratio * (clean + 1.0 / n_u)))
        .orderBy(F.desc("gain"), "key")
        .select("key", (share_u / share_p).alias("mix"))
        .limit(n_features)
        .collect()
    )
    chosen = Chosen([r["key"] for r in top])
    if top:  # clean texts hardly hold the best features, so U's share over P's is the prior in U
        prior = min(prior, max(1e-3, float(np.quantile([r["mix"] for r in top[:50]], 0.8))))
    shared = spark.sparkContext.broadcast(chosen)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, feature = present(b.column("text"), shared.value)
            cut = np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, b.num_rows)))
            yield pa.record_batch({"positive": b.column("positive"), "feature": pa.array(cut, pa.list_(pa.int32()))})

    got = sample.mapInArrow(rows, "positive boolean, feature array<int>").toPandas()
    size = np.array([len(x) for x in got["feature"]], np.int64)
    row = np.repeat(np.arange(len(got)), size)
    feature = np.concatenate([np.asarray(x, np.int64) for x in got["feature"]]) if size.sum() else np.zeros(0, np.int64)
    weight, bias = train(row, feature, got["positive"].to_numpy(bool), len(top), prior)
    return Model(chosen, weight, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted added (columns of these names are replaced)."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            value = shared.value.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(rows, schema)
