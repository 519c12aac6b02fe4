"""Which texts hold which reference texts, whole, by an equi-join and an exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import let

_SPACE = r"[ \t\n\r\f\x0B]+"
#: Words of a seed.
SEED = 3


def _words(x: Column) -> Column:
    return F.filter(F.split(x, _SPACE), lambda w: w != "")


def _runs(words: Column, k: int) -> Column:
    """Hashes of the runs of k words."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
    hashed = lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))
    return F.array_distinct(let(words, lambda w: F.when(F.size(w) >= k, hashed(w))))


def holding(docs: DataFrame, doc: str, text: str, refs: DataFrame, ref: str, needle: str) -> DataFrame:
    """(doc, ref) for every text that contains a whole reference text.

    A reference's first and last words may be cut, those between are whole words of any text that
    holds it.  So a run of three inner words (of one, in references of three or four words) must
    occur in the text: that is the join, and ``contains`` then decides.  Of a reference's runs the
    one with the least hash is taken.  References without an inner word are met by windows of their
    own lengths; there are no windows where there are no such references.

    Defined cases: null and blank texts and references are linked with nothing."""
    r = refs.select(F.col(ref).alias("_r"), F.col(needle).alias("_needle")).filter(F.trim("_needle") != "")
    words = _words(F.col("_needle"))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    r = r.withColumn("_kind", F.when(F.size(inner) >= SEED, SEED).when(F.size(inner) >= 1, 1).otherwise(0))
    seed = F.when(F.col("_kind") == SEED, F.array_min(_runs(inner, SEED))).when(F.col("_kind") == 1, F.array_min(_runs(inner, 1))).otherwise(F.xxhash64("_needle"))
    r = r.withColumn("_seed", seed).withColumn("_kind", F.when(F.col("_kind") == 0, -F.length("_needle")).otherwise(F.col("_kind")))
    d = docs.select(F.col(doc).alias("_d"), F.col(text).alias("_text")).filter("_text is not null")
    kinds = [x["_kind"] for x in r.select("_kind").distinct().collect()]  # two, and the lengths of the shortest references

    def seeds(kind: int) -> Column:
        if kind > 0:
            return _runs(_words(F.col("_text")), kind)
        starts = F.sequence(F.lit(1), F.greatest(F.length("_text") + kind + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(F.col("_text"), i, F.lit(-kind)))))

    found = None
    for kind in kinds:
        met = d.select("_d", F.explode(seeds(kind)).alias("_seed")).join(r.filter(F.col("_kind") == kind).select("_r", "_seed"), "_seed").select("_d", "_r")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema[doc], refs.schema[ref]]))
    pairs = found.distinct().join(r.select("_r", "_needle"), "_r")
    return d.join(pairs, "_d").filter(F.contains("_text", "_needle")).select(F.col("_d").alias(doc), F.col("_r").alias(ref)).distinct()
