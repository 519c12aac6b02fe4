"""Which of many phrases texts contain: one pass with an automaton, or a keyed join.

Phrases whose measured size is within a bound are put into an Aho-Corasick automaton that every
worker holds; each text is read once, however many phrases there are.  Beyond the bound the
phrases stay a table and meet the texts by their rarest runs (``containment.holding``).  Both
give the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import containment

#: UTF-8 bytes of phrases up to which the automaton is used (it takes some fifty times as much in a worker).
LIMIT = 4 << 20


@cache
def _built(phrases: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        made.add_word(phrase, i)
    made.make_automaton()
    return made


def contained(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, limit: int = LIMIT) -> DataFrame:
    """(key, phrase): every phrase that a text contains, once; ``key`` should be unique.

    Defined cases: null texts contain nothing; null and blank phrases are in no text; repeated
    phrases count once; phrases that overlap, or lie in others, are all found."""
    needles = phrases.select(F.col(phrase).alias("phrase")).filter(F.trim("phrase") != "").distinct()
    size = needles.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("n")).first()["n"]
    if size > limit:
        return containment.holding(texts, key, text, needles, "phrase", "phrase").withColumnRenamed("phrase", phrase)
    words = sorted(r["phrase"] for r in needles.collect())  # at most ``limit`` bytes
    shared = texts.sparkSession.sparkContext.broadcast(tuple(words))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _built(shared.value)
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column("text")):
                if t.is_valid and shared.value:
                    hits = {n for _, n in made.iter(t.as_py())}
                    rows += [i] * len(hits)
                    found += hits
            taken = b.column("key").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array([shared.value[n] for n in found], pa.string())], names=["key", "phrase"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(stage, f"key {kind}, phrase string").select(F.col("key").alias(key), F.col("phrase").alias(phrase))


def first_alias(texts: DataFrame, key: str, text: str, aliases: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``aliases(place, alias, target)`` → (key, place, target): of the aliases that a text
    contains, the one that stands first in the list."""
    found = contained(texts, key, text, aliases, "alias", limit)
    best = aliases.groupBy("alias").agg(F.min(F.struct("place", "target")).alias("first"))
    named = found.join(best, "alias").groupBy(key).agg(F.min("first").alias("first"))
    return named.select(key, F.col("first.place").alias("place"), F.col("first.target").alias("target"))


def cited_parts(texts: DataFrame, key: str, named: DataFrame, numbers: Column, parts: DataFrame, most: int = 6) -> DataFrame:
    """The parts of a text's law that it cites: ``named(key, target)``, and ``parts(target,
    number, block)`` of all laws; the first ``most`` distinct ``numbers`` of a text count."""
    asked = texts.select(key, F.posexplode(F.slice(F.array_distinct(numbers), 1, most)).alias("place", "number"))
    return asked.join(named.select(key, "target"), key).join(parts, ["target", "number"]).select(key, "target", "place", "number", "block")
