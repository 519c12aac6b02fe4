"""Grouping spelling variants by a symmetric-delete join.

1. Words are counted over all texts.  A run of letters is lower-cased; in one of ``EVERY``
   (document, run) pairs, picked by a checksum, one letter of it is taken out, which makes the
   misspelt forms that the counts of a corpus show.  Counts are combined before the shuffle, so
   a word that is a third of all words is one row of each task.
2. Every word emits a key for itself and one for each of its distinct single deletions.  Two
   words at distance one share exactly one of these keys: the shorter word itself, or what is
   left of both without the replaced character.  Keys are 64-bit sums over the characters and
   their places, from prefix sums, so that a word of n characters costs n steps, however long.
   The key table is joined with itself.  As many words share a key as have one more character,
   at most the alphabet times the length, whatever the corpus, so no key is hot.
3. The pairs found are compared by their characters: exactly one inserted, deleted or replaced
   code point.  Words whose keys only clash go here.
4. A word's form is its near word of largest count (ties: the smallest), if that count is at
   least ``RATIO`` times its own.
5. Roots follow the forms to the last one.  The joins double the distance in each round; since
   counts grow tenfold with every form, there are at most 18 forms in a row and five rounds.

Tables of words grow with the corpus, so no join broadcasts one: their files are small, being
compressed, and Spark would pass such a table whole through the driver.

Defined cases: null or empty text has no words; a null id counts as the empty text in the
checksum; repeated rows count again; words with fewer than ``SHORTEST`` code points or fewer
than ``LEAST`` occurrences are no words; a run of megabytes is one word; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, mix, settle, slices

SHORTEST, LEAST, RATIO, EVERY = 7, 2, 10, 31
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Multiplier of a character's place; odd, so that it has an inverse modulo 2**64.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def counted(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """``docs(doc_id, text)`` → (word, n)."""
    # a run that is too short before a letter goes is too short after it
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).filter(f"n >= {LEAST}")


def delete_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and of their distinct single deletions, and the word each is of."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - first[owner]
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max(initial=0)), _STEP))), dtype=np.uint64)
    value = mix(points + np.uint64(1))
    here = np.concatenate(([np.uint64(0)], np.cumsum(value * power[place + 1])))  # sums wrap, and so do their differences
    down = np.concatenate(([np.uint64(0)], np.cumsum(value * power[place])))
    whole = here[first + size] - here[first]
    i = np.arange(len(points))
    last = np.ones(len(points), bool)  # of a run of one character, whose deletions are equal
    last[:-1] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    i = i[last]
    own = owner[i]
    gone = (here[i] - here[first[own]]) + (down[(first + size)[own]] - down[i + 1])
    return mix(np.concatenate((whole, gone))).view(np.int64), np.concatenate((np.arange(len(words)), own))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "word"):
        keys, own = delete_keys(b.column("word").to_pylist())
        yield pa.record_batch({"key": pa.array(keys), "id": b.column("id").take(pa.array(own))})


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts two words; a few
    comparisons of slices, whatever the length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # the common prefix, by halves
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [one_apart(x, y) for x, y in zip(b.column("a_word").to_pylist(), b.column("b_word").to_pylist(), strict=True)]
        yield b.filter(pa.array(good, pa.bool_()))


def near_pairs(words: DataFrame) -> DataFrame:
    """``words(id, word, n)``, distinct words → both directions of each near pair:
    (id, other, other_word, other_n)."""
    keys = words.select("id", "word").mapInArrow(_emit, "key long, id long")
    pairs = keys.alias("a").join(keys.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    one = words.select(F.col("id").alias("a"), F.col("word").alias("a_word"), F.col("n").alias("a_n"))
    two = words.select(F.col("id").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n"))
    pairs = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "a_word", "b_word", "a_n", "b_n")
    found = settle(pairs.mapInArrow(_exact, pairs.schema), "near")
    sides = [found.select(F.col(x).alias("id"), F.col(y).alias("other"), F.col(f"{y}_word").alias("other_word"), F.col(f"{y}_n").alias("other_n")) for x, y in (("a", "b"), ("b", "a"))]
    return sides[0].unionByName(sides[1])


def followed(forms: DataFrame) -> DataFrame:
    """``forms(id, form)`` without cycles → (id, root): where following the forms ends."""
    links = settle(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = settle(links.join(ahead.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_settled(links)
        links = new.select("id", "root")
        if not new.filter("moved").limit(1).count():
            return links


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → (word, form, root, n, n_near, form_n), one row for each word."""
    words = settle(counted(docs).withColumn("id", F.monotonically_increasing_id()), "words")
    best = near_pairs(words).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other_word", "other")).alias("top"))
    top = words.join(best.hint("merge"), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(-F.col("top.m") >= RATIO * F.col("n"), c).alias(name) for name, c in (("form_id", F.col("top.other")), ("form", F.col("top.other_word")), ("form_n", -F.col("top.m")))])
    top = settle(top, "forms")
    roots = followed(top.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    names = words.select(F.col("id").alias("root_id"), F.col("word").alias("root_word"))
    named = roots.withColumnRenamed("root", "root_id").join(names.hint("merge"), "root_id").select("id", "root_word")
    return top.join(named.hint("merge"), "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
