"""A training-text pipeline: five operators, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
to the shared folder and read back as the next stage's docs.  All but the last return the
columns of ``documents``; other columns, also such that are named like what an operator adds,
are dropped where a stage begins.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vereda.llm import minhash, mixing, pieces, repeats, toxicity
from vereda.llm.common import settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have no features and stay; without a toxic label all stay; labels that
    are null or have no id are not learnt from; repeated rows, and rows that share an id, are each
    scored by their own text; null ids are scored, and not learnt from."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Texts without words (null ones too) and rows with a null id are linked with nothing and stay;
    rows equal in id and text count once; rows that share an id but not their text are told
    apart by a hash of the text, the smaller one first."""
    return minhash.one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier text has already go; what is left of a text stays, its words joined by
    one space, with n_chars as its new length.

    Null texts become empty ones; no row goes, also where nothing of its text is left; null ids
    come first; rows that share an id are ordered by a hash of their text, and rows equal in both
    count as one document, so that each keeps what the other has."""
    found = repeats.without_repeats(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their calibrated probabilities.

    A null source or language is a value of its own; texts without words weigh nothing and share
    their cell's probability; equal rows are decided alike, by a hash of the id (a null id's is
    the empty text's)."""
    return mixing.mixed(docs.select(*COLUMNS)).filter("sampled").select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with the digests of the decoded text.

    Null and empty texts have no ids; repeated rows are each encoded."""
    return pieces.encoded(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express the classifier; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
