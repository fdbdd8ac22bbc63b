"""A corpus pipeline: quality, near duplicates, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns of ``documents``, and further ones
whatever their names are. Empty tables go through every stage, repeated rows are
rows like others, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.llm import bpe, jaccard, mixing, pii, quality
from textlode.llm.common import stored, table
from textlode.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go; null and empty texts fail the base rules."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect (five words a shingle, similarity 0.8 or more), the one with the least id stays.

    Rows of one id go or stay together; rows with a null id, and empty texts, stay.
    """
    return jaccard.keep_first(docs, jaccard.Similarity(words=5, num=8, den=10))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in angle brackets; n_chars follows. Null texts stay null."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and empty texts have no words and are not taken, a null source is one of its own."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and of the decoded text; null texts count as empty."""
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: SQL can express neither the hashed ratio nor the tokens; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
