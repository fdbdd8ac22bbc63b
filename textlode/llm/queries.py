"""The operators as registered queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.llm import bpe, counts, jaccard, lm, media, mixing, negatives, pii, quality, secrets, substring, toxicity, turns
from textlode.llm.common import remainder_column, stored, table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), jaccard.Similarity(words=3, num=90, den=100))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), toxicity.Settings()
    held_out = remainder_column(F.col("doc_id"), 4) == 2
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out, settings)
    scored = toxicity.score(docs, weights, settings)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = remainder_column(F.col("doc_id"), 7) == 2
    scored = lm.score(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", held_out)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    damaged = turns.damaged(original)
    audits = stored(turns.audits(damaged))
    digests = turns.digests(turns.repaired(damaged, audits))
    zeros = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    found = audits.join(digests.withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    every = original.select(F.col("conv_id").alias("conv")).distinct()
    found = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv_id")
    return found.select(F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in zeros.items()))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_quality_rules, op3_source_mixing, op4_secret_scan, op5_media_columns, op6_toxicity, op7_substring_dedup, op8_pii, op9_lm_scoring, op10_bpe_round_trip, op11_structure_repair, op12_hard_negatives, op13_token_counts)
}
