"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, mixing, quotes, resampling, simhash, sql, substrings, topk, toxicity, training_order, url_rules, vectors, warc
from .common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; nulls, ties, repeats: see :func:`vectors.near_vectors`."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; edge cases: see :func:`simhash.near_groups`."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated bytes of all documents; edge cases: see :func:`substrings.dedup_digest`."""
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every asked vector; edge cases: see :func:`topk.top_k`."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents in training order, written and read back; edge cases: see :func:`training_order.materialise`."""
    return training_order.materialise(table(spark, sf_dir, "documents"), *bpe.public_vocabulary())


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents; edge cases: see :func:`bpe.encode_digest`."""
    return bpe.encode_digest(table(spark, sf_dir, "documents"), *bpe.public_vocabulary())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier that never saw the held-out ones; edge cases: see :func:`toxicity.classify`."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).withColumn(
        "held_out", toxicity.held_out(F.col("doc_id"))
    ).select("doc_id", "held_out", "score", "predicted", "toxic_in_lang")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; edge cases: see :func:`url_rules.judge`."""
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op9_chat_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of all conversations; edge cases: see :func:`quotes.conversations`."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of all documents; edge cases: see :func:`mixing.plan`."""
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, normalised, indexed and read back; edge cases: see :func:`warc.payload_digest`."""
    return warc.payload_digest(table(spark, sf_dir, "pages"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and those drawn; edge cases: see :func:`resampling.resampled`."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents between two tokenizers; edge cases: see :func:`alignment.aligned`."""
    return alignment.aligned(table(spark, sf_dir, "documents"), *alignment.public_tokenizers_paths())


def queries() -> dict:
    own = (
        op1_embedding_near_dedup, op2_simhash_near_dedup, op3_suffix_array_dedup, op4_exact_top_k,
        op5_training_order, op6_byte_level_bpe, op7_toxicity, op8_url_filter,
        op9_chat_quotation_linking, op10_mixing, op11_warc, op12_importance_resampling, op13_cross_tokenizer_alignment,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": sql.VECTORS_SQL, "op3_suffix_array_dedup": sql.SUFFIX_SQL, "op4_exact_top_k": sql.TOP_K_SQL,
        "op8_url_filter": sql.URLS_SQL, "op9_chat_quotation_linking": sql.QUOTES_SQL, "op10_mixing": sql.MIXING_SQL,
        "op11_warc": sql.WARC_SQL, "op12_importance_resampling": sql.RESAMPLING_SQL,
    }
