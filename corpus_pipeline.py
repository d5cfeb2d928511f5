"""A corpus pipeline of five stages; every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import bpe, mixing, simhash, substrings, toxicity
from trailmark.llm.common import settle, sweep, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject by the threshold of their language.

    It learns from the labels of the documents given.  Null and empty texts are scored and stay unless rejected; a
    score at the threshold is a rejection; repeated rows have one fate; without labels of both kinds nothing is rejected.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Null and empty texts are copies of one another; rows repeated as a whole stay once; rows without doc_id stay.
    """
    return simhash.keep_one(docs)


def cut_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings; a document with nothing left stays, empty, and null becomes empty."""
    return substrings.remove_repeated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target weights; a null source is one of its own, the last."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; null is empty, repeated rows give repeated rows."""
    return bpe.encode_digest(docs, *bpe.public_vocabulary(), keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeated),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: No stage but mixing has an SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next.

    Tables that a stage made for itself are removed once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i:
            docs = settle(docs)
            sweep(spark, since, but=1)
        since = written(spark)
        docs = stage(spark, docs, sf_dir)
    return docs
