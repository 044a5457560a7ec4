"""A training-data pipeline over documents: language ID, exact dedup, near-dedup, mixing, BPE.

Each stage works on all rows that its predecessor kept. The stages but the last return the columns of documents:
language ID drops what is no language, the dedup stages keep one document of each group, mixing drops and repeats
documents so that sources meet their targets, in training order. The last returns the tokens' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import bpe, exact_dedup, langid, mixing, simhash
from lodestack.llm.common import documents, keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that are some language. A null, empty or letterless text goes; rows are judged by their text alone, so ties and repeated rows share
    a verdict; a doc_id or lang may be null. No rows give none; columns stay, whatever others there are."""
    return langid.accepted(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each text, that of the largest doc_id; null texts count as empty, null doc_ids come last, and of rows that repeat a
    doc_id and its text one stays. No rows give none; columns stay, whatever others there are."""
    return exact_dedup.keep_distinct_texts(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest doc_id; rows without a doc_id stay, and a doc_id that
    stands at different texts joins nothing. No rows give none; columns stay, whatever others there are."""
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in training order, each as often as the mix has whole copies of it. Null sources are one source, the last; null and empty texts have
    no words and are in no mix; rows that repeat a doc_id share a plan. No rows give none; columns stay, whatever others there are."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests for each row of docs, repeated rows each; a null text is empty, and a doc_id may be null. No rows give none."""
    return bpe.round_trip(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", dedup_exact),
    ("SimHash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("BPE", tokenize),
]

#: Language ID and BPE can't be said in SQL; tests hold the pipeline against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
