"""A corpus pipeline: language ID, exact and near deduplication, mixing to target weights, packing.

Each stage takes the documents that the one before kept, as ``(spark, docs, sf_dir)``, and returns a DataFrame; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import exact_dedup, language_id, mixing, near_dedup, packing
from sievemark.llm.common import cut, remove, shared_dir, table
from sievemark.session import small_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones that are not held out."""
    return language_id.keep_accepted(docs, language_id.learn(docs))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


def _bounded(stage):
    return lambda spark, docs, sf_dir: stage(small_batches(spark), docs, sf_dir)


STAGES = [
    ("language_id", _bounded(identify_language)),
    ("exact_dedup", _bounded(drop_exact)),
    ("minhash_near_dedup", _bounded(drop_near)),
    ("mix_sources", _bounded(mix_sources)),
    ("best_fit_packing", _bounded(pack)),
]

#: SQL expresses neither the trained model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are a table in the shared folder, which is deleted
    when the next stage has its own."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        if before:
            remove(spark, f"{base}/{before}")
        docs, before = spark.read.schema(out.schema).parquet(f"{base}/{name}"), name
    packed = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, base)
    return packed
