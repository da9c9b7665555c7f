"""The corpus pipeline: quality rules, language ID, near-duplicate removal and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first three return the
columns of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import language, near_dedup, packing, quality
from tesserae.session import checkpoint_ready, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.cascade(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, in no learned language, or in several, go."""
    return language.keep_known(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("best-fit packing", best_fit_packing),
]
#: Fitted models, similarity search and tokenizers are beyond SQL; a brute-force version in tests/llm stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is checkpointed in the shared folder before the next reads it."""
    checkpoint_ready(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
