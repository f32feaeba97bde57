"""The corpus pipeline: documents through quality rules to packed sequences.

Every stage takes all rows its predecessor kept and its decisions take effect: rejected, repeated
and near-duplicate documents go, personal data is replaced in the texts, and the last stage packs
what remains.  All stages but the last return the columns of ``documents``.  Stages handle null,
empty and repeated rows as their operators state; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relflow.llm import exact_dedup, packing, pii, quality_rules, simhash
from relflow.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate class."""
    return simhash.keep(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("pii", private), ("packing", pack)]

#: Streaming state, fingerprints and tokenizer ids have no SQL; test_pipeline_is_brute_force holds the stages against Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs, f"stage{n}")
    return docs
