"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor wrote and calls one operator of
``marketlens.llm``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.functions.staging import materialize
from marketlens.llm import content_sort, host_rules, mixture, near_dup, packing
from marketlens.llm.common import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or their host's verdict reject."""
    return host_rules.drop_rejected(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the largest id."""
    return content_sort.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep one document."""
    return near_dup.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that source, language and topic meet their targets."""
    return mixture.drop_unsampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fill sequences of 2048 tokens, every source at its share."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packed", packed),
]

#: Near copies and token ids cannot be computed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
