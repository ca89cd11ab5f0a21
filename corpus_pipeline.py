"""A training-data pipeline: quality rules, near-dedup, private data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. No SQL states near-duplicate groups or boosted trees, so
ORACLE_SQL is None and tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions.shared import materialise
from weftgraph.llm import line_quality, mixing, near_dedup, pieces, private_data


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their hosts' boilerplate lines."""
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 or more)."""
    return near_dedup.dedup(docs, k=5, percent=80)


def private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return private_data.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mixing.mix(docs, mixing.WEIGHTS, mixing.OTHER)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("private_data", private_spans),
    ("pfair_mix", mixed_sources),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
