"""Corpus preparation as written stages: documents in, shards out.

Each stage works on all that the one before has kept and returns whole rows with the columns of documents; the last adds where each
row is stored. Every stage is one of the operators of ``civigrade.llm`` with its production parameters, and inherits the results that
the operator defines for nulls, empty and long texts, ties, repeated rows, empty tables and further columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civigrade.llm import containment, hilbert, mixing, near, quality
from civigrade.llm.shipping import ship
from civigrade.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text their language's quantile accepts."""
    ship(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard of five-word shingles 0.8 or more): the one with the smallest id."""
    ship(spark)
    return near.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return containment.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture holds it: each source once at least, none more often than the limit."""
    ship(spark)
    return mixing.mixture(docs)


def hilbert_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    ship(spark)
    return hilbert.document_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("temperature_mixing", temperature_mixing),
    ("hilbert_sharding", hilbert_sharding),
]
#: Perplexities and fingerprints are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
