"""A training corpus from ``documents``: classify, dedup, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns
a DataFrame; all but the last return the columns of documents. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquery_spark.llm import decontaminate, mixing, near_dedup, quality, sharding
from docquery_spark.llm._frames import Scratch, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is no higher than their language's threshold."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similarity 0.8 or more on shingles of five words."""
    return near_dedup.survivors(docs, k=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), mode="document")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents of small sources come twice."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", classify),
    ("near-dedup", near_duplicates),
    ("decontamination", clean),
    ("mixing", mix),
    ("sharding", shards),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again.

    A stage's table goes when the next one is written; the last goes when the session's JVM ends.
    """
    docs = _table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-2]:
            before, docs = docs, scratch.written(stage(spark, docs, sf_dir))
            scratch.drop(before)
        docs = written(STAGES[-2][1](spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
