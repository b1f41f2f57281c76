"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, lm_score, mixing, near_dedup, quality, sharding, substring_dedup, token_counts
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"), keep="max")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdicts(decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return done.select("doc_id", "lang", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), F.col("accepted").alias("kept"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = quality.trusted_ids(_table(spark, sf_dir, "labels"))
    done = lm_score.score(_table(spark, sf_dir, "documents"), targets)
    return done.select("doc_id", "n_words", F.round("score", 5).alias("score"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_chats(_table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "n_turns", "copies", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, token_counts.VOCABULARY, keep=["doc_id"], untouched=True)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.clusters(_table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_exact_dedup, op3_decontamination, op4_sharding, op5_quality_classifier, op6_lm_scoring, op7_chat_formatting, op8_substring_dedup, op9_token_counts, op10_near_dedup)
}
