"""Exports of chunks, answers, scores and trace events as JSON lines or appended tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing, text
from ..schemas import SCORES, TRACE_EVENTS


def exported_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks as they are exported: long texts cut to 500 characters, no embedding or links."""
    return chunks.drop("embedding", "cross_links").withColumn("structured_text", text.truncate(F.col("structured_text"), text.STORED_TEXT_CHARS))


def exported_answers(answers: DataFrame) -> DataFrame:
    return answers.withColumn("reasoning_trace", text.truncate(F.col("reasoning_trace"), text.TRACE_CHARS))


def save_chunks(chunks: DataFrame, folder: str, stem: str) -> str:
    path = f"{folder}/{stem}_chunks.json"
    exported_chunks(chunks).write.mode("overwrite").json(path)
    return path


def save_answers(answers: DataFrame, folder: str, stem: str) -> str:
    """Keyed by question within the folder, so that one query doesn't overwrite another's answer."""
    path = f"{folder}/{stem}_answers"
    exported_answers(answers).write.mode("append").partitionBy("qid").json(path)
    return path


def pretty(df: DataFrame, limit: int = 100) -> str:
    """A readable JSON array of a small result, non-ASCII kept."""
    return json.dumps([json.loads(x) for x in df.limit(limit).toJSON().collect()], ensure_ascii=False, indent=2)


def append_scores(scores: DataFrame, path: str) -> None:
    """Appends scores, their types normalised."""
    typed = scores.withColumn("data_type", routing.score_type(F.col("data_type")))
    typed.select(*SCORES.fieldNames()).write.mode("append").parquet(path)


def answer_scores(answers: DataFrame) -> DataFrame:
    """The grounding score of each validated answer, as score rows."""
    s = F.col("validation_summary")
    return answers.filter(s.isNotNull()).select(
        "trace_id", F.lit("answer_grounding").alias("name"), s["answer_verdict_score"].alias("value"), F.lit("NUMERIC").alias("data_type"),
        text.join_issues(s["hallucinations"]).alias("comment"),
    )


def append_events(spark: SparkSession, events: Iterable[tuple], path: str) -> None:
    """Appends (trace_id, span, level, message, elapsed_ms) rows."""
    spark.createDataFrame(list(events), TRACE_EVENTS).write.mode("append").parquet(path)
