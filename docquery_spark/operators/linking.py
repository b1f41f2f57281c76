"""Cross-references between chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routing

# Confidences that the detector reports.
LINK_CONFIDENCE, DETECTION_CONFIDENCE = 0.8, 0.85


def detect(chunks: DataFrame) -> DataFrame:
    """Chunks that mention another one, by phrase: source_chunk_id, link_type, confidence. No target is named."""
    return chunks.filter(routing.has_reference(F.col("structured_text"))).select(
        F.col("chunk_id").alias("source_chunk_id"), F.lit("cross_reference").alias("link_type"), F.lit(LINK_CONFIDENCE).alias("confidence")
    )


def detection_summary(chunks: DataFrame) -> DataFrame:
    """One row: has_links, n_links, confidence."""
    found = F.count_if(routing.has_reference(F.col("structured_text")))
    return chunks.agg((found > 0).alias("has_links"), found.alias("n_links")).withColumn("confidence", F.lit(DETECTION_CONFIDENCE))


def link(chunks: DataFrame) -> DataFrame:
    """Edges from chunks that name a figure, table or section of their file to the chunk that bears the name.

    A chunk bears a name when its text starts with it. The join is on (file, name); a chunk doesn't link to itself.
    """
    named = F.lower(F.regexp_extract("structured_text", r"(?i)^\s*((?:figure|table|section)\s+[0-9]+[a-z]?)\b", 1))
    targets = chunks.select("source_file", F.regexp_replace(named, r"\s+", " ").alias("name"), F.col("chunk_id").alias("target_chunk_id")).filter("name <> ''")
    mentions = chunks.select("source_file", F.explode(routing.reference_targets(F.col("structured_text"))).alias("name"), F.col("chunk_id").alias("source_chunk_id"), "chunk_type")
    return mentions.join(targets, ["source_file", "name"]).filter("source_chunk_id <> target_chunk_id").select(
        "source_chunk_id", "target_chunk_id", F.concat("chunk_type", F.lit("_references_"), F.split("name", " ")[0]).alias("link_type"),
        F.lit(LINK_CONFIDENCE).alias("confidence"), F.col("name").alias("description"),
    )


def attach(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """chunks with cross_links: an array, ordered by target, empty where there are none."""
    entry = F.struct("target_chunk_id", "link_type", "confidence")
    by_source = links.groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(entry)).alias("cross_links"))
    return chunks.join(by_source, "chunk_id", "left").withColumn("cross_links", F.coalesce("cross_links", F.array()))
