"""Chunks from document and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_from_documents(docs: DataFrame) -> DataFrame:
    """One text chunk a document, ungated."""
    return docs.select(
        F.lit("text").alias("chunk_type"), F.lit(1).alias("page_num"), F.lit(0).alias("ordinal"), F.col("text").alias("raw_text"),
        F.lit(None).cast("binary").alias("raw_image"), F.lit(None).cast("array<double>").alias("bbox"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_file"), F.lit(None).cast("string").alias("parse_error"),
    )


def raw_from_pages(pages: DataFrame) -> DataFrame:
    """One text chunk a web page: scripts, styles and tags removed, white space runs made one space."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return pages.select(
        F.lit("text").alias("chunk_type"), F.lit(1).alias("page_num"), F.lit(0).alias("ordinal"), text.alias("raw_text"),
        F.lit(None).cast("binary").alias("raw_image"), F.lit(None).cast("array<double>").alias("bbox"), F.col("url").alias("source_file"),
        F.lit(None).cast("string").alias("parse_error"),
    )


def document_chunks(docs: DataFrame) -> DataFrame:
    """Documents as chunks of three types, ten pages and 101 confidences, all by their id."""
    kind = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("figure")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("chunk_id"), kind.alias("chunk_type"), (F.col("doc_id") % 10 + 1).cast("int").alias("page_num"),
        F.col("source").alias("source_file"), F.col("text").alias("structured_text"), F.substring("text", 1, 60).alias("intuition_summary"),
        (F.col("doc_id") * 37 % 101 / 100.0).alias("confidence"),
    )


def embedded_chunks(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Document chunks, each with a vector: the one whose number is its id, modulo the number of vectors.

    The pairing has no meaning; it tests operators. Documents that share a vector tie.
    """
    n = max(1, embeddings.count())
    chunks = document_chunks(docs)
    return chunks.join(embeddings, chunks["chunk_id"] % n == embeddings["vec_id"]).select(*chunks.columns, "embedding")
