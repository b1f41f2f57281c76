"""Scans of binary documents with a pluggable parser.

A parser takes (path, bytes) and yields pages: dictionaries with ``tables`` (lists of rows), ``images``
((width, height, bytes) triples) and ``text``. No PDF library is bundled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MIN_IMAGE_SIDE, MIN_TABLE_ROWS, MIN_TEXT_CHARS, file_name
from ..schemas import RAW_CHUNKS

Parser = Callable[[str, bytes], Iterable[dict]]


def markdown(rows: list[list]) -> str:
    line = lambda r: "| " + " | ".join(str(c) if c else "" for c in r) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join("---" for _ in rows[0]) + " |", *map(line, rows[1:])])


def chunks_of(path: str, content: bytes, parser: Parser) -> list[tuple]:
    """Rows of one document: a page's tables, then its images, then its text; a failure is a row with its error."""
    name, out = path.rsplit("/", 1)[-1], []

    def add(kind, page, body=None, image=None, error=None):
        out.append((kind, page, len(out), body, image, None, name, error))

    try:
        for number, page in enumerate(parser(path, content), 1):
            for rows in page.get("tables") or ():
                if rows and len(rows) >= MIN_TABLE_ROWS:
                    add("table", number, markdown(rows))
            for image in page.get("images") or ():
                try:
                    width, height, data = image
                    if width >= MIN_IMAGE_SIDE and height >= MIN_IMAGE_SIDE:
                        add("figure", number, image=data)
                except (TypeError, ValueError) as e:  # this image only
                    add("figure", number, error=f"{type(e).__name__}: {e}")
            body = page.get("text") or ""
            if len(body.strip()) >= MIN_TEXT_CHARS:
                add("text", number, body)
    except Exception as e:
        add("text", 0, error=f"{type(e).__name__}: {e}"[:300])
    return out


def read(spark: SparkSession, path: str, parser: Parser, pattern: str = "*.pdf") -> DataFrame:
    """Raw chunks of all matching files under a path."""

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):  # one document's chunks at a time
                yield pd.DataFrame(chunks_of(p, bytes(c), parser), columns=RAW_CHUNKS.fieldNames())

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, RAW_CHUNKS)


def from_images(images: DataFrame) -> DataFrame:
    """(path, width, height, content) rows, large enough ones only, as figure chunks."""
    keep = images.filter((F.col("width") >= MIN_IMAGE_SIDE) & (F.col("height") >= MIN_IMAGE_SIDE))
    return keep.select(
        F.lit("figure").alias("chunk_type"), F.lit(1).alias("page_num"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("raw_text"),
        F.col("content").alias("raw_image"), F.lit(None).cast("array<double>").alias("bbox"), file_name(F.col("path")).alias("source_file"),
        F.lit(None).cast("string").alias("parse_error"),
    )
