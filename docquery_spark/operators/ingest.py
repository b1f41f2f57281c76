"""Ingest: gates, routed extraction with one retry, checkpoint A, acceptance, counters.

Filters stand before the Python stages, since Spark can't move them there. Every failure becomes a
status column of its row. What a failed judge means is a parameter: with ``fail_open``, the default,
the chunk counts as valid and its status says that nobody judged it; without, it is discarded.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import model_output as m
from ..functions import routing, text
from ..tables import written
from . import linking
from .models import Extractor, Judge, identity_extractor, in_batches, lexical_judge, rule_extractor

# What a field is when the model leaves it out, by chunk type.
DEFAULT_CONFIDENCE = {"text": 0.7, "table": 0.7, "figure": 0.6}
DEFAULT_TEXT_CHARS = {"text": 2000, "figure": 1000}
OCR_CONFIDENCE, OCR_SUMMARY, OCR_FAILED, OCR_NOTES = 0.3, "OCR fallback.", "[OCR unavailable]", "Vision model not loaded."


def gate(raw: DataFrame) -> DataFrame:
    """Chunks worth extracting: no parse error, and text long enough. Tables and images are gated by the parser."""
    keep = F.col("parse_error").isNull() & F.when(F.col("chunk_type") == "text", text.is_text_chunk(F.col("raw_text"))).otherwise(True)
    return raw.filter(keep & F.col("chunk_type").isin(*routing.CHUNK_TYPES))


def chunk_id(*cols: Column) -> Column:
    """An id from the content, so that ingesting a file again gives the same ids."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def _ask(extractor: Extractor, retries: bool, ocr: Callable[[bytes], str] | None):
    def load():
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            raw, failed, seen = [], [], []
            for kind, content, image in zip(pdf["chunk_type"], pdf["raw_text"], pdf["raw_image"], strict=True):
                reply = error = read = None
                try:
                    reply = extractor(kind, content or "", retries, *([] if image is None else [bytes(image)]))
                except Exception as e:  # a model's failure is data
                    error = f"{type(e).__name__}: {e}"[:200]
                    if kind == "figure" and image is not None and ocr is not None:
                        try:
                            read = ocr(bytes(image))
                        except Exception as again:
                            error = f"{error}; {type(again).__name__}: {again}"[:200]
                raw.append(reply)
                failed.append(error)
                seen.append(read)
            return pdf.assign(reply=raw, extract_error=failed, ocr_text=seen)

        return one

    return in_batches(load)


def _fields(asked: DataFrame) -> DataFrame:
    """Model replies -> chunk fields with the defaults of each type."""
    kind, content = F.col("chunk_type"), F.coalesce("raw_text", F.lit(""))
    doc = m.json_variant(F.coalesce("reply", F.lit("")))
    failed_figure = (kind == "figure") & F.col("reply").isNull()
    plain = (
        F.when(kind == "table", content)
        .when(kind == "figure", F.substring(F.coalesce("reply", F.lit("")), 1, DEFAULT_TEXT_CHARS["figure"]))
        .otherwise(F.substring(content, 1, DEFAULT_TEXT_CHARS["text"]))
    )
    body = F.coalesce(F.try_variant_get(doc, "$.structured_text", "string"), plain)
    schema = F.coalesce(F.to_json(F.try_variant_get(doc, "$.schema", "variant")), F.lit("{}"))
    notes = m.field(doc, "agent_notes", "string", "")
    default = F.when(kind == "figure", DEFAULT_CONFIDENCE["figure"]).otherwise(DEFAULT_CONFIDENCE["text"])
    return asked.withColumns({
        "structured_text": F.when(failed_figure, F.coalesce(F.nullif("ocr_text", F.lit("")), F.nullif("raw_text", F.lit("")), F.lit(OCR_FAILED)))
        .when(kind == "table", text.annotate_schema(body, schema)).otherwise(body),
        "intuition_summary": F.when(failed_figure, OCR_SUMMARY).otherwise(m.field(doc, "intuition_summary", "string", "")),
        "key_concepts": m.array_field(doc, "key_concepts"),
        "confidence": F.when(failed_figure, OCR_CONFIDENCE).otherwise(F.coalesce(F.try_variant_get(doc, "$.confidence", "double"), default)),
        "agent_notes": F.when(failed_figure, OCR_NOTES)
        .when(kind == "figure", text.figure_notes(F.try_variant_get(doc, "$.figure_type", "string"), notes)).otherwise(notes),
        "extract_status": F.when(F.col("extract_error").isNotNull(), F.concat(F.lit("error: "), "extract_error"))
        .when(m.json_text(F.coalesce("reply", F.lit(""))) == "{}", "no JSON").otherwise("ok"),
    }).drop("reply", "extract_error", "ocr_text")


def extract(raw: DataFrame, extractor: Extractor = rule_extractor, ocr: Callable[[bytes], str] | None = None, retry_below: float = routing.RETRY_BELOW) -> DataFrame:
    """Gated raw chunks -> processed chunks, with what they come from (raw_text, raw_image).

    A chunk of low confidence is asked for once more, and the second reply stands. First replies are
    written down, so that a model is never asked again for a lost executor's sake. ocr: reads the image
    of a figure whose model failed.
    """
    base = ["chunk_type", "page_num", "ordinal", "raw_text", "raw_image", "source_file"]
    string = T.StringType()
    asked_schema = T.StructType([*[raw.schema[c] for c in base], *[T.StructField(c, string) for c in ("reply", "extract_error", "ocr_text")]])
    retry = routing.needs_retry(F.col("confidence"), retry_below)
    first = written(_fields(raw.select(*base).mapInPandas(_ask(extractor, False, ocr), asked_schema)))
    second = _fields(first.filter(retry).select(*base).mapInPandas(_ask(extractor, True, ocr), asked_schema))
    kept = first.filter(~retry)
    return kept.unionByName(second).withColumn("chunk_id", chunk_id(*[F.col(c) for c in ("source_file", "page_num", "chunk_type", "ordinal", "raw_text")]))


def judge_view(structured: Column) -> Column:
    """What a judge is shown of a chunk: its fields as JSON, the start of its text."""
    empty = F.lit("")
    return F.to_json(F.struct(
        F.col("chunk_type"), F.substring(F.coalesce(structured, empty), 1, text.JUDGE_CHUNK_CHARS).alias("structured_text"),
        F.coalesce("intuition_summary", empty).alias("intuition_summary"), F.coalesce("key_concepts", F.array().cast("array<string>")).alias("key_concepts"),
        F.col("confidence"), F.coalesce("agent_notes", empty).alias("agent_notes"),
    ))


def validate_chunks(chunks: DataFrame, judge: Judge = lexical_judge) -> DataFrame:
    """Checkpoint A: adds validation (struct) and judge_status.

    A figure is judged by its image; should that fail, by its fields alone. A reply without a verdict
    is ``malformed``, a raised error ``error: ...``; both leave the chunk valid or not by the policy of
    :func:`accept`.
    """

    def load():
        def ask(mine, original, image):
            if image is not None:
                try:
                    return judge(mine, original, bytes(image))
                except Exception:
                    original = f"[Figure: {mine}]"
            return judge(mine, original)

        def one(pdf):
            replies, errors = [], []
            for mine, original, image in zip(pdf["_shown"], pdf["_original"], pdf["raw_image"], strict=True):
                try:
                    replies.append(ask(mine, original, image))
                    errors.append(None)
                except Exception as e:
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            return pdf.assign(_reply=replies, _error=errors)

        return one

    shown = chunks.withColumns({
        "_shown": judge_view(F.col("structured_text")),
        "_original": F.substring(F.coalesce("raw_text", F.lit("")), 1, text.JUDGE_ORIGINAL_CHARS),
    })
    schema = T.StructType([*shown.schema.fields, T.StructField("_reply", T.StringType()), T.StructField("_error", T.StringType())])
    doc = F.col("_doc")
    valid = F.try_variant_get(doc, "$.is_valid", "boolean")
    score = m.field(doc, "verdict_score", "double", 1.0)
    corrected = F.struct(
        text.or_original(F.try_variant_get(doc, "$.corrected_structured_text", "string"), F.col("structured_text")).alias("structured_text"),
        text.or_original(F.try_variant_get(doc, "$.corrected_intuition_summary", "string"), F.col("intuition_summary")).alias("intuition_summary"),
        text.or_original(m.array_field(doc, "corrected_key_concepts"), F.col("key_concepts"), "array").alias("key_concepts"),
        score.alias("confidence"),
        text.corrected_notes(m.field(doc, "validator_notes", "string", "")).alias("agent_notes"),
    )
    return (
        shown.mapInPandas(in_batches(load), schema)
        .withColumn("_doc", m.json_variant(F.coalesce("_reply", F.lit("")), reasoning=True))
        .withColumn("judge_status", F.when(F.col("_error").isNotNull(), F.concat(F.lit("error: "), "_error")).when(valid.isNull(), "malformed").otherwise("ok"))
        .withColumn("validation", F.struct(
            F.coalesce(valid, F.lit(True)).alias("is_valid"), m.array_field(doc, "issues").alias("issues"),
            F.when(~F.coalesce(valid, F.lit(True)), corrected).alias("corrected"), score.alias("verdict_score"),
            m.field(doc, "validator_notes", "string", "").alias("validator_notes"),
        ))
        .drop("_doc", "_reply", "_error", "_shown", "_original")
    )


def accept(validated: DataFrame, fail_open: bool = True, floor: float = routing.CONFIDENCE_FLOOR) -> DataFrame:
    """Adds disposition and puts corrections in place. fail_open: a chunk whose judge failed counts as valid."""
    v = F.col("validation")
    valid = v["is_valid"] if fail_open else v["is_valid"] & (F.col("judge_status") == "ok")
    placed = validated.withColumn("disposition", routing.disposition(valid, v["corrected"].isNotNull(), F.col("confidence"), floor))
    use = F.col("disposition") == "corrected"
    return placed.withColumns({c: F.when(use, v["corrected"][c]).otherwise(F.col(c)) for c in ("structured_text", "intuition_summary", "key_concepts", "confidence", "agent_notes")})


def counters(accepted: DataFrame, *by: str) -> DataFrame:
    """One row, or one a value of ``by``: raw, accepted, corrected, discarded, upserted."""
    of = lambda d: F.count_if(F.col("disposition") == d)
    return accepted.groupBy(*by).agg(
        F.count("*").alias("raw"), of("accepted").alias("accepted"), of("corrected").alias("corrected"), of("discarded").alias("discarded"),
        F.count_if(F.col("disposition") != "discarded").alias("upserted"),
    )


def type_counts(chunks: DataFrame) -> DataFrame:
    """Chunks of each type, zeros included."""
    spark = chunks.sparkSession
    kinds = spark.createDataFrame([(k,) for k in routing.CHUNK_TYPES], "chunk_type string")
    return kinds.join(chunks.groupBy("chunk_type").agg(F.count("*").alias("n")), "chunk_type", "left").select("chunk_type", F.coalesce("n", F.lit(0)).alias("n"))


def ingest(
    raw: DataFrame, extractor: Extractor = rule_extractor, judge: Judge | None = lexical_judge, fail_open: bool = True, *,
    ocr: Callable[[bytes], str] | None = None, links: bool = False, floor: float = routing.CONFIDENCE_FLOOR, retry_below: float = routing.RETRY_BELOW,
) -> DataFrame:
    """Raw chunks -> processed chunks with disposition; without a judge only the confidence floor decides.

    links: adds cross_links, the references of each chunk to others that aren't discarded.
    """
    chunks = extract(gate(raw), extractor, ocr, retry_below)
    if judge is None:
        done = chunks.withColumn("disposition", routing.disposition(F.lit(True), F.lit(False), F.col("confidence"), floor))
    else:
        done = accept(validate_chunks(chunks, judge), fail_open, floor)
    done = done.drop("raw_image")
    if not links:
        return done
    done = written(done)
    return linking.attach(done, linking.link(done.filter("disposition <> 'discarded'")))


def ingest_linked(raw: DataFrame) -> DataFrame:
    """The mode without models: content as it is, all valid, references attached."""
    return ingest(raw, identity_extractor, judge=None, links=True)


def ingest_or_standard(raw: DataFrame, first: Callable[[DataFrame], DataFrame] = ingest_linked, **options) -> tuple[DataFrame, str]:
    """(chunks, ``ok`` or the error) of a mode; where it fails, of the standard one."""
    try:
        return written(first(raw)), "ok"
    except Exception as e:
        return ingest(raw, **options), f"{type(e).__name__}: {e}"[:200]
