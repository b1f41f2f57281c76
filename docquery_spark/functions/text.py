"""Text projections. All of them are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and strings that results must carry.
MIN_TEXT_CHARS = 40
MIN_TABLE_ROWS = 2
MIN_IMAGE_SIDE = 80
CONTEXT_CHARS = 800
JUDGE_SOURCE_CHARS = 600
JUDGE_CHUNK_CHARS = 1500
JUDGE_ORIGINAL_CHARS = 2000
STORED_TEXT_CHARS = 500
TRACE_CHARS = 1000
CONTEXT_SEPARATOR = "\n\n---\n\n"
WARNING_PREFIX = "[VALIDATION WARNING: claims may not be grounded]\n\n"
CORRECTED_PREFIX = "[CHECKPOINT-A CORRECTED] "
INSUFFICIENT = "Insufficient context"


#: White space, Unicode's and the four ASCII separators included.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """White space off both ends, in time linear in the text."""
    return F.btrim(c, F.lit(WHITE))


def is_text_chunk(c: Column) -> Column:
    """Page text that is long enough once stripped."""
    return F.coalesce(F.length(strip(c)) >= MIN_TEXT_CHARS, F.lit(False))


def is_table_chunk(rows: Column) -> Column:
    return F.coalesce(F.size(rows) >= MIN_TABLE_ROWS, F.lit(False))


def is_image_chunk(width: Column, height: Column) -> Column:
    return F.coalesce((width >= MIN_IMAGE_SIDE) & (height >= MIN_IMAGE_SIDE), F.lit(False))


def truncate(c: Column, n: int) -> Column:
    """The first n characters and three dots when there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def table_to_markdown(rows: Column) -> Column:
    """array<array<string>> -> header, rule and body lines; null cells are empty, pipes stay."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    head = F.element_at(rows, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(head), rule), body), "\n")).otherwise("")


def embed_text(structured: Column, summary: Column) -> Column:
    """What is embedded for a chunk: its text, a blank line and its summary."""
    return F.concat(F.coalesce(structured, F.lit("")), F.lit("\n\n"), F.coalesce(summary, F.lit("")))


def word_count(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.regexp_count(c, F.lit(r"(?U)[^\s\x1C-\x1F]+")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def join_issues(issues: Column) -> Column:
    return F.array_join(F.coalesce(issues, F.array().cast("array<string>")), "; ")


def with_warning(answer: Column) -> Column:
    return F.concat(F.lit(WARNING_PREFIX), F.coalesce(answer, F.lit("")))


def corrected_notes(notes: Column) -> Column:
    return F.concat(F.lit(CORRECTED_PREFIX), F.coalesce(notes, F.lit("")))


def figure_notes(figure_type: Column, notes: Column) -> Column:
    return F.concat(F.lit("figure_type="), F.coalesce(F.nullif(figure_type, F.lit("")), F.lit("?")), F.lit(" | "), F.coalesce(notes, F.lit("")))


def annotate_schema(text: Column, schema: Column) -> Column:
    """Table text with its schema, as JSON, in a comment below."""
    return F.concat(text, F.lit("\n<!-- schema: "), F.coalesce(schema, F.lit("{}")), F.lit(" -->"))


def or_original(corrected: Column, original: Column, kind: str = "string") -> Column:
    """The corrected value unless it is null or empty."""
    empty = F.size(corrected) == 0 if kind == "array" else corrected == ""
    return F.when(corrected.isNull() | empty, original).otherwise(corrected)


def context_entry(rank: Column, kind: Column, source: Column, page: Column, score: Column, summary: Column, text: Column) -> Column:
    """One numbered source of a context: header, summary and the start of the text."""
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] ("), F.upper(kind), F.lit(" | "), source, F.lit(" p."), page.cast("string"),
        F.lit(" | score="), F.format_string("%.2f", score), F.lit(")\nSummary: "), F.coalesce(summary, F.lit("")),
        F.lit("\nContent: "), F.substring(F.coalesce(text, F.lit("")), 1, CONTEXT_CHARS),
    )


def judge_entry(rank: Column, text: Column) -> Column:
    return F.concat(F.lit("[Source "), rank.cast("string"), F.lit("] "), F.substring(F.coalesce(text, F.lit("")), 1, JUDGE_SOURCE_CHARS))
