"""Predicates and look-ups that steer chunks, questions and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Chunk types, visual keywords, cross-reference phrases, score types.
CHUNK_TYPES = ("text", "table", "figure")
VISUAL_KEYWORDS = (
    "figure", "graph", "chart", "flow", "diagram", "image", "plot", "map",
    "図", "グラフ", "フロー", "フローチャート", "チャート", "表",
)
REFERENCE_PHRASES = ("see figure", "table", "section", "refer to")
SCORE_TYPES = ("NUMERIC", "BOOLEAN", "CATEGORICAL", "CORRECTION")
CONFIDENCE_FLOOR = 0.25
RETRY_BELOW = 0.5


def _contains_any(c: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def asks_for_visuals(question: Column) -> Column:
    """The question contains a visual keyword, inside words too."""
    return _contains_any(question, VISUAL_KEYWORDS)


def has_reference(text: Column) -> Column:
    """The text contains a cross-reference phrase, inside words too."""
    return _contains_any(text, REFERENCE_PHRASES)


def reference_targets(text: Column) -> Column:
    """Strict references: (kind, number) of each ``Figure 2a`` or the like, as whole words."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b((?:figure|fig\.?|table|section)\s+[0-9]+[a-z]?)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"(?i)fig\.?\s", "figure "), r"\s+", " "))))


def score_type(c: Column) -> Column:
    """A known score type, whatever its case and outer white space; otherwise NUMERIC."""
    name = F.upper(strip(c))
    return F.when(name.isin(*SCORE_TYPES), name).otherwise("NUMERIC")


def needs_retry(confidence: Column, below: float = RETRY_BELOW) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) < below


def disposition(valid: Column, corrected: Column, confidence: Column, floor: float = CONFIDENCE_FLOOR) -> Column:
    """accepted, corrected or discarded: a correction of an invalid chunk skips the confidence floor."""
    ok = F.coalesce(valid, F.lit(False))
    return (
        F.when(~ok & corrected, "corrected")
        .when(ok & (F.coalesce(confidence, F.lit(0.0)) >= floor), "accepted")
        .otherwise("discarded")
    )
