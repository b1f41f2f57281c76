"""Reading what models return: JSON inside prose, reasoning blocks, loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

THINK = r"(?is)<think>(.*?)</think>"


def without_reasoning(c: Column) -> Column:
    return F.regexp_replace(c, THINK, "")


def _is_json(body: Column) -> Column:
    """Whether all of a text in braces is one JSON value.

    The parser stops after the first value. In an array nothing but another value can follow it, in an
    object nothing but another field, so what both take is followed by nothing.
    """
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), body, F.lit("}"))).isNotNull()


def json_text(c: Column, reasoning: bool = False) -> Column:
    """From the first brace to the last, as text; ``{}`` when there is none or it is not one JSON object.

    reasoning: drop reasoning blocks first.
    """
    body = F.regexp_extract(without_reasoning(c) if reasoning else c, r"(?s)\{.*\}", 0)
    return F.when((body != "") & _is_json(body), body).otherwise("{}")


def json_variant(c: Column, reasoning: bool = False) -> Column:
    return F.parse_json(json_text(c, reasoning))


def field(doc: Column, name: str, kind: str, default) -> Column:
    """A field of a variant, or the default where it is missing, null or of no use as that type."""
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", kind), F.lit(default).cast(kind) if default is not None else F.lit(None).cast(kind))


def array_field(doc: Column, name: str) -> Column:
    """A list of strings; a lone non-empty string becomes a list of one, anything else is empty."""
    many = F.try_variant_get(doc, f"$.{name}", "array<string>")
    one = F.try_variant_get(doc, f"$.{name}", "string")
    empty = F.array().cast("array<string>")
    is_list = F.try_variant_get(doc, f"$.{name}", "array<variant>").isNotNull()
    return F.when(is_list, F.coalesce(many, empty)).when(one.isNotNull() & (one != ""), F.array(one)).otherwise(empty)


def boolean_field(doc: Column, name: str, default: bool) -> Column:
    """true and false, as JSON or as words in any case; anything else is the default."""
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "boolean"), F.lit(default))


def nullable_text(c: Column) -> Column:
    """Null for the word null in any case, and for an empty text."""
    return F.when(F.lower(c).isin("null", ""), None).otherwise(c)


def score_or(c: Column, default: float = 1.0) -> Column:
    """A number in text, or the default."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def reasoning(c: Column) -> Column:
    """The first reasoning block without white space at its ends; empty without one."""
    return strip(F.regexp_extract(c, THINK, 1))


def answer_text(c: Column) -> Column:
    """The text without its reasoning blocks and without white space at its ends."""
    return strip(without_reasoning(c))
