"""Column functions against plain Python written from the behaviour they must have."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from docquery_spark.functions import model_output as m
from docquery_spark.functions import routing, text, vectors


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


TEXTS = ["", " ", "x" * 39, "x" * 40, " " * 5 + "x" * 40 + "\n\t", "　 x\n\t", "\x1c" + "y" * 40 + "\x85", "é" * 500, "a" * 501, "\U0001f600" * 501, None]


def test_text_gate_and_strip(spark):
    assert column(spark, TEXTS, "string", text.strip) == [None if t is None else t.strip() for t in TEXTS]
    assert column(spark, TEXTS, "string", text.is_text_chunk) == [t is not None and len(t.strip()) >= 40 for t in TEXTS]


@pytest.mark.parametrize("n", [500, 1000])
def test_truncate_counts_characters(spark, n):
    assert column(spark, TEXTS, "string", lambda c: text.truncate(c, n)) == [None if t is None else t[:n] + "..." if len(t) > n else t for t in TEXTS]


def test_markdown(spark):
    tables = [[], [["h"]], [["a", None], ["0", ""]], [["a|b", "c"], ["x"], ["y", "z"]]]
    line = lambda r: "| " + " | ".join(c or "" for c in r) + " |"
    want = ["\n".join([line(t[0]), "| " + " | ".join("---" for _ in t[0]) + " |", *map(line, t[1:])]) if t else "" for t in tables]
    assert column(spark, tables, "array<array<string>>", text.table_to_markdown) == want
    assert column(spark, tables, "array<array<string>>", text.is_table_chunk) == [False, False, True, True]


def test_word_count(spark):
    assert column(spark, ["", " a  b\n", "a　b\x1cc", None], "string", text.word_count) == [0, 2, 3, 0]


REPLIES = [
    '{"a": 1}', 'so {"a": 1} there', "<think>{x}</think>{\"a\": 2}", "<THINK>p\nq</Think> r <think>s</think>", "{broken", "", "no", None,
    '{"a": 1} and {"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1}, "y": {"b": 2}', '{"a": 1}], [{"b": 2}', '{"a": 1}} {"b": {}', '{"a": {"b": [1, {}]}}', "{'a': 1}",
    "<think>\nplan\n</think>\n\nParis.\n", "\t{\n\"a\": 1\n}\n",
    '{"is_valid": "false", "s": null, "l": ["x", "y"], "o": "lone", "n": 3, "c": "0.5"}',
]


def test_safe_json(spark):
    def want(r, reasoning):
        r = re.sub(r"<think>.*?</think>", "", r or "", flags=re.S | re.I) if reasoning else r or ""
        found = re.search(r"\{.*\}", r, re.S)
        try:
            return json.loads(found[0]) if found else {}
        except ValueError:
            return {}

    for reasoning in (False, True):
        got = column(spark, REPLIES, "string", lambda c: m.json_text(c, reasoning))  # noqa: B023
        assert [json.loads(g) for g in got] == [want(r, reasoning) for r in REPLIES]


def test_reasoning_and_answer_lose_outer_white_space(spark):
    replies = ["<THINK>p\nq</Think> r <think>s</think>", "<think>\nplan\n</think>\n\nParis.\n", "\t plain\u3000\n", "", None]
    assert column(spark, replies, "string", m.reasoning) == ["p\nq", "plan", "", "", None]
    assert column(spark, replies, "string", m.answer_text) == ["r", "Paris.", "plain", "", None]


def test_strip_is_linear(spark):
    import time

    spaces = "x" + " " * 1_000_000 + "y"
    began = time.perf_counter()
    assert column(spark, [spaces, " " * 1_000_000], "string", lambda c: F.length(text.strip(c))) == [1_000_002, 0]
    assert time.perf_counter() - began < 20
    every = "".join(map(chr, [*range(0x3001), 0xFEFF]))
    white = "".join(c for c in every if c.isspace())
    assert set(white) == set(text.WHITE)


def test_loose_fields(spark):
    doc = lambda f: column(spark, REPLIES[-1:], "string", lambda c: f(m.json_variant(c)))[0]
    assert doc(lambda d: m.boolean_field(d, "is_valid", True)) is False and doc(lambda d: m.boolean_field(d, "none", True)) is True
    assert doc(lambda d: m.field(d, "s", "string", "default")) == "default"
    assert doc(lambda d: m.array_field(d, "l")) == ["x", "y"] and doc(lambda d: m.array_field(d, "o")) == ["lone"] and doc(lambda d: m.array_field(d, "s")) == []
    assert doc(lambda d: m.field(d, "c", "double", 1.0)) == 0.5
    assert column(spark, ["null", "NULL", "x", "", None], "string", m.nullable_text) == [None, None, "x", None, None]
    assert column(spark, ["0.25", "x", None], "string", m.score_or) == [0.25, 1.0, 1.0]


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.normalise(F.col("a")).alias("n")).collect()
    assert math.isclose(got[0]["c"], 0.96) and got[1]["c"] == 0.0 and got[0]["n"] == [0.6, 0.8] and got[1]["n"] == [0.0, 0.0]


def test_routing(spark):
    asks = ["What does figure 2 show?", "図2は", "the mapping", "flower", "CHART", "method", None]
    assert column(spark, asks, "string", routing.asks_for_visuals) == [True, True, True, True, True, False, False]
    texts = ["See Figure 2a", "vegetable", "Refer to it", "Figure showing", None]
    assert column(spark, texts, "string", routing.has_reference) == [True, True, True, False, False]
    assert column(spark, ["See Figure 2a and fig. 3; Table  4, vegetables 5"], "string", routing.reference_targets) == [["figure 2a", "figure 3", "table 4"]]
    assert column(spark, [0.49, 0.5, None], "double", routing.needs_retry) == [True, False, True]
    assert column(spark, ["boolean", " Correction ", "categorical\n", "\tnumeric", "zzz", None], "string", routing.score_type) == ["BOOLEAN", "CORRECTION", "CATEGORICAL", "NUMERIC", "NUMERIC", "NUMERIC"]


@pytest.mark.parametrize(("valid", "corrected", "confidence", "want"), [
    (True, False, 0.25, "accepted"), (True, False, 0.24, "discarded"), (True, True, 0.9, "accepted"), (False, True, 0.0, "corrected"),
    (False, False, 0.9, "discarded"), (None, True, 0.9, "corrected"), (True, False, None, "discarded"),
])
def test_disposition(spark, valid, corrected, confidence, want):
    df = spark.createDataFrame([(valid, corrected, confidence)], "v boolean, c boolean, f double")
    assert df.select(routing.disposition(F.col("v"), F.col("c"), F.col("f"))).first()[0] == want
