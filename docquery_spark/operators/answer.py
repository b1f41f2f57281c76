"""Answering: generation, checkpoint B, resolution, and the state graph as status columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import model_output as m
from ..functions import text
from ..tables import written
from . import retrieve as r
from .models import Generator, Judge, in_batches, lexical_judge

# Answers for questions without hits and without an answer.
NO_CONTEXT_ANSWER = "[No relevant context found] I couldn't find relevant information in the document to answer your question."
NO_CONTEXT_TRACE = "No chunks retrieved from vector store"
ERROR_ANSWER = "[Error] Failed to generate answer"


def extractive_generator(question: str, context: str) -> str:
    """The start of the best source with its citation. It quotes; it doesn't reason."""
    if not context:
        return text.INSUFFICIENT
    head, _, rest = context.partition("\nSummary: ")
    body = rest.partition("\nContent: ")[2].split(text.CONTEXT_SEPARATOR)[0]
    cite = head.partition("(")[2].partition(" | score")[0]
    return f"<think>best source: {head}</think>{body[:300].strip()} [{cite}]"


def generate(asked: DataFrame, generator: Generator = extractive_generator) -> DataFrame:
    """asked: question, context, ... -> adds answer, reasoning_trace, generate_status."""

    def load():
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            out, status = [], []
            for q, c in zip(pdf["question"], pdf["context"], strict=True):
                try:
                    out.append(generator(q, c or ""))
                    status.append("ok")
                except Exception as e:
                    out.append(None)
                    status.append(f"error: {type(e).__name__}: {e}"[:200])
            return pdf.assign(reply=out, generate_status=status)

        return one

    schema = T.StructType([*asked.schema.fields, T.StructField("reply", T.StringType()), T.StructField("generate_status", T.StringType())])
    return asked.mapInPandas(in_batches(load), schema).withColumns({
        "answer": m.answer_text(F.col("reply")), "reasoning_trace": F.coalesce(m.reasoning(F.col("reply")), F.lit(""))
    }).drop("reply")


def validate_answers(answers: DataFrame, judge: Judge = lexical_judge, mode: str = "structured") -> DataFrame:
    """Checkpoint B: adds verdict (struct) and judge_status (ok, malformed or error).

    mode: ``"structured"`` reads fields loosely (the word null is no revision, a score may be text, an
    unreadable one is 1.0) and a judge that raises leaves the answer grounded with 0.5; ``"json"`` takes
    the fields as they are, shows the judge question, answer and sources in one, and its failure leaves
    the defaults.
    """
    if mode not in ("structured", "json"):
        raise ValueError("mode is 'structured' or 'json'")
    structured = mode == "structured"

    def load():
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            out, errors = [], []
            for q, a, s in zip(pdf["question"], pdf["answer"], pdf["sources"], strict=True):
                shown = f"[QUESTION]\n{q}\n\n" + ("" if structured else f"[ANSWER]\n{a or ''}\n\n") + f"[SOURCES]\n{s or ''}"
                try:
                    out.append(judge(a or "", shown))
                    errors.append(None)
                except Exception as e:
                    out.append(json.dumps({"verdict_score": 0.5, "validator_notes": f"Validation error: {e}"}) if structured else "")
                    errors.append(f"error: {type(e).__name__}")
            return pdf.assign(reply=out, judge_error=errors)

        return one

    schema = T.StructType([*answers.schema.fields, T.StructField("reply", T.StringType()), T.StructField("judge_error", T.StringType())])
    doc = F.col("doc")
    grounded = m.boolean_field(doc, "is_grounded", True)
    revised = F.try_variant_get(doc, "$.revised_answer", "string")
    score = m.score_or(F.try_variant_get(doc, "$.verdict_score", "string")) if structured else m.field(doc, "verdict_score", "double", 1.0)
    told = F.try_variant_get(doc, "$.is_grounded", "boolean").isNotNull()
    return (
        answers.mapInPandas(in_batches(load), schema)
        .withColumn("doc", m.json_variant(F.coalesce("reply", F.lit("")), reasoning=True))
        .withColumn("judge_status", F.coalesce("judge_error", F.when(told, "ok").otherwise("malformed")))
        .withColumn("verdict", F.struct(
            grounded.alias("is_grounded"), m.array_field(doc, "hallucinations").alias("hallucinations"),
            (m.nullable_text(revised) if structured else F.when(revised != "", revised)).alias("revised_answer"),
            score.alias("verdict_score"), m.field(doc, "validator_notes", "string", "").alias("validator_notes"),
        ))
        .drop("doc", "reply", "judge_error")
    )


def resolve(answer: Column, grounded: Column, revised: Column) -> tuple[Column, Column]:
    """(final answer, was it revised): an ungrounded answer is replaced by its revision or bears a warning."""
    replace = ~grounded & revised.isNotNull()
    return F.when(replace, revised).when(~grounded, text.with_warning(answer)).otherwise(answer), replace


def outcome(n_hits: Column, validates: Column, answer: Column, grounded: Column, revised: Column) -> tuple[Column, Column]:
    """(final answer, phase reached) of the state graph: no context, error, unvalidated, validated, revised or warned."""
    final, replaced = resolve(answer, grounded, revised)
    checked = validates & answer.isNotNull()
    phase = (
        F.when(n_hits == 0, "insufficient_context").when(answer.isNull(), "error").when(~checked, "unvalidated")
        .when(replaced, "revised").when(~grounded, "warned").otherwise("validated")
    )
    text_ = F.when(n_hits == 0, NO_CONTEXT_ANSWER).when(answer.isNull(), ERROR_ANSWER).when(~checked, answer).otherwise(final)
    return text_, phase


def answer(
    chunks: DataFrame, questions: DataFrame, validates: bool = True, generator: Generator = extractive_generator, judge: Judge = lexical_judge, *,
    mode: str = "structured", k: int = r.TOP_K, figures: int = r.TOP_FIGURES, session: str | None = None,
) -> DataFrame:
    """One row a question: answer, phase, reasoning_trace, source_chunks, validation summary and statistics.

    Questions without hits skip the models. session: is part of the trace ids, which tell one run of a
    question from another.
    """
    hits = r.rendered(r.retrieve(chunks, questions, k, figures))
    asked = written(questions.select("qid", "question").join(hits, "qid", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0))))
    trace_id = F.sha2(F.concat_ws("|", F.lit(session), "qid", "question"), 256)
    asked = asked.withColumn("trace_id", trace_id)
    told = generate(asked.filter("n_hits > 0"), generator)
    if validates:
        told = validate_answers(told, judge, mode)
    else:
        verdict = "struct<is_grounded:boolean,hallucinations:array<string>,revised_answer:string,verdict_score:double,validator_notes:string>"
        told = told.withColumn("judge_status", F.lit("skipped")).withColumn("verdict", F.lit(None).cast(verdict))
    every = told.unionByName(asked.filter("n_hits = 0"), allowMissingColumns=True)
    v = F.col("verdict")
    final, phase = outcome(F.col("n_hits"), F.lit(validates), F.col("answer"), F.coalesce(v["is_grounded"], F.lit(True)), v["revised_answer"])
    return every.select(
        "qid", "question", final.alias("answer"), phase.alias("phase"),
        F.when(F.col("n_hits") == 0, NO_CONTEXT_TRACE).otherwise(F.coalesce("reasoning_trace", F.lit(""))).alias("reasoning_trace"),
        F.coalesce("source_chunks", F.array()).alias("source_chunks"), "trace_id", "judge_status",
        F.when(v.isNotNull(), F.struct(
            v["is_grounded"].alias("answer_is_grounded"), v["hallucinations"].alias("hallucinations"), v["verdict_score"].alias("answer_verdict_score"),
            v["validator_notes"].alias("validator_notes"), (phase == "revised").alias("answer_was_revised"),
        )).alias("validation_summary"),
        "n_hits", F.length(final).alias("answer_length"), F.coalesce(F.size(v["hallucinations"]), F.lit(0)).alias("hallucination_count"),
    )
