"""Retrieval: exact cosine top-k, conditional figures, merge, context.

Questions are the small side and are broadcast in blocks of ``BLOCK`` rows, counted first; more
questions mean more passes over the chunks, never a larger broadcast. Each Arrow batch of chunks is
multiplied with a block's vectors and gives out its k best of each question, ids and scores only. The
texts of the few that win are looked up at the end, by a broadcast of at most k ids a question of a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import routing, text

BLOCK = 256
TOP_K, TOP_FIGURES = 8, 3


def _blocks(questions: DataFrame) -> list[DataFrame]:
    n = -(-questions.count() // BLOCK)
    if n <= 1:
        return [questions]
    # two thirds full on average, and each checked
    n = -(-n * 3 // 2)
    parts = [questions.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]
    return [q for p in parts for q in (_blocks(p) if p.count() > BLOCK else [p])]


def _best(block, k: int, digits: int = 12):
    """The k best chunks of a batch for each question: (qid, chunk_id, score).

    Scores are rounded, since the same vector's product can differ in its last bits by its place in a
    batch, and ties must fall to the smaller id.
    """

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            names, vectors = block.value
            ids = pdf["chunk_id"].to_numpy()
            scores = np.round(np.stack([np.asarray(e, dtype=np.float64) for e in pdf["embedding"]]) @ vectors.T, digits)
            rows = []
            for q, name in enumerate(names):
                own = scores[:, q]
                near = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else range(len(own))
                for i in sorted(near, key=lambda i: (-own[i], ids[i]))[:k]:  # noqa: B023
                    rows.append((name, ids[i], own[i]))
            yield pd.DataFrame(rows, columns=["qid", "chunk_id", "score"])

    return run


def top_k(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, chunk_type: str | None = None) -> DataFrame:
    """hits: qid, rank (1 based), score, and the chunk's columns but the embedding. Ties fall to the smaller chunk_id.

    Chunks and questions without a vector meet nobody.
    """
    if chunk_type is not None:
        chunks = chunks.filter(F.col("chunk_type") == chunk_type)
    spark = chunks.sparkSession
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    schema = T.StructType([questions.schema["qid"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    out = None
    for block in _blocks(questions.select("qid", "embedding").filter("embedding is not null")):
        rows = block.collect()  # BLOCK rows at most
        vectors = np.array([r["embedding"] for r in rows], dtype=np.float64)
        held = spark.sparkContext.broadcast(([r["qid"] for r in rows], vectors))
        if rows:
            best = chunks.filter("embedding is not null").select("chunk_id", "embedding").mapInPandas(_best(held, k), schema)
        else:
            best = spark.createDataFrame([], schema)
        hits = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        hits = chunks.drop("embedding").join(F.broadcast(hits), "chunk_id")
        out = hits if out is None else out.unionByName(hits)
    return out


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, figures: int = TOP_FIGURES) -> DataFrame:
    """Top k of all types, then, for questions about visuals, top figures whose text isn't among them.

    Adds source (``primary`` or ``figure``) and position (1 based, primary first). Embeddings are of
    unit length, so the dot product is the cosine.
    """
    first = top_k(chunks, questions, k).withColumn("source", F.lit("primary"))
    visual = questions.filter(routing.asks_for_visuals(F.col("question")))
    more = top_k(chunks, visual, figures, "figure").withColumn("source", F.lit("figure"))
    unseen = more.join(first.select("qid", "structured_text").distinct(), ["qid", "structured_text"], "left_anti")
    order = Window.partitionBy("qid").orderBy(F.desc("source"), "rank")
    return first.unionByName(unseen).withColumn("position", F.row_number().over(order))


def _chunk():
    return F.struct(
        "chunk_id", F.col("chunk_type").alias("type"), F.col("source_file").alias("file"), F.col("page_num").alias("page"),
        F.round("score", 3).alias("score"), F.col("intuition_summary").alias("summary"), F.col("structured_text").alias("text"),
    )


def _entry():
    return text.context_entry(F.col("position"), F.col("chunk_type"), F.col("source_file"), F.col("page_num"), F.col("score"), F.col("intuition_summary"), F.col("structured_text"))


def source_chunks(hits: DataFrame) -> DataFrame:
    """qid, source_chunks (ordered array of structs, scores to 3 places), n_hits."""
    return rendered(hits).select("qid", "source_chunks", "n_hits")


def context(hits: DataFrame) -> DataFrame:
    """qid, context (numbered entries for the generator), sources (numbered texts for the judge)."""
    return rendered(hits).select("qid", "context", "sources")


def rendered(hits: DataFrame) -> DataFrame:
    """qid, source_chunks, n_hits, context and sources: all that a question's hits are turned into, in one aggregation."""
    entry = F.struct(F.col("position"), _chunk().alias("chunk"), _entry().alias("e"), text.judge_entry(F.col("position"), F.col("structured_text")).alias("j"))
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("r"), F.count("*").alias("n_hits"))
    return rows.select(
        "qid", F.transform("r", lambda x: x["chunk"]).alias("source_chunks"), "n_hits",
        F.array_join(F.transform("r", lambda x: x["e"]), text.CONTEXT_SEPARATOR).alias("context"),
        F.array_join(F.transform("r", lambda x: x["j"]), "\n\n").alias("sources"),
    )


def with_hit_counts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """questions with n_hits, zeros included."""
    return questions.join(hits.groupBy("qid").agg(F.count("*").alias("n_hits")), "qid", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
