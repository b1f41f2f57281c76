"""Exact dedup on a 128-bit content hash, with a byte comparison inside hash groups.

Texts are grouped by (128-bit hash, bytes): the hash spreads the groups, and the aggregation
compares the bytes of its keys, so two texts under one hash stay two groups. Copies meet in the
map-side aggregation first, so a group with a third of all rows leaves each task as one row. The
decision goes back to the documents over (hash, SHA-256), dealt over salts; should two texts ever
share both, the documents of these go through a join on their bytes instead.

Nulls: a null text counts as empty; a null doc_id is smaller than any other, so with ``keep="max"`` it
stays only when its group has no other id (with ``"min"``, too). Repeated rows are documents each: they
count in the group's size and get a row each. Rows that share id and text stay or go together in
:func:`groups`; :func:`survivors` leaves any one of them. An empty table gives an empty result.
Columns besides doc_id and text are ignored by :func:`groups` and kept by :func:`survivors`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import by_salted_key, checkpoint, free_name, lower_az, quoted, salt_bits, salt_of

KEYS = ["hash128", "text_sha256"]


def _norm(fold_case: bool) -> Column:
    norm = F.coalesce(F.col("text"), F.lit(""))
    return (lower_az(norm) if fold_case else norm).cast("binary")


def _hash128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def groups(docs: DataFrame, keep: str = "min", fold_case: bool = True) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: ``"min"`` keeps the smallest doc_id of each group of equal texts, ``"max"`` the largest.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    norm = _norm(fold_case)
    hashed = docs.select("doc_id", norm.alias("norm"), _hash128(norm).alias("hash128"), salt_of(F.col("doc_id")).alias("salt"))
    best = F.min("doc_id") if keep == "min" else F.max("doc_id")
    decided = hashed.groupBy("hash128", "norm").agg(
        best.alias("keep_id"), F.count("*").alias("group_size"), salt_bits(F.col("salt")).alias("bits")
    )
    figures = ["keep_id", "group_size", "bits"]
    narrow = checkpoint(decided.select("hash128", _sha256(F.col("norm")).alias("text_sha256"), *figures))
    # rows that repeat are one until the decision is there, then as many as before
    rows = hashed.select("doc_id", "hash128", _sha256(F.col("norm")).alias("text_sha256"), "salt")
    rows = rows.groupBy("doc_id", *KEYS, "salt").agg(F.count("*").cast("int").alias("times"))
    clash = narrow.groupBy(*KEYS).agg(F.count("*").alias("texts")).filter("texts > 1").select(*KEYS)
    if clash.isEmpty():
        done = by_salted_key(rows, narrow, KEYS, "bits")
    else:
        clash = checkpoint(clash)
        plain = by_salted_key(rows.join(clash, KEYS, "left_anti"), narrow.join(clash, KEYS, "left_anti"), KEYS, "bits")
        of = hashed.withColumn("text_sha256", _sha256(F.col("norm"))).join(clash, KEYS, "left_semi").withColumn("times", F.lit(1))
        by_bytes = by_salted_key(of, decided, ["hash128", "norm"], "bits").drop("norm")
        done = plain.unionByName(by_bytes.select(*plain.columns))
    return done.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def survivors(docs: DataFrame, keep: str = "min", fold_case: bool = True) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text any one."""
    own, key, sha = (free_name(docs, x) for x in ("own_sha", "stays", "stays_sha"))
    kept = groups(docs, keep, fold_case).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct()
    marked = docs.withColumn(own, _sha256(_norm(fold_case)))
    match = (F.col(own) == F.col(sha)) & F.col("doc_id").eqNullSafe(F.col(key))
    return marked.join(kept, match, "left_semi").dropDuplicates(["doc_id", own]).select(*[F.col(quoted(c)) for c in docs.columns])
