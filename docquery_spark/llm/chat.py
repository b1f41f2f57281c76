"""Chat formatting with cumulative-snapshot collapse. DataFrame operations only.

A log often holds a conversation several times, each time with more turns. Every turn gets a
rolling hash of all turns up to it (120 bits of SHA-256 of its place, role and text, added without
carry to the hash before it); a conversation whose last hash is a hash inside a longer conversation
is a snapshot of that one. An anti-join of last hashes against the distinct inner hashes leaves the
maximal conversations, which are then rendered. Both sides are made distinct in map-side
aggregations first, so a first turn or a conversation that a third of the log shares is one row a
task by the time it is shuffled. Hashes run along a sorted window, so a conversation's turns are
gathered, and its texts joined, only where it is rendered.

Turns are ordered by turn number (null first), then role, then text. A row repeated within a
conversation counts once. Of equal conversations the smallest conv_id stays. Nulls: a null role is
``unknown``, a null text is empty; a row without a conv_id is a conversation of one turn, equal ones
are one, and such a one stays only if no other equals it. Very long turns are kept whole. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def turn_hashes(turns: DataFrame) -> DataFrame:
    """One row a distinct turn: conv_id, own (parts rows without a conv_id), t (turn, role, text), k (1 based), n, h1, h2."""
    role, text = F.coalesce("role", F.lit(UNKNOWN)), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    rows = rows.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("t")))
    by = Window.partitionBy("conv_id", "own")
    order = by.orderBy(F.col("t.turn").asc_nulls_first(), "t.role", "t.text")
    rows = rows.withColumn("again", F.lag("t").over(order).eqNullSafe(F.col("t"))).filter(~F.col("again")).drop("again")
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(by))
    step = F.sha2(F.concat_ws("|", F.col("k").cast("string"), F.length("t.role").cast("string"), "t.role", "t.text").cast("binary"), 256)
    part = lambda at: F.conv(F.substring(step, at, 15), 16, 10).cast("long")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("h1", F.bit_xor(part(1)).over(upto)).withColumn("h2", F.bit_xor(part(16)).over(upto))


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations: conv_id, turns (ordered array of turn, role and text), n_turns, copies."""
    rows, key = turn_hashes(turns), ["k", "h1", "h2"]
    least = F.min_by(F.struct("conv_id", "own"), F.struct(F.col("conv_id").isNull(), "conv_id", "own"))
    last = rows.filter("k = n").groupBy(*key).agg(least.alias("keep"), F.count("*").alias("copies"))
    inner = rows.filter("k < n").select(*key).distinct()
    kept = last.join(inner, key, "left_anti").select(F.col("keep.conv_id").alias("keep_id"), F.col("keep.own").alias("keep_own"), "copies")
    match = F.col("conv_id").eqNullSafe(F.col("keep_id")) & F.col("own").eqNullSafe(F.col("keep_own"))
    return rows.join(kept, match).groupBy("conv_id", "own").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("turns"),
        F.count("*").alias("n_turns"), F.first("copies").alias("copies"),
    ).drop("own")


def render(talks: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Adds ``rendered``: each turn as start, role, newline, text, end, newline."""
    each = F.transform("turns", lambda t: F.concat(F.lit(start), t["role"], F.lit("\n"), t["text"], F.lit(end + "\n")))
    return talks.withColumn("rendered", F.array_join(each, ""))


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered."""
    return render(collapse(turns))
