"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Every document is a packet of its source's queue, in a seeded random order. Its virtual finish
time is the source's words up to its end, divided by the source's target, so that all queues
reach time 1 together. A source is queued ``max_repeats`` times over. A document that is in service
at time 1 is two packets, one that ends there and the rest. The packets of all sources are sorted by
finish time, and the stream is cut at the total budget: a packet is taken as far as the words before
it in the stream leave room.

Running sums are taken in two levels (within small buckets of the random order, or of the finish
time, then over the bucket sums), so a source with a third of all rows is spread over many tasks, and
so is the sort of the stream. Buckets that begin behind the cut aren't sorted.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id
is a document like any other. Repeated rows are separate documents. Ties in the random order fall
to the smaller doc_id. An empty table gives an empty result. Columns besides the three named are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import checkpoint, free_name, quoted, running_offsets, sized

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
WORDS = r"[^\x20\x09-\x0D]+"
ROWS_A_BUCKET = 256
#: Most buckets that one source's running sum, or the stream's, is split into.
MAX_BUCKETS = 1 << 16


def _buckets(rows: int) -> int:
    """A power of two, 2 at least."""
    return 1 << max(1, min(MAX_BUCKETS, -(-rows // ROWS_A_BUCKET)) .bit_length())


def source_targets(sizes: DataFrame, share: float, max_repeats: int, weights=WEIGHTS) -> DataFrame:
    """sizes: (source, source_size), one row a source -> with weight and target.

    Targets share ``share`` of all sizes by weight, none above ``max_repeats`` times its source's
    size; the excess is dealt again by weight until none is above. Only two sums reach the driver.
    """
    spark = sizes.sparkSession
    parts = sized(spark, 0, 1)
    placed = checkpoint(
        sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    )
    offsets = running_offsets(placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "part", "n", "before")
    w = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    ranked = placed.join(offsets.drop("all"), "part").withColumn("rank", F.col("before") + F.row_number().over(w) - 1)
    pattern = F.array(*[F.lit(float(x)) for x in weights])
    out = checkpoint(
        ranked.select(
            "source",
            "source_size",
            F.element_at(pattern, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * max_repeats).cast("double").alias("cap"),
        )
    )
    total = float(out.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        got = out.agg(
            F.sum(F.when(full, F.col("cap"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if not got["open"] or got["n"] == capped:
            break
        level, capped = (total - (got["full"] or 0.0)) / got["open"], got["n"]
    return out.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, seed: int = 7, weights=WEIGHTS) -> DataFrame:
    """docs: (doc_id, text, source) -> one row for each packet: each document in each round of its source's queue, or part of one.

    Columns: doc_id, source, text_hash, size (of the document), source_size, target, row (names a row of
    docs), round (0 based), words (of the packet), finish (virtual time), stream_start (words of the
    stream before it; null where a bucket begins behind the cut), taken (words that the cut leaves).
    """
    rows = checkpoint(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce(F.md5("text"), F.lit("")))))).alias("draw"),
            F.xxhash64("text").alias("text_hash"),
        )
    )
    by_source = checkpoint(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    most = by_source.agg(F.max("n"), F.sum("n")).first()
    buckets, n_rows = _buckets(most[0] or 0), most[1] or 0
    quota = F.floor(F.col("target") + 0.5)
    targets = source_targets(by_source.select("source", "source_size"), share, max_repeats, weights).withColumn("quota", quota)

    # the draw's first five hex digits, scaled: buckets keep the order of the draw
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 5), 16, 10).cast("long") * buckets / (1 << 20)).cast("int"))
    sums = running_offsets(
        rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), ["source"], "bucket", "words", "before"
    )
    sums = sums.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sums = sums.withColumnsRenamed({"source": "s", "bucket": "b"})
    w = Window.partitionBy("s", "b").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size", "text_hash")
    end = F.col("start") + F.col("size")
    split = (F.col("start") < F.col("quota")) & (end > F.col("quota"))
    queued = (
        rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("row", F.struct("s", "b", F.row_number().over(w).alias("n")))
        .withColumn("start", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("start", F.col("start") + F.col("round") * F.col("source_size"))
        .withColumn("end", F.explode(F.when(split, F.array("quota", end)).otherwise(F.array(end))))
        .withColumn("start", F.when(split & (F.col("end") > F.col("quota")), F.col("quota")).otherwise(F.col("start")))
        .withColumn("words", F.col("end") - F.col("start"))
        # whole words are served, so the target is its nearest whole number here
        .withColumn("finish", F.when(F.col("quota") > 0, F.col("end") / F.col("quota")).otherwise(F.lit(float("inf"))))
        .select("doc_id", "source", "size", "source_size", "target", "text_hash", "row", "round", "start", "words", "finish")
    )
    # buckets of the finish time; one more for all times beyond 1 and a bucket
    slots = _buckets(n_rows * max_repeats)
    queued = checkpoint(queued.withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(2.0)) * slots).cast("int")))
    queued = queued.withColumn("slot", F.least("slot", F.lit(slots + 1)))
    budget = targets.agg(F.sum("quota")).first()[0] or 0
    offsets = running_offsets(
        queued.groupBy("slot").agg(F.sum("words").alias("n")).withColumn("all", F.lit(0)), ["all"], "slot", "n", "before"
    ).drop("all")
    # a row a slot, MAX_BUCKETS and two at most: no shuffle by slot, as the last one may hold most rows
    placed = queued.join(F.broadcast(offsets), "slot")
    order = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "start", "round", F.col("doc_id").asc_nulls_last())
    ahead = F.col("before") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    stream = placed.filter(F.col("before") < budget).withColumn("stream_start", ahead)
    stream = stream.withColumn("taken", F.greatest(F.lit(0), F.least("words", F.lit(budget) - F.col("stream_start"))).cast("long"))
    behind = placed.filter(F.col("before") >= budget).withColumns({"stream_start": F.lit(None).cast("long"), "taken": F.lit(0).cast("long")})
    return stream.unionByName(behind).drop("slot", "before", "start")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    return (
        mix(docs, **options)
        .groupBy("row")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))
        .drop("row")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs with each row as many times as rounds have taken it, all its columns.

    A document that the cut divides counts as taken when at least half of its words are.
    """
    key, own, times, rows, copy = (free_name(docs, x) for x in ("mix_id", "mix_hash", "mix_times", "mix_rows", "mix_copy"))
    served = mix(docs, **options).groupBy("row", "round").agg(
        F.sum("taken").alias("taken"), F.first("size").alias("size"), F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("text_hash").alias("text_hash")
    )
    whole = (F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size"))
    counts = served.groupBy(F.col("doc_id").alias(key), F.struct(F.col("source").alias("s"), F.col("text_hash").alias("h")).alias(own)).agg(
        F.count_if(whole).alias(times), F.count_if(F.col("round") == 0).alias(rows)
    ).filter(F.col(times) > 0)
    match = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(f"{own}.s")) & (F.xxhash64("text") == F.col(f"{own}.h"))
    joined = docs.join(counts, match)
    # of rows that repeat one stands for all
    one = joined.filter(F.col(rows) == 1).unionByName(joined.filter(F.col(rows) > 1).dropDuplicates([key, own]))
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(quoted(c)) for c in docs.columns])
