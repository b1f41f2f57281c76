"""Sharding by vector bin packing.

Groups of equal texts are packed whole, weighed by (bytes, tokens, rows). A group above
``1 / CELLS`` of any total is heavy and is packed by itself; there can be no more than three times
CELLS of those. Only one above ``WHOLE`` of a shard's fair share is cut, into pieces of ``1 / CELLS``
of a total or single rows. Lighter groups share one of CELLS cells by
their hash, and a cell is packed as one group would be: what a dot product decides is thus never more
than CELLS / shards times finer than a shard's fair share, and the driver packs a number of vectors
that does not grow with the data. In falling order, each goes to the shard where the dot product of
its vector with the residual capacities is highest. A last pass moves pieces from the shard with
most bytes to the one with least, where that evens out bytes and leaves no shard with more tokens or
rows than the fullest had, or ``SLACK`` above the fair share.

Slots number a shard's rows without gaps: counts of small (shard, lane) lanes are summed up, and
rows are numbered within their lane, so no task has a shard's rows all together.

Nulls: a null text has no bytes, no tokens and its own group; a null doc_id is a document like any
other. Repeated rows are separate rows of the shard. Ties in a lane fall to the smaller doc_id.
An empty table gives an empty result. Other columns are kept, whatever their names, unless they bear
the name of an output column, which then replaces them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import checkpoint, quoted, running_offsets

CELLS = 8192
#: A group of equal texts up to this part of a shard's fair share is never cut.
WHOLE = 0.5
#: Tokens and rows above the fair share that evening out bytes may bring.
SLACK = 0.2
ROWS_A_LANE = 4096
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows that a size counts for besides its bytes.
ROW_BYTES = 8
ADDED = ("size", "text_crc32", "shard", "slot")


def pack(vectors: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each vector: falling order, highest dot product with the residual capacity.

    Columns are scaled so that a bin's fair share is 1 in each. The first column's loads are then
    evened out further by single moves from the fullest bin to the emptiest, while that gives no bin
    more of another column than the fullest has, or ``SLACK`` above the fair share.
    """
    out = np.zeros(len(vectors), dtype=np.int64)
    total = vectors.sum(axis=0)
    scaled = vectors / np.where(total > 0, total / bins, 1)
    left = np.ones((bins, vectors.shape[1]))
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        out[i] = best = int(np.argmax(left @ scaled[i]))
        left[best] -= scaled[i]
    members = [list(np.flatnonzero(out == b)) for b in range(bins)]
    floor = np.minimum(left.min(axis=0)[1:], -SLACK)
    for _ in range(20 * bins):
        full, free = int(np.argmin(left[:, 0])), int(np.argmax(left[:, 0]))
        gap = left[free, 0] - left[full, 0]
        if gap < 1e-6 or not members[full]:
            break
        own = scaled[members[full]]
        room = (left[free, 1:] - own[:, 1:] >= floor - 1e-9).all(axis=1)
        fit = np.where((own[:, 0] < gap) & room, own[:, 0] * (gap - own[:, 0]), -1)
        if fit.max() <= 1e-12:
            break
        i = members[full].pop(int(fit.argmax()))
        members[free].append(i)
        left[full] += scaled[i]
        left[free] -= scaled[i]
        out[i] = free
    return out


def shard(docs: DataFrame, shards: int = 24, text: str = "text", cells: int = CELLS) -> DataFrame:
    """docs with size, text_crc32, shard (0 .. shards-1) and slot (0 .. rows of the shard - 1)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary")
    names = [c for c in docs.columns if c.lower() not in ADDED]
    kept = [F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(names)]
    rows = docs.select(
        F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]).alias("_doc"),
        "doc_id",
        (F.length(body).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("_tokens"),
        F.xxhash64(F.md5(F.coalesce(F.col(text), F.lit(""))), F.col(text).isNull()).alias("_group"),
    )
    narrow = checkpoint(rows.select("doc_id", "size", "_tokens", "_group"))
    groups = narrow.groupBy("_group").agg(
        F.sum("size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count("*").alias("n"),
    )
    total = narrow.agg(F.sum("size"), F.sum("_tokens"), F.count("*")).first()
    total = np.array([x or 0 for x in total], dtype=np.float64)
    if not total[2]:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).select(*kept, *ADDED)
    limit = total / cells
    share = F.greatest(*[F.col(c) / float(max(x, 1e-9)) for c, x in zip(("bytes", "tokens", "n"), limit, strict=True)])
    # at most 3 * cells groups can be above the limit in one of three sums
    pieces = checkpoint(
        groups.withColumn("share", share).filter("share > 1").select(
            "_group", F.when(F.col("share") > WHOLE * cells / shards, F.least("n", F.ceil("share"))).otherwise(1).cast("int").alias("_pieces")
        )
    )
    unit = F.when(
        F.col("_pieces").isNull(), F.struct(F.lit(0).cast("long").alias("g"), F.pmod("_group", F.lit(cells)).cast("int").alias("k"))
    ).otherwise(F.struct(F.col("_group").alias("g"), F.pmod(F.xxhash64("doc_id"), F.col("_pieces")).cast("int").alias("k")))
    light = F.col("_pieces").isNull()
    units = (
        narrow.join(F.broadcast(pieces), "_group", "left")
        .groupBy(light.alias("light"), unit.alias("unit"))
        .agg(F.sum("size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count("*").alias("n"))
        .collect()
    )
    units.sort(key=lambda r: (r["light"], r["unit"]["g"], r["unit"]["k"]))
    bins = pack(np.array([[r["bytes"], r["tokens"], r["n"]] for r in units], dtype=np.float64), shards)
    places = spark.createDataFrame(
        [(r["light"], r["unit"]["g"], r["unit"]["k"], int(b)) for r, b in zip(units, bins, strict=True)],
        "_light boolean, _g long, _k int, shard int",
    )
    placed = (
        rows.join(F.broadcast(pieces), "_group", "left")
        .withColumn("_light", light)
        .withColumn("_unit", unit)
        .withColumns({"_g": F.col("_unit.g"), "_k": F.col("_unit.k")})
        .join(F.broadcast(places), ["_light", "_g", "_k"])
    )
    return number(placed, int(total[2]), shards).select(*kept, *ADDED)


def number(placed: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Adds slot to rows with doc_id, text_crc32, size and shard."""
    lanes = max(1, -(-n_rows // (ROWS_A_LANE * shards))) * 2
    laned = placed.withColumn("_lane", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(1)), F.lit(lanes)).cast("int"))
    offsets = running_offsets(laned.groupBy("shard", "_lane").agg(F.count("*").alias("n")), ["shard"], "_lane", "n", "_before")
    w = Window.partitionBy("shard", "_lane").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return laned.join(offsets, ["shard", "_lane"]).withColumn("slot", F.col("_before") + F.row_number().over(w) - 1)
