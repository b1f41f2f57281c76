"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregation of a node's least neighbour and a join of it back to the node's edges,
dealt over salts, so a node with a third of all edges is spread. Only two numbers of a round reach
the driver: how many edges there are and their checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._frames import Scratch, by_salted_key, salt_bits, salt_of, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and all its v."""
    rows = edges.withColumn("salt", salt_of("v"))
    least = rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), salt_bits(F.col("salt")).alias("bits"))
    return by_salted_key(rows, least, ["u"], "bits")


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs, in any direction and number -> (node, component), the least node of each.

    Nodes without an edge to another node aren't listed. The result is a written table.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.written(
            edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        )
        state = None
        while True:
            ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
            both = now.select(ways.alias("e")).select("e.u", "e.v")
            large = scratch.written(_least(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            # u's neighbours and u itself all point to m
            ends = F.explode(F.array("v", "u")).alias("w")
            small = _least(large).select(ends, "m").filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
            # seen while they are written, by the tasks that write, so that no other query asks for it
            seen = Observation()
            edge = F.xxhash64("u", "v").cast("decimal(38,0)")
            before, now = now, scratch.written(small.distinct().observe(seen, F.count("*").alias("n"), F.sum(edge).alias("sum")))
            scratch.drop(before, large)
            if seen.get == state:
                break
            state = seen.get
        ends = F.explode(F.array("u", "v")).alias("node")
        return written(now.select(ends, F.col("v").alias("component")).distinct())
