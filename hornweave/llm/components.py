"""Connected components of an edge table: alternating large-star and small-star steps.

Nodes are 64-bit integers; the component of a node is the smallest node it reaches. All
steps are joins and aggregations; nothing but two numbers for each round is collected.
Every node with an edge is in the result, others are not. An empty table gives none. The
least node of a large component is a hot key of the joins; their other side has one row
for a node, so adaptive execution splits the hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (large star) or the not larger (small star) neighbours of every node to the least node around it."""
    a, b = F.col("a"), F.col("b")
    if large:
        around = edges.select("a", "b").unionAll(edges.select(b.alias("a"), a.alias("b")))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        return around.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b")
    around = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    rows = around.join(least, "a")
    return rows.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b)."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sign(edges)
    while before[0]:
        older, edges = edges, written(_star(_star(edges, True).distinct(), False).distinct(), "cc")
        discard(older)
        after = sign(edges)
        if after == before:
            break
        before = after
    # now every edge leads from a component's least node to another of its nodes
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
