"""Connected components of an edge table by alternating large-star and small-star passes.

Each pass is a partially aggregated minimum per node and a join back on the node; no adjacency list is ever
gathered, so a hub costs its edges and nothing more (the join on a hub is split by adaptive skew handling).
The number of passes grows with the logarithm of the longest path.  Every pass is written to the shared scratch
folder, so a lost executor repeats one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star pass.  ``edges`` has each undirected edge once as (hi, lo) with hi > lo.  Large star: every node
    links its larger neighbours to the smallest node of its closed neighbourhood.  Small star: every node links
    its smaller neighbours and itself to the smallest of them."""
    if large:
        sides = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo"), F.col("hi")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = sides.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        sides = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m"))
        out = sides.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        out = out.union(least.select(F.col("u"), F.col("m")))
    return out.where("hi > lo").distinct()


def _signature(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set: equal sets have equal signatures."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("hi", "lo")).alias("x"),
        F.sum(F.shiftrightunsigned(F.xxhash64("lo", "hi"), 24)).alias("s"),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge; ``component`` is the smallest node of its component.

    Self loops, repeated edges, edges in both directions and an empty table are fine (the last gives no rows); an
    edge with a null end is dropped.
    """
    e = materialise(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
                    .select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
    before = _signature(e)
    while before[0]:
        e = materialise(_star(_star(e, large=True), large=False), "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
