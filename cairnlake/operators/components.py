"""Connected components by alternating star contraction.

Each round joins edges with a grouped minimum (partial aggregation runs before the shuffle), so a node with very many
neighbours costs one row per neighbour and never a list of them; nodes with more than a thousandth of all edges are joined
by broadcast, see skew. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.skew import heavy_keys, join_by_key
from cairnlake.plans.checkpoints import cut


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges as (u > v), without loops or repeats."""
    return (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give an empty frame. What reaches the driver is one
    count and one checksum per round, which decide whether to go on, and fewer than a thousand nodes.
    """
    e = cut(_ordered(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")))
    before, settled = _signature(e), False
    while before[0] and not settled:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        heavy = heavy_keys(degrees, "u", "n", 2 * before[0])  # heavy in what follows only if heavy here
        least = degrees.select("u", F.least("u", "m").alias("m"))
        large = join_by_key(both, least, "u", heavy).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_by_key(large, least, "u", heavy).select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        ).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        e = cut(_ordered(small))
        after = _signature(e)
        settled, before = after == before, after
    leaves = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return leaves.unionByName(roots)
