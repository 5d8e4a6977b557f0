"""Connected components by alternating star contraction, in DataFrame joins.

Each round turns every node's neighbourhood towards its smallest member: the large star
relinks a node's larger neighbours, the small star its smaller ones. The number of rounds
grows with the logarithm of the longest path, and edges never multiply. Minima are
partially aggregated and joins on a hub can be split by adaptive execution, so a component
of any size passes through no single task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge to another node; the component is
    its smallest node. Self-edges and null ends are ignored."""
    a, b = F.col(src), F.col(dst)
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        now = materialize(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
