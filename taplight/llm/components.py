"""Connected components of an edge list by alternating star contraction, in DataFrames.

A large-star step links every larger neighbour of a node to the node's smallest neighbour,
a small-star step does so for the smaller ones. Both are a grouped minimum, which combines
map-side, and an equi-join on the node. The minima are written before the join, so that both
of its sides are plain shuffles, which skew-join handling can split; no neighbour list is
ever gathered. Edges end as stars around each component's smallest node after a
number of rounds that grows with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges`` has ``u > v``; the result has too, without repeats."""
    if larger:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("k"), F.least("m", "u").alias("m")), "least")
    joined = both.join(least, both["u"] == least["k"])
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for each node that has an edge; root is the component's smallest node.

    Self-loops, repeated edges and edges with a null end add nothing; an empty edge list
    gives no rows.
    """
    current = written(edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    mark = None
    while True:
        stamp = current.agg(F.count("*"), F.sum(
            F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stamp[0] == 0 or tuple(stamp) == mark:
            break
        mark = tuple(stamp)
        current = written(_star(_star(current, True), False), "edges")
    roots = current.groupBy("v").agg(F.lit(1)).select(
        F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
