"""Connected components of a distributed edge list by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_small


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the component of every node that has an edge; ``edges`` has u and v.

    Each level maps every node to the least of its neighbours and itself, and goes on with the edges between the
    images, which keep all that was connected connected. Stars vanish in one level, chains in about the logarithm of
    their length. The levels' maps, applied one after another, give the component. Nodes with many edges are
    aggregated with partial minima; nothing reaches the driver but whether edges are left.
    """
    edges = edges.where(F.col("u") != F.col("v")).select("u", "v")
    levels: list[DataFrame] = []
    while True:
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = checkpoint(ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
        levels.append(least)
        moved = join_small(edges, least.select("u", F.col("m").alias("a")), ["u"])
        moved = join_small(moved, least.select(F.col("u").alias("v"), F.col("m").alias("b")), ["v"])
        edges = checkpoint(moved.where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        if not edges.count():
            break
    label = levels.pop().select(F.col("u").alias("node"), F.col("m").alias("component"))
    while levels:
        above = label.select(F.col("node").alias("m"), "component")
        label = levels.pop().join(above, "m", "left").select(F.col("u").alias("node"), F.coalesce("component", "m").alias("component"))
    return label
