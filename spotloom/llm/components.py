"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm.frames import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of the nodes of edges (a, b), where component is the smallest id reachable.

    Each round links every node to the smallest node it knows of around it, first among its larger neighbours, then
    among its smaller ones, so that paths halve and the number of rounds follows the logarithm of the longest path.
    Rounds end when every node that has a smaller neighbour has one only, which has none. They are written to the shared
    folder; nothing but whether they end comes to the driver. Neighbours are reduced to one minimum a node before they
    are joined, so nodes with very many neighbours are no burden to a single task.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = scratch.keep(links, f"{name}-0")
    step = 0
    while not _settled(links):
        step += 1
        # Larger neighbours go to the smallest of a node's neighbours and itself.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large, f"{name}-large-{step}")
        # Then each node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least.hint("merge"), F.col("u") == F.col("n"))
        small = small.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in ("u", "v")])).alias("x"))
        links = scratch.keep(small.select("x.u", "x.v").where("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-large-{step}")
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _settled(links: DataFrame) -> bool:
    """Whether distinct links (u, v), v the smaller, are stars around nodes that have no smaller neighbour."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()
