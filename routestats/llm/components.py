"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.session import materialize


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """The smallest of each ``u`` and its neighbours; combined before the shuffle, so a hub is one row per task.

    Written, so that the join of a hub's edges to it has a plain shuffle on both sides, which can be split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return materialize(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long) but the roots, root being the smallest node reachable.

    Self-loops, repeated edges and rows with a null end count for nothing; no edges give no rows. Each round is
    written to the shared folder; the driver only sees a count and a checksum of the edges. A node with very many
    neighbours is reduced by partial aggregation and its join is split by adaptive execution.
    """
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        large = materialize(_large_star(current).distinct(), "large-star")
        current = materialize(_small_star(large).distinct(), "small-star")
