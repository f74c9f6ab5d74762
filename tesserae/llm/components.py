"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import checkpointed


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs, in any direction; returns (node, root) for each node that has an edge to another, root the least node of its component, itself left out.

    Each step writes its edges to the shared folder. A step makes at most as many rows as twice its edges; the minimum of a
    node's neighbours is pre-aggregated before it is shuffled. Self loops and repeats are ignored; null ends are dropped.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _signature(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        if (now := _signature(e)) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
