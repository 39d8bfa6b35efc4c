"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) for each node of edges(a, b): the smallest id it reaches.

    Labels start as the smallest neighbour. In a round each node takes the smallest label among its own, its label's
    and its neighbours'. Every join has plain tables on both sides, so Spark can split the skewed partitions of a hub;
    minima are taken before the shuffle. Each round is written to the shared folder.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "cc-labels")
    for _ in range(most_rounds):
        hop = labels.join(labels.select(F.col("id").alias("component"), F.col("component").alias("next")), "component").select("id", F.least("component", "next").alias("component"))
        hop = settle(hop, "cc-hop")
        told = both.join(hop.select(F.col("id").alias("a"), "component"), "a").select(F.col("b").alias("id"), "component")
        new = settle(hop.unionByName(told).groupBy("id").agg(F.min("component").alias("component")), "cc-labels")
        changed = new.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0] != labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        forget(hop)
        forget(labels)
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
