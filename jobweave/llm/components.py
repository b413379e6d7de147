"""Distributed union-find: connected components by alternating large and small stars.

A round first links, at each node, all larger neighbours to the smallest node
about it (large star), then all smaller neighbours to the smallest of them
(small star); the edges then form stars about the smallest node of each
component, after a number of rounds that grows with the logarithm of the size.
Whether they do shows in the nodes' smallest and largest neighbours, which the
large star needs anyway.  Hubs are never gathered: a node's smallest neighbour is
a pre-aggregated minimum, written, then joined back to its edges, so that
adaptive execution can split that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for each node that has an edge to another; component is its smallest node.

    edges: columns a and b of one ordered type; nulls, loops and repeats don't
    matter, direction neither.  Rounds end when the edges form stars, since they
    keep what is connected.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = checkpoint(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below")))
        if ends.where("m < u and (top > u or m <> below)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        large = both.join(ends.select("u", F.least("u", "m").alias("m")), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(large)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = checkpoint(small.distinct())
    raise RuntimeError(f"no stable components after {rounds} rounds")
