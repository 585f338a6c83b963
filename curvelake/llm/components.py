"""Connected components of a graph of links, by shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): component is the smallest node reached.

    Alternates large-star and small-star steps until nothing changes: every step keeps at most as many
    edges as it got and takes each node's minimum with a pre-aggregated shuffle, so a node with a third
    of all links is an aggregate and a join side that adaptive execution splits, never one task's list.
    Links with a null end are none, nor are those of a node to itself; repeated links count once; without links
    there are no rows.  Rounds grow with the logarithm of the graph's size; each is a written table.
    """
    step, before = 0, ""
    current = scratch.write(f"{name}-0", edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    tally = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long"))).first())
    last = tally(current)
    while True:
        step += 1
        # large star: every larger neighbour of a node is linked to the smallest of its neighbourhood
        both = current.select(F.col("hi").alias("n"), F.col("lo").alias("v")).unionAll(current.select(F.col("lo").alias("n"), F.col("hi").alias("v")))
        least = both.groupBy("n").agg(F.least(F.min("v"), F.first("n")).alias("m"))
        large = both.join(least, "n").where("v > n and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: every smaller neighbour, and the node, are linked to the smallest one
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionAll(small.select("hi", F.col("m").alias("lo"))).distinct()
        current = scratch.write(f"{name}-{step}", joined)
        now = tally(current)
        scratch.drop(f"{name}-{step - 1}")
        if now == last:
            break
        last = now
    labels = current.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    return labels.unionAll(current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
