"""Connected components of a graph that is too large for one task, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Rounds double the distance over which labels travel; more than this many nodes in a path do not occur.
ROUNDS = 40


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Each round hangs the larger neighbours of a node below its smallest one (large star), then the node
    and its smaller neighbours below the smallest (small star), until all hang below roots. What a node
    needs is the minimum over its neighbours, an aggregate that is combined before the shuffle; no
    node's neighbours are collected. Edges with a null end are left out.
    """
    current = scratch.table(f"{label}0", edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for k in range(1, ROUNDS):
        both = current.union(current.select("b", "a"))
        # Both sides of each join are tables, so that Spark can split a hub's partition.
        least = scratch.table(f"{label}least{k}", both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m")))
        large = scratch.table(f"{label}large{k}", both.join(least, F.col("a") == F.col("of")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = scratch.table(f"{label}down{k}", large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")))
        small = large.join(down, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("of", "m"))
        after = scratch.table(f"{label}{k}", small.filter("a <> b").distinct())
        scratch.drop(f"{label}{k - 1}", *(f"{label}{x}{k}" for x in ("least", "large", "down")))
        current = after
        # Rounds keep what is connected, so all is done once every node hangs below one root alone.
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionAll(current.select("b", F.lit(0)))
        if ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
