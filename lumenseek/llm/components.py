"""Connected components of a graph held in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.llm.scratch import discard, stored

MAX_ROUNDS = 60
#: Edges up to which the minima of all nodes are broadcast (16 bytes a node); beyond, joins are shuffled and Spark splits
#: the nodes that hold many edges.
BROADCAST_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable), for every node of edges (a, b); nodes without edges are not there.

    Null ends and loops are ignored. Each round links every node to the smallest node it sees and is written to the shared
    folder in place of the round before; rounds grow with the logarithm of the longest path. Minima are combined before
    the shuffle, so a node with many edges costs no more than its edges."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        sums = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
        sized = F.broadcast if sums[0] <= BROADCAST_EDGES else lambda df: df
        # large star: neighbours larger than a node go to the smallest that it sees
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(sized(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours that are smaller, and the node itself, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sized(least), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before, pairs = pairs, stored(small.where("a <> b").distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
