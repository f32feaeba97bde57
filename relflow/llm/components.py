"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation, whose minima combine before the shuffle, and a join on slim edge
rows, never a collected neighbour list; a hub's edges do not meet in one task, as the minima of
hubs are broadcast (see ``join_skewed``).  Every step is cut to a written table; the loop ends when
a whole round leaves the edge set as it was, and fails where ``rounds`` of them do not get there
(they normally take a few), as the classes were then not whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, join_skewed


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: (a, b) with a > b.  One star step; returns the same form, without repeats."""
    if large:  # every larger neighbour of a node goes to the node's smallest neighbour (or the node)
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))
        low = both.groupBy("n").agg(F.least("n", F.min("v")).alias("m"), F.count(F.lit(1)).alias("w"))
        out = join_skewed(both.filter("v > n"), low, ["n"], "w", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # every smaller neighbour of a node, and the node, goes to the smallest one
        low = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w"))
        near = edges.select(F.col("a").alias("n"), F.col("b").alias("v"))
        out = join_skewed(near, low, ["n"], "w", total).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """An order-free digest of the edge set, its number of edges first."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a, b) of one ordered type -> (node, root) for every node with an edge; root is the least node."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        half = cut(_star(now, True, mark[0]), "edges")
        new = cut(_star(half, False, mark[0]), "edges")
        drop(now)
        drop(half)
        now, seen = new, _mark(new)
        if seen == mark:  # the round changed nothing
            break
        mark = seen
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
