"""Connected components of a graph given as pairs, without gathering it.

Large-star and small-star steps by turns (Kiveris et al., 2014): in the first each node hands its larger neighbours to
the smallest of its neighbourhood, in the second its smaller ones and itself. Chains halve with every round, in any order
of their ids, so the rounds grow with the logarithm of the longest path; a star is done at once. All steps are sums
by key with partial aggregates and joins on a key, so no neighbourhood is collected. Every round is written as a table,
from whose files the planner's sizes start anew, and the table of the round before is deleted.

Defined results: links of a node with itself and repeated links don't matter, in either direction; nodes of no other
link than with themselves don't appear; links with a null are left out; without links the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagql.llm.common import cut, forget


def components(links: DataFrame) -> DataFrame:
    """links: u and v long. Gives (id, component) for each id in a link; component is the smallest id reachable."""
    both = links.where("u <> v").select(F.greatest("u", "v").alias("child"), F.least("u", "v").alias("parent"))
    edges = cut(both.distinct())  # from the larger to the smaller node
    while True:
        ends = edges.select(F.col("child").alias("x"), F.col("parent").alias("y"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(edges.select(F.col("parent"), F.col("child"), F.lit(0), F.lit(1)))
        nodes = cut(ends.groupBy("x").agg(F.least("x", F.min("y")).alias("least"), F.sum("up").alias("up"), F.sum("down").alias("down")))
        if nodes.where("up > 1 OR (up = 1 AND down > 0)").isEmpty():  # each node is a root or hangs on one
            forget(edges)
            return nodes.select(F.col("x").alias("id"), F.col("least").alias("component"))
        # large star: the larger neighbours of x move to its least; those of a root stay
        moved = nodes.where("down > 0").select("x", "least").join(edges.select(F.col("parent").alias("x"), "child"), "x")
        moved = cut(moved.select("child", F.col("least").alias("parent")).distinct())
        # small star: so do the smaller ones, and x itself
        least = moved.groupBy("child").agg(F.min("parent").alias("least"))
        rest = moved.join(least, "child").where("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        new = cut(least.select("child", F.col("least").alias("parent")).union(rest).distinct())
        forget(edges, nodes, moved)
        edges = new
