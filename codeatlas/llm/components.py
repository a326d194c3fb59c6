"""Connected components of a thin edge table, by contraction under random priorities.

A round gives every node a priority, the hash of the node and the round's number. A node's label is the one with the
least priority among all that are at most two edges away; each edge becomes the edge between its ends' labels, and
loops and repeats go. Stars vanish at once, whatever their centre. A node stays only as the least of some such
surroundings; every node that has an edge has surroundings of two nodes at least, so whatever the order of the ids or the
shape of the graph, the expected number of nodes falls by a constant factor a round (to a third on a path). So there
are O(log n) rounds. Every round's tables are written to the shared folder: neither plans nor recovery grow with the
rounds, and joins meet plain tables whose skewed keys Spark can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _priority(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), node).alias("p"), F.col(node).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the (a, b) edges; roots are the same for connected nodes. A written table."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_priority("b", turn)).alias("m"))
        near = written(least.select(F.col("a").alias("node"), F.least(_priority("a", turn), F.col("m")).alias("m")))
        # What a neighbour sees is never worse than what the node itself sees, so its neighbours' best is the least of all.
        label = both.join(near, F.col("b") == F.col("node")).groupBy("a").agg(F.min("m")["n"].alias("root"))
        label = written(label.select(F.col("a").alias("node"), "root"))
        la, lb = (label.select(F.col("node").alias(c), F.col("root").alias(f"l{c}")) for c in "ab")
        moved = edges.join(la, "a").join(lb, "b").where("la <> lb")
        edges = written(moved.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct())
        if roots is None:
            roots = label
        else:
            further = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
