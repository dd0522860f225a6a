"""Connected components of a graph given as a frame of edges, by contraction; nothing is collected.

In a round every node takes the neighbour of lowest random priority (or itself) as its parent, and edges are carried over to the
parents. The graph shrinks by a constant factor on average, also where nodes form a chain or a star. The maps of the rounds are then
followed from the last to the first. Minima are combined before the shuffle, so a hub with many edges is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from briefloom.llm.common import stored


def _ranked(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("rank"), F.col(node).alias("node"))


def connected(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root): a row per node with an edge to another; nodes of one component have the same root, one of them.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    e = stored(edges.select("a", "b").filter("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min(_ranked("b")).alias("low"))
        parents = stored(lowest.select(F.col("a").alias("node"), F.least("low", _ranked("a"))["node"].alias("parent")))
        rounds.append(parents)
        left = e.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        ends = left.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        e = stored(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct())
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("parent").alias("root"))
    for parents in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("parent"), "root")
        roots = parents.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots


def local_roots(linked, labels):
    """Smallest label reachable in a dense symmetric matrix of links (numpy): labels is an array of distinct whole numbers."""
    import numpy as np

    linked = linked | np.eye(len(linked), dtype=bool)
    high = labels.max(initial=0) + 1
    while True:
        new = np.where(linked, labels[None, :], high).min(1) if len(labels) else labels
        new = new[new]  # jump
        if (new == labels).all():
            return new
        labels = new
