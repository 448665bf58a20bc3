"""Connected components by alternating large and small stars, over edges of integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    return both.filter("b > a").join(least, "a").select("b", "m").toDF("a", "b")


def _small(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and itself, point to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select("b", "m")
    return moved.toDF("a", "b").union(least.toDF("a", "b"))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) that are linked to a smaller one: the least that they reach.

    Both star operations keep what is connected; when a round changes nothing, each node points to its component.
    Self-links and repeated edges don't matter; nulls are left out. No node's neighbours are gathered in one place:
    minima are pre-aggregated, and cut off where centres of stars meet their points, so that such a centre is a join key
    whose partition Spark can split. The number of rounds
    grows with the logarithm of the nodes.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    for _ in range(limit):
        edges = cut(_small(_large(edges)).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.toDF("node", "component")
        mark = now
    raise RuntimeError(f"components did not settle in {limit} rounds")


def named_components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component_id): the least `first` of the node's component. nodes: (node, first); found: components().

    Most components are single nodes, which need no join. The others' least names are cut off before they meet their
    nodes, so that a large component is a join key whose partition Spark can split.
    """
    labelled = cut(nodes.select("node", "first").join(found, "node", "left").select("node", "first", "component"))
    roots = cut(found.select(F.col("component").alias("node")).distinct())
    member = labelled.filter("component IS NOT NULL").unionByName(labelled.filter("component IS NULL").join(roots, "node", "left_semi").select("node", "first", F.col("node").alias("component")))
    least = cut(member.groupBy("component").agg(F.min("first").alias("component_id")))
    alone = labelled.filter("component IS NULL").join(roots, "node", "left_anti").select("node", F.col("first").alias("component_id"))
    return alone.unionByName(member.join(least, "component").select("node", "component_id"))
