"""Connected components of links, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged
from ._skew import spread_join


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node of links (a, b), two longs.

    Each round links every node's larger neighbours to its smallest one, then every node to its smallest
    neighbour only; both keep components whole and shrink paths, so rounds grow with the logarithm of the
    longest path. It ends when every node has one link, to a node without any: those are the smallest of their
    components. Nodes without links are not in the result.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for k in range(most_rounds):
        if _settled(edges):
            break
        large = _star(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), only_larger=True)
        edges = staged(_star(large, only_larger=False).distinct(), f"stars-{k}")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select("b", "b").distinct().toDF("node", "component"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component of the links that labels (node, component) come from and of further links (a, b) together.

    Further links are taken as links of components, so that of any number between the same two one is left. Without
    any, labels come back as they are. What is joined here grows with the nodes, so it is merged, not broadcast.
    """
    between = staged(links.select("a", "b"), "further")
    if between.isEmpty():
        return labels.select("node", "component")
    for side, other in (("a", "b"), ("b", "a")):
        ends = between.groupBy(side).agg(F.count("*").alias("n"))
        of = ends.join(labels.hint("merge"), F.col(side) == F.col("node"), "left").select(side, F.coalesce("component", side).alias("_to"), "n")
        between = staged(spread_join(between, of, [side], "n", [other]).select(F.col("_to").alias(side), other).distinct(), f"between-{side}")
    found = staged(components(between), "found")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    to = sizes.join(found.select("node", F.col("component").alias("_to")).hint("merge"), F.col("component") == F.col("node"), "left").select("component", F.coalesce("_to", "component").alias("_to"), "n")
    old = spread_join(labels, to, ["component"], "n", ["node"]).select("node", F.col("_to").alias("component"))
    return old.unionByName(found.join(labels.select("node").hint("merge"), "node", "left_anti").select("node", "component"))


def _settled(edges: DataFrame) -> bool:
    """Whether links (larger, smaller) are stars: one link a node, and none from a node that another links to."""
    ends = edges.select("a", F.lit(1).alias("links"), F.lit(0).alias("root")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("a").agg(F.sum("links").alias("links"), F.max("root").alias("root"))
    return nodes.agg(F.count_if(F.col("links") + F.col("root") > 1)).first()[0] == 0


def _star(pairs: DataFrame, only_larger: bool) -> DataFrame:
    """Neighbours of a (and a itself) to a's smallest neighbour; only_larger: those above a alone.

    A hub's neighbours are dealt to many tasks, each with a copy of the hub's smallest neighbour.
    """
    least = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    joined = spread_join(pairs, least, ["a"], "n", ["b"])
    if only_larger:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b")
