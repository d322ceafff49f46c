"""Reachability in graphs that one machine can't hold, front by front."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import load
from .shared import staged

#: Rounds after which the parts of a growing result are written as one.
WHOLE = 16


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, depth of every node reachable from starts (node) over edges (src, dst), the least depth of each.

    A front holds only nodes not seen before, so it ends on any finite graph, after as many rounds as the longest
    of the shortest paths has edges.
    """
    edges = staged(edges.select("src", "dst").where("src is not null").distinct())  # read by every round
    seen = staged(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while not front.isEmpty():
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        known = seen.select(F.col("node").alias("known"))
        front = staged(step.join(known, F.col("node").eqNullSafe(F.col("known")), "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
        if depth % WHOLE == 0:
            seen = staged(seen)
    return seen


def _edges(s, d):
    """Parts lead to their suppliers, and a supplier to the part of the same number."""
    return load(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


QUERIES = {"dag_reachability": lambda s, d: reachable(_edges(s, d), s.createDataFrame([(1,)], "node long"))}
ORACLES = {
    "dag_reachability": """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
r(node, depth) USING KEY (node) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, min(r.depth + 1) FROM r JOIN e ON e.src = r.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS known WHERE known.node = e.dst) GROUP BY e.dst)
SELECT node, depth FROM r""",
}
