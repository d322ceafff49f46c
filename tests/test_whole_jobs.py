"""Jobs that must not stop before their end: long chains, deep trees, whole tables."""

from tidewright.operators import state
from tidewright.plans import dag
from tidewright.sources.tables import load


def depths(edges, start):
    after, seen, front = {}, {start: 0}, [start]
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while front:
        front = [y for x in front for y in after.get(x, ()) if seen.setdefault(y, seen[x] + 1) == seen[x] + 1 and y != x]
        front = list(dict.fromkeys(front))
    return seen


def test_reachable_goes_to_the_end_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(20, 1), (5, 5), (3, 9), (90, 91), (2, None), (15, None)]
    got = dag.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(1,)], "node long"))
    assert sorted((r["node"], r["depth"]) for r in got.collect() if r["node"]) == sorted((n, d) for n, d in depths(edges, 1).items() if n)
    assert [r["depth"] for r in got.where("node is null").collect()] == [2]


def test_reachable_over_all_order_lines(spark):
    edges = load(spark, "/root/testdata/sf0.01", "lineitem").selectExpr("l_partkey as src", "l_suppkey as dst").distinct()
    got = dag.reachable(edges, spark.createDataFrame([(1,)], "node long"))
    assert {r["node"]: r["depth"] for r in got.collect()} == depths([tuple(r) for r in edges.collect()], 1)


def test_span_tree_below_a_hundred_levels(spark):
    n = 104
    spans = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, n + 1)] + [(500, 499)], "span_id long, parent_span_id long")
    got = {r["span_id"]: (r["root_id"], r["depth"]) for r in state.span_tree(spans).collect()}
    assert got == {i: (1, i - 1) for i in range(1, n + 1)} | {500: (500, 0)}
