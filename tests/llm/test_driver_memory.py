"""What the component search and near-duplicates ask of the driver: few jobs, and no broadcast of what grows with the rows."""

from pyspark.sql import functions as F

from tidewright.llm import _graph, _skew


def jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_labels_without_further_links_stay_without_a_search(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, component long")
    links = spark.createDataFrame([], "a long, b long")
    before = jobs(spark)
    got = {r["node"]: r["component"] for r in _graph.merged(labels, links).collect()}
    assert got == {1: 1, 2: 1, 5: 5, 6: 5}
    assert jobs(spark) - before <= 6


def test_settled_takes_stars_alone(spark):
    for links, settled in (
        ([], True),
        ([(2, 1), (3, 1), (6, 5)], True),
        ([(2, 1), (3, 1), (3, 2)], False),  # two links
        ([(2, 1), (3, 2)], False),  # a path
    ):
        edges = spark.createDataFrame(links, "a long, b long")
        before = jobs(spark)
        assert _graph._settled(edges) == settled
        assert jobs(spark) - before <= 3


def test_only_hot_keys_are_broadcast(spark):
    many = spark.createDataFrame([(k % 3, k) for k in range(300)], "k long, v long")
    one = many.groupBy("k").agg(F.min("v").alias("least"), F.count("*").alias("n"))
    joined = _skew.spread_join(many, one, ["k"], "n", ["v"])
    assert {(r["k"], r["least"], r["v"]) for r in joined.collect()} == {(k % 3, k % 3, k) for k in range(300)}
    ran = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in ran
