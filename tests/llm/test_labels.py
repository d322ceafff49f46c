"""Bounded samples of labelled rows."""

from pyspark.sql import functions as F

from tidewright.llm import _labels


def test_one_id_on_many_rows_is_bounded(spark):
    docs = spark.range(200_000).selectExpr("1L as doc_id", "concat('text ', id % 900) as text").unionAll(spark.range(2, 40).selectExpr("id as doc_id", "concat('other ', id) as text"))
    labels = spark.range(0, 40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = _labels.sample(docs, labels, 500)
    assert got.count() == 500 and got.select("doc_id", "text").distinct().count() == min(500, got.where("doc_id <> 1").count() + got.where("doc_id = 1").select("text").distinct().count())
    rows = [sorted(map(repr, _labels.sample(docs.repartition(n), labels, 500).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]
    assert _labels.sample(docs, labels, 0).collect() == [] and _labels.sample(docs.limit(0), labels, 10).collect() == []


def test_every_row_counts_below_the_bound(spark, odd_docs, odd_labels):
    got = _labels.sample(odd_docs, odd_labels, 1000)
    want = odd_docs.where(F.col("doc_id").isNotNull() & (_labels.remainder("doc_id") != 0) & (F.col("doc_id") != 3)).select("doc_id", "text")
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(map(repr, want.collect()))
