"""What learned and drawn results are worth: rules on labels that they have not seen, words and documents of a mix."""

from pyspark.sql import functions as F

from tidewright.llm import mixing, quality_rules
from tidewright.llm._labels import remainder
from tidewright.llm._shared import table


def test_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    judged = quality_rules.op7_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").where((remainder("doc_id") == 0) & ~F.col("base_failed"))
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.15 * n[0, False] and n.get((1, False), 0) <= 0.02 * n[1, True]


def test_a_mix_meets_words_and_documents(spark):
    """Both totals of a source, which drawing each document by itself would miss by hundreds of words."""
    drawn = mixing.mix(table(spark, "/root/testdata/sf0.01", "documents")).withColumn("share", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    by = drawn.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum(F.when(F.col("size") > 0, F.col("copies"))).alias("copies"), F.sum("share").alias("documents"))
    assert all(abs(r["taken"] - r["target"]) <= 25 and abs(r["copies"] - r["documents"]) <= 8 for r in by.collect())
