"""Texts that no pair asks for are left out before the shuffle."""

from pyspark.sql import functions as F

from tidewright.llm import minhash_dedup


def test_texts_nobody_asks_for_are_left_out_where_they_are_read(spark):
    texts = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text_hash"))
    ends = texts.where("doc_id % 40 = 0")
    out = minhash_dedup.marked(texts, ends)
    got = {r[0] for r in out.select("doc_id").collect()}
    assert {i for i in range(20_000) if i % 40 == 0} <= got and len(got) < 600 and out.columns == texts.columns
    assert minhash_dedup.marked(texts, ends.limit(0)).collect() == []


def test_the_pipeline_shuffles_only_marked_texts(spark, monkeypatch):
    seen = []
    kept = minhash_dedup.with_brief
    monkeypatch.setattr(minhash_dedup, "with_brief", lambda texts, width: seen.append(texts._jdf.queryExecution().optimizedPlan().toString()) or kept(texts, width))
    docs = spark.createDataFrame([(k, f"one two three four five six seven eight nine ten eleven {'twelve' if k < 2 else k} {k} x" * 2) for k in range(30)], "doc_id long, text string")
    minhash_dedup.near_duplicates(docs).collect()
    assert len(seen) == 1 and "_bits" in seen[0]
