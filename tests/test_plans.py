import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions import scalars as S
from tidewright.operators import kv, metrics, queue
from tidewright.plans import documents, merge
from tidewright.plans.fold import ordered_fold
from tidewright.plans.ranks import global_rank

CASES = [
    ('{"data":[1,2]}', '{"data":[3,4]}', {"data": [1, 2, 3, 4]}), ('{"a":1}', '{"b":2}', {"a": 1, "b": 2}), ('{"a":{"x":[1],"y":1}}', '{"a":{"x":[2],"y":2}}', {"a": {"x": [1, 2], "y": 2}}), ("[1]", "[2,3]", [1, 2, 3]),
    ('{"a":1}', "[1]", [1]), ("", '{"a":1}', {"a": 1}), ('{"a":1}', "", {"a": 1}), ('{"a":[1]}', '{"a":"x"}', {"a": "x"}), ('{"a":true}', '{"a":false}', {"a": False}), ("1", "2", 2),
]


@pytest.mark.parametrize("current,results,want", CASES)
def test_merge(spark, current, results, want):
    assert json.loads(merge.merge_texts(current, results)) == want
    row = spark.createDataFrame([(current, results)], "c string, r string").select(merge.merge_json(F.col("c"), F.col("r"))).first()
    assert json.loads(row[0]) == want


def test_merge_refuses_what_is_no_json():
    for pair in (("{invalid", "{}"), ("{}", "{invalid")):
        with pytest.raises(ValueError):
            merge.merge_texts(*pair)


def test_merge_columns(spark):
    df = spark.sql("select named_struct('s', 'a', 'h', array('x')) as c, named_struct('s', cast(null as string), 'h', array('y')) as r union all select named_struct('s', 'a', 'h', null), named_struct('s', 'b', 'h', array('y'))")
    got = [tuple(r[0]) for r in df.select(merge.merge_columns("c", "r", {"s": "string", "h": "array"})).collect()]
    assert got == [("a", ["x", "y"]), ("b", ["y"])]


def test_fold_streams_a_long_key(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("key"), "id", F.lit(1).alias("n"))

    def step(s, r):
        s["sum"] += r["n"]
        return None

    out = {r["key"]: r["total"] for r in ordered_fold(rows, "key", ["id"], lambda: {"sum": 0}, step, "total long", lambda s: {"total": s["sum"]}).collect()}
    assert out["hot"] == 10_000 and sum(out.values()) == 30_000


def test_rank(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    assert [(r["k"], r["n"]) for r in global_rank(rows, ["k"], "n", 5).orderBy("k").collect()] == [(i, i + 5) for i in range(1000)]


def test_conditional_commands(spark):
    log = [(1, "a", "put", "1", None, 0), (2, "a", "put", "2", None, 2), (3, "a", "put", "3", None, 2), (4, "a", "cas", "4", "2", 0), (5, "a", "cas", "5", "2", 0), (6, "a", "cas", "6", None, 3), (7, "a", "delete", None, None, 0), (8, "a", "delete_if_exists", None, None, 0), (9, "a", "put", "9", None, 1), (10, "a", "dev", None, None, 0)]
    df = spark.createDataFrame(log, "log_index long, key string, op string, value string, expected string, version long")
    got = [(r["ok"], r["version_after"], r["value_after"]) for r in kv.apply_conditional(df).orderBy("log_index").collect()]
    assert got == [(True, 1, "1"), (True, 2, "2"), (False, 2, "2"), (True, 3, "4"), (False, 3, "4"), (True, 4, "6"), (True, 0, None), (False, 0, None), (True, 1, "9"), (False, 1, "9")]


def test_leases_at_the_instant_of_expiry(spark):
    log = [(1, "k", "acquire", "a", 0, 10), (2, "k", "acquire", "b", 9, 10), (3, "k", "acquire", "b", 10, 10), (4, "k", "renew", "a", 11, 10), (5, "k", "renew", "b", 99, 10), (6, "k", "acquire", "b", 100, 10), (7, "k", "release", "a", 101, 0), (8, "k", "force_release", "x", 102, 0), (9, "k", "release", "x", 103, 0), (10, "k", "acquire", "c", 104, 10)]
    df = spark.createDataFrame(log, "log_index long, key string, op string, owner string, ts_us long, ttl_us long")
    got = [(r["ok"], r["holder"], r["generation"]) for r in queue.leases(df).orderBy("log_index").collect()]
    assert got == [(True, "a", 1), (False, "a", 1), (True, "b", 2), (False, "b", 2), (True, "b", 2), (True, "b", 3), (False, "b", 3), (True, None, 0), (True, None, 0), (True, "c", 1)]


def test_bucket_and_breaker(spark):
    requests = spark.createDataFrame([(i, "k" if i < 4 else "other", 0, 1) for i in range(5)] + [(5, "k", 500_000, 1)], "log_index long, key string, ts_us long, n int")
    assert [r["allowed"] for r in metrics.token_bucket(requests, 2.0, 2).orderBy("log_index").collect()] == [True, True, False, False, True, True]
    s = 1_000_000
    calls = spark.createDataFrame([(1, "b", 0, False), (2, "b", 1, False), (3, "b", 2, True), (4, "b", 11 * s, False), (5, "b", 12 * s, True), (6, "b", 30 * s, True), (7, "b", 31 * s, True)], "log_index long, key string, ts_us long, ok boolean")
    got = [(r["allowed"], r["state"]) for r in metrics.breaker(calls, failures=2).orderBy("log_index").collect()]
    assert got == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


TEXTS = ["hola ERROR", "bonjour IMAGE_DATA urgent", "guten " * 300, "Hello good friend", "x", "thank terrible words otherwise lengthier", "the wall of sentence\tgathered"]


def test_scalars(spark):
    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in TEXTS], "t string").select(S.document_type(t), S.language(t), S.sentiment(t), S.priority(t, S.word_count(t), S.document_type(t)), S.word_count(t), S.keywords(t)).collect()
    assert [r[0] for r in got] == ["corrupted", "image", "document", "text", "text", "text", "text"]
    assert [r[1] for r in got] == ["spanish", "french", "german", "english", "unknown", "english", "unknown"]
    assert [r[2] for r in got] == ["neutral", "neutral", "neutral", "positive", "neutral", "negative", "neutral"]
    assert [r[3] for r in got] == [5, 9, 5, 5, 5, 5, 5]
    assert [r[4] for r in got] == [len(x.split()) for x in TEXTS]
    assert got[5][5] == ["terrible", "lengthier"] and got[6][5] == ["sentence"]


def test_document_pipeline_covers_every_branch(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "workflow_id long, content string")
    out = {r["workflow_id"]: r for r in documents.document_pipeline(docs).collect()}
    done = {k for k in range(7) if out[k]["status"] == "completed"}
    assert {0, 1, 2, 3, 5} <= done and 4 not in done and out[4]["status"] == "ingested"
    assert out[1]["expedited"] and "EXTRACTED_TEXT" in out[1]["content"] and out[0]["errors"][0].startswith("document is corrupted")
    assert out[0]["type"] == "text" and out[4]["errors"] == ["document content too short"] * 2
    assert out[0]["content"] == "[PROCESSED] [TRANSLATED] hola REPAIRED"


def test_document_quality_gate(spark):
    docs = spark.createDataFrame([(1, "hello there, good friend"), (2, "one two three four")], "workflow_id long, content string")
    out = {r["workflow_id"]: r for r in documents.document_pipeline(docs, 0.85).collect()}
    assert (out[1]["status"], out[1]["errors"]) == ("completed", []) and (out[2]["status"], out[2]["errors"]) == ("processed", ["quality check failed"])
    checked = documents.document_pipeline(docs, 0.85)
    assert [r["content"].startswith("[ENHANCED_QUALITY]") for r in documents.enhance(checked, 0.85).orderBy("workflow_id").collect()] == [False, True]


def test_simple_pipeline(spark):
    rows = spark.createDataFrame([(1, False, True, "p"), (2, True, True, "p"), (3, True, False, "p")], "workflow_id long, needs_repair boolean, allow_repair boolean, processor string")
    got = {r["workflow_id"]: r["history"] for r in documents.simple_pipeline(rows).collect()}
    assert got[1] == got[3] == ["p:intake", "p:validate", "p:process"] and got[2] == ["p:intake", "p:validate", "p:repair", "p:validate", "p:process"]


@pytest.mark.parametrize("partitions", [8, 200])
def test_rank_of_wide_rows(spark, partitions):
    """Every number once, in order, whatever columns the reader takes."""
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(300_000, numPartitions=12).select(((F.col("id") * 7919) % 300_000).alias("k"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 7).alias("w"), F.col("id").cast("string").alias("_at"))
        ranked = global_rank(rows, ["w", "k"], "n", 1)
        assert ranked.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (300_000, 1, 300_000)
        assert ranked.select(F.lag("k").over(W.partitionBy("w").orderBy("n")).alias("before"), "k").where("before >= k").count() == 0
        assert ranked.groupBy("w").agg(F.min("n").alias("a"), F.max("n").alias("b")).orderBy("a").select("w").toPandas()["w"].tolist() == list(range(7))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_every_branch_has_rows(spark):
    """With the words of the corpus, each answer and each way through the workflow occurs."""
    from tidewright import registry

    rows = registry.queries()["fn_all_words"](spark, "/root/testdata/sf0.01").collect()
    assert {r["type"] for r in rows} == {"corrupted", "image", "document", "text"} and {r["sentiment"] for r in rows} == {"positive", "negative", "neutral"}
    assert {r["language"] for r in rows} == {"spanish", "french", "german", "english", "unknown"} and {r["priority"] for r in rows} >= {5, 6, 7, 8} and {r["score"] for r in rows} == {0.7, 0.8, 0.9, 1.0}
    docs = registry.queries()["dag_document_words"](spark, "/root/testdata/sf0.01").collect()
    assert {r["status"] for r in docs} == {"completed", "processed", "ingested"} and {r["expedited"] for r in docs} == {True, False}
    assert {r["errors"] for r in docs} >= {"", "quality check failed|quality check failed", "document is corrupted and cannot be processed", "document content too short|document content too short"}
