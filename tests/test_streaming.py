import pandas as pd
from pyspark.sql import functions as F

from tidewright.operators import kv, metrics, queue
from tidewright.sources.connectors import files
from tidewright.sources.tables import commands
from tidewright.streaming import jobs


def as_stream(spark, df, folder, parts=4):
    df.repartitionByRange(parts, "log_index").sortWithinPartitions("log_index").write.parquet(str(folder))
    return jobs.read_log(spark, str(folder), df.schema, files=1)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_folds_equal_batch(spark, sf_dir, tmp_path):
    for k, (log, batch, stream) in enumerate((
        (kv._conditional_log(spark, sf_dir), kv.apply_conditional, jobs.kv_results),
        (queue._lease_log(spark, sf_dir), queue.leases, jobs.lease_results),
        (metrics._requests(spark, sf_dir), lambda x: metrics.token_bucket(x, 1 / 4096, 3), lambda x: jobs.rate_limited(x, 1 / 4096, 3)),
    )):
        live = as_stream(spark, log.coalesce(1), tmp_path / f"in{k}", 1)
        jobs.to_table(stream(live), str(tmp_path / f"out{k}"), str(tmp_path / f"cp{k}")).awaitTermination()
        assert rows(spark.read.parquet(str(tmp_path / f"out{k}"))) == rows(batch(log))


def test_dedup_routing_and_latest(spark, sf_dir, tmp_path):
    log = commands(spark, sf_dir).select("key", "log_index", "ts", F.col("value").cast("string").alias("value"), F.col("log_index").alias("version"), (F.col("user_id") % 5).alias("node_id"), "kind")
    live = as_stream(spark, log.unionAll(log.where("log_index % 3 = 0")), tmp_path / "in", 1)  # in one batch: rows older than the watermark would be dropped
    out = jobs.routed(jobs.subscribed(jobs.dedup(live), "workflow:1"))
    jobs.to_table(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == log.where("key like 'workflow:1%'").count() and got.where("channel <> 'workflow' or type <> kind").count() == 0
    live = as_stream(spark, log, tmp_path / "in2", 3)
    query = jobs.latest_state(live, str(tmp_path / "table"), str(tmp_path / "cp2"))
    query.awaitTermination()
    last = max(p.name for p in (tmp_path / "table").iterdir())
    assert rows(spark.read.parquet(str(tmp_path / "table" / last)).select("key", "value", "version")) == rows(kv.latest(log))


def test_windows(spark, sf_dir, tmp_path):
    log = commands(spark, sf_dir).select("log_index", "ts", "kind")
    live = as_stream(spark, log, tmp_path / "in", 1)
    query = jobs.windowed_rates(live, "ts", "1 hour", "1 day").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["window"]["start"], r["kind"]): r["n"] for r in spark.sql("select * from rates").collect()}
    want = {(r["window"]["start"], r["kind"]): r["n"] for r in log.groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_sources(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "src"))
    stream = files(spark, {"format": "parquet", "path": str(tmp_path / "src"), "schema": "id long"})
    jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_latest_state_keeps_two_versions(spark, tmp_path):
    log = spark.range(60).selectExpr("id as log_index", "cast(id % 7 as string) as key", "cast(id as string) as value")
    live = as_stream(spark, log, tmp_path / "in", 6)
    jobs.latest_state(live, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    versions = sorted(int(p.name[2:]) for p in (tmp_path / "table").iterdir())
    assert len(versions) == 2 and rows(spark.read.parquet(str(tmp_path / f"table/v={versions[-1]}")).select("key", "value", "version")) == rows(kv.latest(log))


def test_latest_state_by_bucket_writes_what_it_touches(spark, tmp_path):
    first = spark.range(600).selectExpr("id as log_index", "cast(id % 70 as string) as key", "cast(id as string) as value")
    later = spark.range(600, 640).selectExpr("id as log_index", "cast(id % 2 as string) as key", "cast(id as string) as value")
    path = str(tmp_path / "table")
    assert jobs.read_buckets(spark, path).collect() == []
    written = []
    for k, part in enumerate((first, later, later.withColumn("log_index", F.col("log_index") + 100))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = jobs.read_log(spark, str(tmp_path / "in"), first.schema, 1)
        jobs.latest_state_by_bucket(live, path, str(tmp_path / "cp"), 16).awaitTermination()
        written.append({p.name for p in (tmp_path / "table" / "rows" / f"v={k}").iterdir() if p.name.startswith("bucket=")})
    whole = first.unionAll(later).unionAll(later.withColumn("log_index", F.col("log_index") + 100))
    assert rows(jobs.read_buckets(spark, path).select("key", "value", "version")) == rows(kv.latest(whole))
    assert len(written[0]) > 8 and len(written[1]) <= 2 == len({p.name for p in (tmp_path / "table" / "manifest").iterdir()})


def test_idle_keys_leave_the_state():
    group, held = ("k",), jobs.stepped(("log_index",), lambda: {"n": 0}, lambda s, r: s.update(n=s["n"] + 1) or {"n": s["n"]}, ["k", "n"], 1000)

    class State:
        def __init__(self):
            self.value, self.exists, self.hasTimedOut, self.waits = None, False, False, None

        get = property(lambda self: self.value)

        def update(self, value):
            self.value, self.exists = value, True

        def remove(self):
            self.value, self.exists = None, False

        def setTimeoutDuration(self, ms):
            self.waits = ms

    state = State()
    out = [f["n"].tolist() for part in ([1, 2], [3]) for f in held(group, iter([pd.DataFrame({"k": "k", "log_index": part})]), state)]
    assert out == [[1, 2], [3]] and state.waits == 1000
    state.hasTimedOut = True
    assert [len(f) for f in held(group, iter([]), state)] in ([], [0]) and not state.exists
