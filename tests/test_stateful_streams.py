"""Streams with states and timers: the rows of the batch operators, for several micro-batches, orders and restarts."""

import time

import pytest
from pyspark.sql import functions as F

from tidewright.operators import deadlines, history
from tidewright.operators.queue import _lease_log
from tidewright.sources.tables import workflows
from tidewright.streaming import jobs, stateful


def rows(df):
    return sorted(map(repr, df.collect()))


def feed(df, folder, parts):
    """df in files, the rows of each file next to each other in no order of time."""
    df.repartition(parts, F.xxhash64(*df.columns) % 97).write.mode("append").parquet(str(folder))


CASES = {
    "keys": (deadlines._key_log, lambda log: deadlines.key_deadlines(log), stateful.key_lapses),
    "leases": (_lease_log, lambda log: deadlines.lease_deadlines(log), stateful.lease_lapses),
    "claims": (deadlines._claim_log, lambda log: deadlines.claim_deadlines(log), stateful.claim_lapses),
}


@pytest.mark.parametrize("name,parts,files", [("keys", 1, 1), ("keys", 4, 1), ("leases", 3, 2), ("claims", 4, 1)])
def test_lapses_equal_the_batch_operator(spark, sf_dir, tmp_path, name, parts, files):
    make, batch, stream = CASES[name]
    log = make(spark, sf_dir)
    feed(log, tmp_path / "in", parts)
    late = "60 days"  # all files are out of order among each other
    last = log.agg(F.max("ts_us")).first()[0]
    # a last row moves the watermark past all others
    tail = log.limit(1).withColumn("ts_us", F.lit(last + 70 * 86_400_000_000).cast("long")).withColumn("log_index", F.lit(10**9).cast("long")).withColumn("key", F.lit("end"))
    run = lambda: stateful.to_batches(stream(jobs.read_log(spark, str(tmp_path / "in"), log.schema, files), late), str(tmp_path / "out"), str(tmp_path / "cp"), "append").awaitTermination()
    stateful.keep_states_by_key(spark)
    run()
    feed(tail, tmp_path / "in", 1)
    run()  # a restart, with the states of the first run
    until = (last + 10 * 86_400_000_000) // 1000 * 1000
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").where("key <> 'end'")
    want = deadlines.lapses(batch(log), until)
    assert want.count() > 0 and rows(got) == rows(want)


def test_documents_equal_the_batch_operator(spark, sf_dir, tmp_path):
    runs, items = history._ran(spark, sf_dir), history._queued(spark, sf_dir)
    instances = workflows(spark, sf_dir)
    old = instances.withColumns({"version": F.lit(1).cast("long"), "status": F.lit("starting")})
    new = instances.withColumn("version", F.lit(2).cast("long"))
    moved = items.withColumn("version", F.lit(5).cast("long"))
    before = moved.withColumns({"version": F.lit(4).cast("long"), "tier": F.lit("ready")})
    gone = items.where("tier = 'blocked'").withColumns({"version": F.lit(9).cast("long"), "tier": F.lit("done")})
    changes = stateful.status_changes(old.unionByName(new), runs, moved.unionByName(before).unionByName(gone))
    feed(changes.where("kind = 'instance' or workflow_id % 2 = 0"), tmp_path / "in", 3)
    for part in (None, changes.where("kind <> 'instance' and workflow_id % 2 = 1")):  # the second run restarts with the states of the first
        if part is not None:
            feed(part, tmp_path / "in", 2)
        stateful.keep_states_by_key(spark)
        live = jobs.read_log(spark, str(tmp_path / "in"), stateful.CHANGES, 1)
        stateful.to_batches(stateful.status_documents(live, 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = stateful.current(out.drop("batch")).drop("revision")
    want = history.status_documents(instances, runs, items.where("tier <> 'blocked'"), 2)
    assert rows(got.select(want.columns)) == rows(want)
    one = stateful.subscribed(out, 1).orderBy("revision").collect()
    assert [r["revision"] for r in one] == sorted({r["revision"] for r in one}) and len(one) > 1
    assert out.groupBy("workflow_id", "revision").count().where("count > 1").isEmpty()


def test_dedup_forgets(spark, tmp_path):
    events = spark.range(300).selectExpr("concat('k', id % 40) as key", "id % 2 as version", "0L as node_id", "id as n")
    feed(events, tmp_path / "in", 3)
    stateful.keep_states_by_key(spark)
    for keep, want in ((3_600_000, 40), (1, None)):
        live = jobs.read_log(spark, str(tmp_path / "in"), events.schema, 1)
        query = stateful.to_batches(stateful.dedup(live, keep), str(tmp_path / f"out{keep}"), str(tmp_path / f"cp{keep}"), "append", runs_on=True)
        try:
            deadline = time.monotonic() + 120
            while sum(p["numInputRows"] for p in query.recentProgress) < 300 and query.isActive and time.monotonic() < deadline:
                time.sleep(0.5)
        finally:
            query.stop()
        got = spark.read.parquet(str(tmp_path / f"out{keep}"))
        assert got.select("key", "version").distinct().count() == 40
        assert got.count() == 40 if want else got.count() > 40
