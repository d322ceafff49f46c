"""Snapshots, checksums, span trees and health views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dag import WHOLE
from ..plans.shared import staged
from ..sources.tables import SQL_COMMANDS, SQL_WORKFLOWS, commands, load, workflows
from .kv import _REPLAY, _versioned, latest, since_delete
from .metrics import ORACLES as METRICS
from .metrics import breaker, token_bucket, _calls, _requests, _RATE, _BURST
from .queue import _ITEMS, _items, size

COMPRESS_FROM, CLUSTER_POLICIES = 1024, ("strict", "adopt", "reset", "recover")


def snapshot(log: DataFrame, upto: int) -> DataFrame:
    """key, value, version, log_index of a log of puts as of an index: what a snapshot table holds."""
    return log.where(F.col("log_index") <= upto).groupBy("key").agg(F.max_by("value", "log_index").alias("value"), F.count("*").alias("version"), F.max("log_index").alias("log_index"))


def restore(snap: DataFrame, suffix: DataFrame) -> DataFrame:
    """The state of a snapshot and the puts after it: one aggregate over both, not a replay from the start."""
    new = suffix.groupBy("key").agg(F.max_by("value", "log_index").alias("value"), F.count("*").alias("version"), F.max("log_index").alias("log_index"))
    both = snap.unionByName(new)
    return both.groupBy("key").agg(F.max_by("value", "log_index").alias("value"), F.sum("version").alias("version"))


def snapshot_all(log: DataFrame, upto: int) -> DataFrame:
    """key, value, version, expire_at_us of a log of puts and deletes with expiry (see kv.since_delete) as of an index.

    Deleted keys are in it only if an expiry has outlived them, with version 0.
    """
    return since_delete(log.where(F.col("log_index") <= upto)).where("version > 0 or expire_at_us is not null").select("key", "value", "version", "expire_at_us")


def restore_all(snap: DataFrame, suffix: DataFrame) -> DataFrame:
    """key, value, version, expire_at_us of such a snapshot and the commands after it; a delete restarts the version."""
    new = since_delete(suffix).withColumnsRenamed({c: f"new_{c}" for c in ("value", "version", "log_index", "expire_at_us")})
    both = snap.join(new, "key", "full")
    old = ~F.coalesce("deleted", F.lit(False))
    version = F.when(old, F.coalesce("version", F.lit(0))).otherwise(0) + F.coalesce("new_version", F.lit(0))
    value = F.when(F.col("new_version") > 0, F.col("new_value")).when(old, F.col("value"))
    return both.select("key", value.alias("value"), version.alias("version"), F.coalesce("new_expire_at_us", "expire_at_us").alias("expire_at_us")).where("version > 0")


def checksum(state: Column) -> Column:
    return F.sha2(state, 256)


def compresses(state: Column) -> Column:
    """Whether a state is written compressed."""
    return F.octet_length(state) >= COMPRESS_FROM


def cluster_policy(stored: Column, own: Column, policy: str) -> Column:
    """What a node does that finds another cluster's id: go on, take it, wipe, or fail."""
    if policy not in CLUSTER_POLICIES:
        raise ValueError(f"no such policy: {policy}")
    other = {"strict": "error", "adopt": "adopt", "reset": "reset", "recover": "adopt"}[policy]
    return F.when(stored.isNull(), "write").when(stored == own, "keep").otherwise(other)


def span_tree(spans: DataFrame) -> DataFrame:
    """span_id, root_id, depth of spans (span_id, parent_span_id), level by level; a missing parent makes a root."""
    known = spans.select(F.col("span_id").alias("known_id"))
    marked = staged(spans.join(known, F.col("parent_span_id") == F.col("known_id"), "left").select("span_id", F.col("known_id").alias("parent")))
    level = staged(marked.where("parent is null").select("span_id", F.col("span_id").alias("root_id"), F.lit(0).alias("depth")))
    out, depth, most = level, 0, marked.count()
    while True:
        depth += 1
        up = level.select(F.col("span_id").alias("parent"), "root_id")
        level = staged(marked.join(up, "parent").select("span_id", "root_id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        if depth > most:
            raise RuntimeError("spans that repeat an id make a cycle")
        out = out.unionByName(level)
        if depth % WHOLE == 0:
            out = staged(out)


def span_durations(spans: DataFrame) -> DataFrame:
    """Finished spans with their duration; a span that has not ended has none."""
    return spans.select("span_id", (F.col("end_us") - F.col("start_us")).alias("duration_us"))


def tracing_metrics(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count("*").alias("created"), F.count_if(F.col("end_us").isNotNull()).alias("finished"), F.count_if(F.col("end_us").isNull()).alias("active"))


def health(w: DataFrame, items: DataFrame, leader: str | None) -> DataFrame:
    """One row: running workflows, open queue items, whether there is a leader, and healthy or not."""
    out = size(items).withColumnRenamed("n", "queue_size").crossJoin(w.agg(F.count_if(F.col("status") == "running").alias("running")))  # one row each
    return out.select("running", "queue_size", F.lit(leader is not None).alias("has_leader"), F.when(F.lit(leader is not None), "healthy").otherwise("unhealthy").alias("status"))


def breaker_metrics(calls: DataFrame) -> DataFrame:
    """key, state at the end, total, allowed and rejected calls of a breaker's outcome rows."""
    return calls.groupBy("key").agg(F.max_by("state", "log_index").alias("state"), F.count("*").alias("total"), F.count_if("allowed").alias("allowed_n"), F.count_if(~F.col("allowed")).alias("rejected_n"))


def _spans(s, d):
    return load(s, d, "events").select(F.col("event_id").alias("span_id"), F.when(F.col("event_id") % 100 > 0, F.col("event_id") - F.col("event_id") % 100 + F.floor((F.col("event_id") % 100 - 1) / 3)).alias("parent_span_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), F.when(F.col("event_type") != "error", F.unix_micros(F.col("ts").cast("timestamp")) + F.col("user_id") * 1000).alias("end_us"))


_SPANS = "s AS (SELECT event_id AS span_id, CASE WHEN event_id % 100 > 0 THEN event_id - event_id % 100 + (event_id % 100 - 1) // 3 END AS parent_span_id, epoch_us(ts) AS start_us, CASE WHEN event_type <> 'error' THEN epoch_us(ts) + user_id * 1000 END AS end_us FROM events)"


def _middle(log):
    """The index in the middle of the log, where the snapshots are taken."""
    return log.agg(F.floor(F.max("log_index") / 2)).first()[0] or 0


def _snapshot(s, d):
    log = commands(s, d)
    return snapshot(log, _middle(log))


def _restored(s, d):
    log = commands(s, d)
    upto = _middle(log)
    return restore(snapshot(log, upto), log.where(F.col("log_index") > upto))


def _restored_all(s, d):
    log = _versioned(s, d)
    upto = _middle(log)
    return restore_all(staged(snapshot_all(log, upto)), log.where(F.col("log_index") > upto))


QUERIES = {
    "kv_snapshot": _snapshot,
    "kv_snapshot_all": lambda s, d: snapshot_all(_versioned(s, d), _middle(_versioned(s, d))),
    "kv_restore_all": _restored_all,
    "kv_restore": _restored,
    "state_checksum": lambda s, d: latest(commands(s, d).withColumn("value", F.col("payload"))).select("key", checksum(F.col("value")).alias("sha256"), compresses(F.col("value")).alias("compressed")),
    "state_compressed": lambda s, d: load(s, d, "documents").where("text is not null").select("doc_id", compresses(F.col("text")).alias("compressed")),
    "cluster_policy": lambda s, d: load(s, d, "supplier").select("s_suppkey", *(cluster_policy(F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string"))), F.lit("c1"), p).alias(p) for p in CLUSTER_POLICIES)),
    "ob_span_tree": lambda s, d: span_tree(_spans(s, d)),
    "ob_span_durations": lambda s, d: span_durations(_spans(s, d)),
    "ag_tracing": lambda s, d: tracing_metrics(_spans(s, d)),
    "ob_health": lambda s, d: health(workflows(s, d), _items(s, d), "node-1"),
    "cb_metrics": lambda s, d: breaker_metrics(breaker(_calls(s, d), 2, 1, 600_000_000)),
    "rl_global": lambda s, d: token_bucket(_requests(s, d), _RATE, _BURST).agg(F.count("*").alias("total"), F.count_if("allowed").alias("allowed_n"), F.count_if(~F.col("allowed")).alias("denied_n"), F.count_distinct("key").alias("keys")),
}
ORACLES = {
    "kv_snapshot": f"WITH {SQL_COMMANDS} SELECT key, arg_max(value, log_index) AS value, count(*) AS version, max(log_index) AS log_index FROM c WHERE log_index <= (SELECT max(event_id) // 2 FROM events) GROUP BY key",
    "kv_snapshot_all": f"{_REPLAY.replace('FROM events)', 'FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))', 1)} SELECT key, value, version, expire_at_us FROM r WHERE version > 0 OR expire_at_us IS NOT NULL",
    "kv_restore_all": f"{_REPLAY} SELECT key, value, version, expire_at_us FROM r WHERE version > 0",
    "kv_restore": f"WITH {SQL_COMMANDS} SELECT key, arg_max(value, log_index) AS value, count(*) AS version FROM c GROUP BY key",
    "state_checksum": f"WITH {SQL_COMMANDS} SELECT key, sha256(arg_max(payload, log_index)) AS sha256, strlen(arg_max(payload, log_index)) >= 1024 AS compressed FROM c GROUP BY key",
    "state_compressed": "SELECT doc_id, strlen(text) >= 1024 AS compressed FROM documents WHERE text IS NOT NULL",
    "cluster_policy": "SELECT s_suppkey, " + ", ".join(f"CASE s_suppkey % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'keep' ELSE '{o}' END AS {p}" for p, o in (("strict", "error"), ("adopt", "adopt"), ("reset", "reset"), ("recover", "adopt"))) + " FROM supplier",
    "ob_span_tree": f"WITH RECURSIVE {_SPANS}, t AS (SELECT span_id, span_id AS root_id, 0 AS depth FROM s WHERE parent_span_id IS NULL UNION ALL SELECT s.span_id, t.root_id, t.depth + 1 FROM t JOIN s ON s.parent_span_id = t.span_id) SELECT * FROM t",
    "ob_span_durations": f"WITH {_SPANS} SELECT span_id, end_us - start_us AS duration_us FROM s",
    "ag_tracing": f"WITH {_SPANS} SELECT count(*) AS created, count(end_us) AS finished, count(*) - count(end_us) AS active FROM s",
    "ob_health": f"WITH {_ITEMS}, {SQL_WORKFLOWS} SELECT (SELECT count(*) FROM w WHERE status = 'running') AS running, (SELECT count(*) FROM i WHERE tier IN ('ready', 'blocked')) AS queue_size, true AS has_leader, 'healthy' AS status",
    "cb_metrics": f"SELECT key, arg_max(state, log_index) AS state, count(*) AS total, count(*) FILTER (allowed) AS allowed_n, count(*) FILTER (NOT allowed) AS rejected_n FROM ({METRICS['cb_states']}) GROUP BY key",
    "rl_global": f"SELECT count(*) AS total, count(*) FILTER (allowed) AS allowed_n, count(*) FILTER (NOT allowed) AS denied_n, count(DISTINCT key) AS keys FROM ({METRICS['rl_token_bucket']})",
}
