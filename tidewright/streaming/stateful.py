"""Streams with states of their own: status documents kept per workflow, and timers for keys, leases and claims.

States live in RocksDB and are read by key, so a workflow or a buffer of any size costs what it is asked for. Every job
gives the rows that its batch operator gives, whatever the micro-batches and after restarts.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.history import MOST_LISTED
from ..operators.queue import CLAIM_TTL_US, ORPHAN_US, _lease

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "workflow_id long, kind string, version long, status string, started_us long, node_name string, at_us long, sequence long, tier string, data string"
DOCUMENT = "workflow_id long, revision long, status string, started_us long, executed array<struct<node_name:string, at_us:long>>, executing array<struct<sequence:long, node_name:string, data:string>>, pending array<struct<sequence:long, node_name:string, data:string>>, n_executed long, n_executing long, n_pending long"


def keep_states_by_key(spark: SparkSession) -> None:
    """Jobs of this module need a state store with several states a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def status_changes(instances: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """Three streams as one of CHANGES: instances (workflow_id, version, status, started_us), runs (workflow_id, node_name,
    at_us) and items (workflow_id, version, sequence, tier, node_name, data; another tier takes an item out)."""
    none = lambda kind: F.lit(None).cast(kind)
    names = {"version": "long", "status": "string", "started_us": "long", "node_name": "string", "at_us": "long", "sequence": "long", "tier": "string", "data": "string"}
    of = lambda df, kind: df.select(F.col("workflow_id").cast("long").alias("workflow_id"), F.lit(kind).alias("kind"), *(F.col(c).cast(t).alias(c) if c in df.columns else none(t).alias(c) for c, t in names.items()))
    return of(instances, "instance").unionByName(of(runs, "run")).unionByName(of(items, "item"))


class Documents(StatefulProcessor):
    """One workflow: its instance, its runs and its items; each micro-batch that changes it gives the whole document."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.instance = handle.getValueState("instance", "version long, status string, started_us long, revision long")
        self.runs = handle.getMapState("runs", "node_name string, at_us long", "n long")
        self.items = handle.getMapState("items", "sequence long", "version long, tier string, node_name string, data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.instance.get() if self.instance.exists() else (None, None, None, 0)
        for part in rows:
            for r in part.astype(object).where(part.notna(), None).itertuples(index=False):
                if r.kind == "instance" and (held[0] is None or int(r.version) >= held[0]):
                    held = (int(r.version), r.status, None if r.started_us is None else int(r.started_us), held[3])
                elif r.kind == "run":
                    run = (r.node_name, int(r.at_us))
                    self.runs.updateValue(run, ((self.runs.getValue(run)[0] if self.runs.containsKey(run) else 0) + 1,))
                elif r.kind == "item":
                    at = (int(r.sequence),)
                    if not self.items.containsKey(at) or self.items.getValue(at)[0] <= int(r.version):
                        self.items.updateValue(at, (int(r.version), r.tier, r.node_name, r.data))  # one taken out stays, so that a late older row does not bring it back
        held = (*held[:3], held[3] + 1)
        self.instance.update(held)
        if held[0] is None:  # nothing is known of the workflow itself yet
            return
        counts, runs = [0, 0, 0], []
        for run, (n,) in self.runs.iterator():
            counts[0] += n
            runs = heapq.nsmallest(self.most, [*runs, *[tuple(run)] * min(n, self.most)]) if len(runs) >= 4 * self.most else [*runs, *[tuple(run)] * min(n, self.most)]
        listed: list[list] = [[], []]
        for (sequence,), (_, tier, node, data) in self.items.iterator():
            k = 0 if tier == "claimed" else 1 if tier in ("ready", "blocked") else None
            if k is not None:
                counts[k + 1] += 1
                listed[k].append((sequence, node, data))
                if len(listed[k]) >= 4 * self.most:
                    listed[k] = heapq.nsmallest(self.most, listed[k], key=lambda x: x[0])
        executed = [{"node_name": a, "at_us": b} for a, b in heapq.nsmallest(self.most, runs)]
        queued = [[{"sequence": a, "node_name": b, "data": c} for a, b, c in heapq.nsmallest(self.most, x, key=lambda x: x[0])] for x in listed]
        yield pd.DataFrame([(key[0], held[3], held[1], held[2], executed, *queued, *counts)], columns=["workflow_id", "revision", "status", "started_us", "executed", "executing", "pending", "n_executed", "n_executing", "n_pending"]).astype({"started_us": "Int64"})

    def close(self) -> None:
        pass


def status_documents(changes: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """DOCUMENT rows: the whole document of each workflow that a micro-batch of CHANGES touches, in update mode.

    The last revision of a workflow is the document of the batch operator over all that has arrived, in whatever order;
    of versions of an instance or item the highest counts.
    """
    return changes.groupBy("workflow_id").transformWithStateInPandas(Documents(most), DOCUMENT, "Update", "None")


def subscribed(documents: DataFrame, workflow_id: int) -> DataFrame:
    """What a subscriber to one workflow's state gets."""
    return documents.where(F.col("workflow_id") == workflow_id)


def to_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "update", runs_on: bool = False) -> StreamingQuery:
    """Each micro-batch as a folder of its own, written again if it runs again, until what is there has been read.

    runs_on: it goes on with what comes then. Jobs whose states have a time to live need that, since Spark goes on with
    empty batches for them and would never come to an end of what is available now.
    """
    keep_states_by_key(df.sparkSession)
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer if runs_on else writer.trigger(availableNow=True)).start()


def current(documents: DataFrame) -> DataFrame:
    """The last revision of each document of such folders."""
    return documents.groupBy("workflow_id").agg(F.max_by(F.struct(*(c for c in documents.columns if c != "workflow_id")), "revision").alias("d")).select("workflow_id", "d.*")


class Lapses(StatefulProcessor):
    """One key: rows wait until the watermark has passed them, then go through step in order; deadlines that pass are rows.

    step(state, row) gives the deadline that the row leaves (None for none), or False if it sets nothing.
    """

    def __init__(self, start: Callable[[], dict], step: Callable[[dict, dict], int | None | bool]):
        self.start, self.step = start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts_us long, log_index long", "row string")
        self.held = handle.getValueState("held", "state string, set_at long, deadline_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for row in part.astype(object).where(part.notna(), None).drop(columns=["event_time"]).to_dict("records"):
                self.waiting.updateValue((int(row["ts_us"]), int(row["log_index"])), (json.dumps(row, default=int),))
                self.handle.registerTimer(int(row["ts_us"]) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        text, set_at, deadline = self.held.get() if self.held.exists() else (json.dumps(self.start()), None, None)
        state, out = json.loads(text), []
        due = sorted((tuple(at), row[0]) for at, row in self.waiting.iterator() if at[0] <= until)
        for (ts, index), row in due:
            if deadline is not None and deadline < ts:
                out.append((key[0], set_at, deadline))
                deadline = None
            if (sets := self.step(state, json.loads(row))) is not False:
                set_at, deadline = index, sets
            self.waiting.removeKey((ts, index))
        if deadline is not None and deadline < until:
            out.append((key[0], set_at, deadline))
            deadline = None
        elif deadline is not None:
            self.handle.registerTimer(max(deadline // 1000 + 1, until // 1000 + 1))
        self.held.update((json.dumps(state), set_at, deadline))
        if out:
            yield pd.DataFrame(out, columns=["key", "set_at", "lapsed_us"])

    def close(self) -> None:
        pass


def lapsing(log: DataFrame, late: str, start: Callable[[], dict], step: Callable[[dict, dict], int | None | bool]) -> DataFrame:
    """key, set_at, lapsed_us of every deadline that the watermark passes, each once; rows up to ``late`` out of order are put in order."""
    timed = log.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", late)
    return timed.groupBy("key").transformWithStateInPandas(Lapses(start, step), "key string, set_at long, lapsed_us long", "Append", "EventTime")


def _key_step(state: dict, row: dict) -> int | bool:
    return row["ts_us"] + row["ttl_seconds"] * 1_000_000 if row["op"] == "put" and (row["ttl_seconds"] or 0) > 0 else False


def key_lapses(log: DataFrame, late: str) -> DataFrame:
    """Keys whose time to live passes: log has key, log_index, op, ts_us, ttl_seconds; equals deadlines.lapses(key_deadlines(log))."""
    return lapsing(log.select("key", "log_index", "op", "ts_us", "ttl_seconds"), late, dict, _key_step)


def _lease_step(state: dict, row: dict) -> int | None | bool:
    result = _lease(state, row)
    return result["expires_us"] if result["ok"] else False


def lease_lapses(log: DataFrame, late: str) -> DataFrame:
    """Leases that run out: commands as of queue.leases, which decides what is granted; equals deadlines.lapses(lease_deadlines(log))."""
    return lapsing(log.select("key", "log_index", "op", "owner", "ts_us", "ttl_us"), late, lambda: {"owner": None, "generation": 0, "expires_us": None}, _lease_step)


def claim_lapses(log: DataFrame, late: str, ttl_us: int = CLAIM_TTL_US, orphan_us: int = ORPHAN_US) -> DataFrame:
    """Claims to give back: claim and claim_bare begin one, anything else ends it; equals deadlines.lapses(claim_deadlines(log))."""
    step = lambda state, row: row["ts_us"] + (ttl_us if row["op"] == "claim" else orphan_us) if row["op"] in ("claim", "claim_bare") else None
    return lapsing(log.select("key", "log_index", "op", "ts_us"), late, dict, step)


class Once(StatefulProcessor):
    """One event key: the first row passes, and the state that says so is dropped after a while by its time to live."""

    def __init__(self, keep_ms: int, names: list[str]):
        self.keep_ms, self.names = keep_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = next(iter(rows)).iloc[:1]
        if not self.seen.exists():
            self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield first[self.names]

    def close(self) -> None:
        pass


def dedup(events: DataFrame, keep_ms: int = 600_000, by: tuple[str, ...] = ("key", "version", "node_id")) -> DataFrame:
    """One of the events that are equal in ``by`` and arrive within keep_ms of the first, by the clock of the job."""
    return events.groupBy(*by).transformWithStateInPandas(Once(keep_ms, events.columns), events.schema, "Append", "ProcessingTime")
