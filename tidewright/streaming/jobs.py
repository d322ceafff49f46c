"""The same operators as Structured Streaming jobs over an unbounded command log.

Dedup, routing and subscriptions are stateless or keyed by watermark; the per-key state machines run the step
functions of the batch folds with their state in Spark's state store.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kv import _conditional
from ..operators.metrics import _token_bucket, route
from ..operators.queue import _lease


def read_log(spark: SparkSession, path: str, schema: str | T.StructType, files: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def dedup(events: DataFrame, ts: str = "ts", window: str = "10 minutes") -> DataFrame:
    """One of the events with the same key, version and node that arrive within the window."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark(["key", "version", "node_id"])


def routed(events: DataFrame) -> DataFrame:
    return events.withColumn("route", route(F.col("key"))).where("route is not null").select("*", "route.*").drop("route")


def subscribed(events: DataFrame, prefix: str) -> DataFrame:
    return events.where(F.col("key").startswith(prefix))


def windowed_rates(events: DataFrame, ts: str, late: str, width: str) -> DataFrame:
    """Events and failures by kind and time window; rows later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "node_error").alias("failed"))


def stepped(order: Sequence[str], start: Callable[[], dict], step: Callable[[dict, dict], dict | None], names: Sequence[str], idle_ms: int | None):
    """The function that steps one key's rows of a micro-batch; a key without rows for idle_ms leaves the state."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(parts)).sort_values(list(order), kind="stable")  # one key's rows of one micro-batch, which maxFilesPerTrigger bounds
        got = []
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            if (result := step(held, row)) is not None:
                got.append((group[0], *(result[n] for n in names[1:])))
        state.update((json.dumps(held),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(got, columns=list(names))

    return run


def stateful_fold(events: DataFrame, key: str, order: Sequence[str], start: Callable[[], dict], step: Callable[[dict, dict], dict | None], schema: str, idle_ms: int | None = None) -> DataFrame:
    """step's result for every row, keys' states kept between micro-batches; rows of a batch are stepped in order.

    With idle_ms, a key that has no rows for so long starts anew: for states that mean nothing by then.
    """
    out = T.StructType([events.schema[key], *T._parse_datatype_string(schema).fields])
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy(key).applyInPandasWithState(stepped(order, start, step, out.names, idle_ms), out, "state string", "append", timeout)


def kv_results(log: DataFrame) -> DataFrame:
    return stateful_fold(log, "key", ["log_index"], lambda: {"value": None, "version": 0}, _conditional, "log_index long, ok boolean, error string, version_after long, value_after string")


def lease_results(log: DataFrame) -> DataFrame:
    return stateful_fold(log, "key", ["log_index"], lambda: {"owner": None, "generation": 0, "expires_us": None}, _lease, "log_index long, ok boolean, error string, holder string, generation long, expires_us long")


def rate_limited(log: DataFrame, rate: float, burst: int, forget: bool = False) -> DataFrame:
    """forget: a bucket that has been idle for the time it takes to fill is full, as a new one is, and leaves the state.

    That is for queries that run on: with a trigger of what is available now, Spark waits for the timeouts forever.
    """
    start, step = _token_bucket(rate, burst)
    return stateful_fold(log, "key", ["log_index"], start, step, "log_index long, allowed boolean, tokens double", math.ceil(burst / rate * 1000) + 1 if forget else None)


def latest_state(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of the last value and version of each key: every micro-batch merges into a new version of it.

    Versions are written beside each other and a batch that runs again overwrites its own, so a lost driver or
    executor leaves the table of the batch before. The one before that is deleted.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("key").agg(F.max_by("value", "log_index").alias("value"), F.count("*").alias("version"), F.max("log_index").alias("log_index"))
        if batch_id:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{path}/v={batch_id - 1}"))
        merged = new.groupBy("key").agg(F.max_by("value", "log_index").alias("value"), F.sum("version").alias("version"), F.max("log_index").alias("log_index"))
        merged.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        if batch_id > 1:
            fs, at = FileSystem.from_uri(f"{path}/v={batch_id - 2}")
            if fs.get_file_info(at).type == FileType.Directory:
                fs.delete_dir(at)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state_by_bucket(log: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the table of latest_state in buckets of keys: a micro-batch writes only those that it touches.

    Each writes its buckets below rows/v=batch, then a manifest of every bucket's version, which is what readers go by. A
    batch that runs again starts from the manifest before it and overwrites its own, so a lost driver or executor
    leaves the table of the batch before. What neither of the last two manifests names is deleted.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifests = versions(f"{path}/manifest", batch_id)
        held = bucket_versions(spark, path, manifests[-1]) if manifests else {}
        new = batch.groupBy("key").agg(F.max_by("value", "log_index").alias("value"), F.count("*").alias("version"), F.max("log_index").alias("log_index"))
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # as many as there are buckets
        if old := [f"{path}/rows/v={held[b]}/bucket={b}" for b in touched if b in held]:
            new = new.unionByName(spark.read.parquet(*old))
        merged = new.groupBy("key").agg(F.max_by("value", "log_index").alias("value"), F.sum("version").alias("version"), F.max("log_index").alias("log_index"))
        merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={batch_id}")
        now = held | {b: batch_id for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, v long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={batch_id}")
        fs, _ = FileSystem.from_uri(path)
        for m in manifests[:-1]:
            before = bucket_versions(spark, path, m)
            for b in (b for b, v in before.items() if v not in (held.get(b), now[b])):
                delete(fs, f"{path}/rows/v={before[b]}/bucket={b}")
            delete(fs, f"{path}/manifest/v={m}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(path: str, below: int | None = None) -> list[int]:
    """The versions that lie in a folder, ascending, below one if given."""
    fs, at = FileSystem.from_uri(path)
    found = [int(f.base_name[2:]) for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.base_name.startswith("v=")]
    return sorted(v for v in found if below is None or v < below)


def bucket_versions(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    return {r["bucket"]: r["v"] for r in spark.read.parquet(f"{path}/manifest/v={version}").collect()}


def delete(fs: FileSystem, path: str) -> None:
    at = FileSystem.from_uri(path)[1]
    if fs.get_file_info(at).type == FileType.Directory:
        fs.delete_dir(at)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table of latest_state_by_bucket as of its last manifest: key, value, version, log_index."""
    last = versions(f"{path}/manifest")
    if not last:
        return spark.createDataFrame([], "key string, value string, version long, log_index long")
    held = bucket_versions(spark, path, last[-1])
    return spark.read.parquet(*(f"{path}/rows/v={v}/bucket={b}" for b, v in held.items()))


def to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet folder, exactly once, until what is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
