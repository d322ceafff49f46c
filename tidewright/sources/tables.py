"""The driver tables and what they stand for in the workflow model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types as command kinds.
KINDS = {"signup": "started", "view": "node_started", "click": "node_completed", "error": "node_error", "purchase": "completed"}
STATUSES = {"O": "running", "F": "completed", "P": "paused"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(column: Column, mapping: dict[str, str], other: str | None = None) -> Column:
    """mapping as a conditional expression."""
    out = None
    for k, v in mapping.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(F.lit(other))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command log: log_index, key, kind, user_id, value, payload, ts (timestamp), ts_us (microseconds)."""
    e = load(spark, sf_dir, "events")
    kind = choose(F.col("event_type"), KINDS)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("log_index"), F.concat(F.lit("workflow:"), F.col("user_id").cast("string"), F.lit(":"), kind).alias("key"),
        kind.alias("kind"), "user_id", "value", F.col("props").alias("payload"), ts.alias("ts"), F.unix_micros(ts).alias("ts_us"),
    )


def workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, status, priority, started_us."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("workflow_id"), choose(F.col("o_orderstatus"), STATUSES).alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("started_us"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, node_name, line, part, worker, duration, due_us, amount of queue items that have run or will."""
    i = load(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("workflow_id"), F.concat("l_returnflag", "l_linestatus").alias("node_name"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("worker"), F.col("l_quantity").alias("duration"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("due_us"), F.col("l_extendedprice").alias("amount"),
    )


#: The mappings above as DuckDB common table expressions.
SQL_COMMANDS = """c AS (SELECT event_id AS log_index, user_id, value, props AS payload, epoch_us(ts) AS ts_us,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'node_started' WHEN 'click' THEN 'node_completed' WHEN 'error' THEN 'node_error' WHEN 'purchase' THEN 'completed' END AS kind,
  'workflow:' || user_id || ':' || kind AS key FROM events)"""
SQL_WORKFLOWS = """w AS (SELECT o_orderkey AS workflow_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' WHEN 'P' THEN 'paused' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, epoch_us(o_orderdate) AS started_us FROM orders)"""
SQL_EXECUTIONS = """x AS (SELECT l_orderkey AS workflow_id, l_returnflag || l_linestatus AS node_name, l_linenumber AS line, l_partkey AS part, l_suppkey AS worker,
  l_quantity AS duration, epoch_us(l_shipdate) AS due_us, l_extendedprice AS amount FROM lineitem)"""
