"""Deadlines that pass: keys with a time to live, leases and claims, as one operator over logs.

A row (key, log_index, ts_us, deadline_us) sets the key's deadline, null clears it. A deadline lapses if no row of its
key comes up to it. The streaming jobs give the same rows from timers, as the watermark moves on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import SQL_COMMANDS, commands
from .kv import _versioned
from .queue import _LEASE_FOLD, CLAIM_TTL_US, ORPHAN_US, _lease_log, leases


def lapses(rows: DataFrame, until_us: int) -> DataFrame:
    """key, set_at (log_index), lapsed_us of every deadline that lapsed before until_us; rows after until_us are not seen yet."""
    seen = rows.where(F.col("ts_us") <= until_us)
    following = F.lead("ts_us").over(Window.partitionBy("key").orderBy("ts_us", "log_index"))
    kept = seen.withColumn("_following", following).where((F.col("deadline_us") < until_us) & (F.col("_following").isNull() | (F.col("_following") > F.col("deadline_us"))))
    return kept.select("key", F.col("log_index").alias("set_at"), F.col("deadline_us").alias("lapsed_us"))


def key_deadlines(log: DataFrame) -> DataFrame:
    """Puts with a time to live (key, log_index, op, ts_us, ttl_seconds) set the deadline; as in replay, others keep it."""
    return log.where("op = 'put' and ttl_seconds > 0").select("key", "log_index", "ts_us", (F.col("ts_us") + F.col("ttl_seconds").cast("long") * 1_000_000).alias("deadline_us"))


def lease_deadlines(log: DataFrame) -> DataFrame:
    """What a log of lease commands (see queue.leases) grants and extends, and where releases end it; refused commands set nothing."""
    granted = leases(log).where("ok").select(F.col("key").alias("_key"), F.col("log_index").alias("_index"), "expires_us")
    both = log.join(granted, F.col("key").eqNullSafe(F.col("_key")) & (F.col("log_index") == F.col("_index")))
    return both.select("key", "log_index", "ts_us", F.col("expires_us").alias("deadline_us"))


def claim_deadlines(log: DataFrame, ttl_us: int = CLAIM_TTL_US, orphan_us: int = ORPHAN_US) -> DataFrame:
    """Claims (key, log_index, op, ts_us): claim with a lease of ttl_us, claim_bare without, orphaned after orphan_us; anything else ends it."""
    lives = F.when(F.col("op") == "claim", ttl_us).when(F.col("op") == "claim_bare", orphan_us)
    return log.select("key", "log_index", "ts_us", (F.col("ts_us") + lives).alias("deadline_us"))


NOW_US = 1706659200000000 - 3 * 86_400_000_000
_HOUR = 3600


def _key_log(s: SparkSession, d: str) -> DataFrame:
    return _versioned(s, d, _HOUR).select("key", "log_index", "op", "ts_us", "ttl_seconds")


def _claim_log(s: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("kind") == "node_started", "claim").when(F.col("kind") == "started", "claim_bare").when(F.col("kind") == "node_error", "release").otherwise("complete")
    return commands(s, d).select(F.concat(F.lit("claim:"), F.col("user_id").cast("string")).alias("key"), "log_index", op.alias("op"), "ts_us")


QUERIES = {
    "kv_lapses": lambda s, d: lapses(key_deadlines(_key_log(s, d)), NOW_US),
    "lease_lapses": lambda s, d: lapses(lease_deadlines(_lease_log(s, d)), NOW_US),
    "queue_claim_lapses": lambda s, d: lapses(claim_deadlines(_claim_log(s, d)), NOW_US),
}
_LAPSES = f"""n AS (SELECT *, lead(ts_us) OVER (PARTITION BY key ORDER BY ts_us, log_index) AS following FROM r WHERE ts_us <= {NOW_US})
SELECT key, log_index AS set_at, deadline_us AS lapsed_us FROM n WHERE deadline_us < {NOW_US} AND coalesce(following > deadline_us, true)"""
ORACLES = {
    "kv_lapses": f"WITH {SQL_COMMANDS}, r AS (SELECT 'workflow:' || user_id AS key, log_index, ts_us, ts_us + {_HOUR * 1_000_000} AS deadline_us FROM c WHERE kind = 'completed'), {_LAPSES}",
    "lease_lapses": f"{_LEASE_FOLD}, r AS (SELECT f.key, f.log_index, l.ts_us, f.expires_us AS deadline_us FROM f JOIN l ON l.key = f.key AND l.n = f.n WHERE f.n > 0 AND f.ok), {_LAPSES}",
    "queue_claim_lapses": f"WITH {SQL_COMMANDS}, r AS (SELECT 'claim:' || user_id AS key, log_index, ts_us, CASE kind WHEN 'node_started' THEN ts_us + {CLAIM_TTL_US} WHEN 'started' THEN ts_us + {ORPHAN_US} END AS deadline_us FROM c), {_LAPSES}",
}
