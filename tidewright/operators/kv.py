"""Replay and query of a versioned command log: what a key-value state machine holds after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.fold import ordered_fold
from ..plans.prefix import running
from ..sources.sorted_state import shared_path, write_sorted
from ..sources.tables import SQL_COMMANDS, commands

HIDDEN = ("v:", "ttl:")


def latest(log: DataFrame) -> DataFrame:
    """key, value, version of a log of unconditional puts (log_index, key, value): the last value, the count of puts."""
    return log.groupBy("key").agg(F.max_by("value", "log_index").alias("value"), F.count("*").alias("version"))


def since_delete(log: DataFrame) -> DataFrame:
    """key, value, version, log_index, expire_at_us and deleted of a log (log_index, key, op, value, ts_us, ttl_seconds).

    value, version (number of puts) and log_index are those since the last delete of the key, deleted says whether
    there was one. A put without a ttl keeps an older expiry, which outlives a delete too. Deletes are aggregated
    first, and then the puts after them, so both combine before they are shuffled.
    """
    deletes = log.where("op = 'delete'").groupBy("key").agg(F.max("log_index").alias("deleted_at"))
    cut = log.join(deletes, "key", "left")
    live = (F.col("op") == "put") & (F.col("log_index") > F.coalesce("deleted_at", F.lit(-1)))
    expiry = F.when((F.col("op") == "put") & (F.col("ttl_seconds") > 0), F.struct("log_index", (F.col("ts_us") + F.col("ttl_seconds").cast("long") * 1_000_000).alias("at")))
    at = F.when(live, F.col("log_index"))
    return cut.groupBy("key").agg(F.max_by("value", at).alias("value"), F.count_if(live).alias("version"), F.max(at).alias("log_index"), F.max(expiry)["at"].alias("expire_at_us"), F.max(F.col("deleted_at").isNotNull()).alias("deleted"))


def replay(log: DataFrame) -> DataFrame:
    """key, value, version, expire_at_us after puts and deletes (log_index, key, op, value, ts_us, ttl_seconds).

    A delete ends the key and the next put restarts at version 1. A put without a ttl keeps an older expiry, which
    outlives a delete too. Keys whose last command is a delete are absent.
    """
    return since_delete(log).where("version > 0").select("key", "value", "version", "expire_at_us")


def expire_at(state: DataFrame, keys: DataFrame, at_us: int, now_us: int) -> DataFrame:
    """state with the expiry of some keys set; a time that is past leaves the key without expiry. Other keys keep theirs."""
    chosen = keys.select("key").distinct().withColumn("_chosen", F.lit(True))
    at = F.lit(at_us if at_us > now_us else None).cast("long")
    return state.join(chosen, "key", "left").withColumn("expire_at_us", F.when(F.col("_chosen"), at).otherwise(F.col("expire_at_us"))).drop("_chosen")


def is_data(key: Column) -> Column:
    """Whether a key is data: shadow rows of versions and expiry are hidden from scans."""
    return ~(key.startswith(HIDDEN[0]) | key.startswith(HIDDEN[1]))


def get(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


def exists(state: DataFrame, key: str) -> DataFrame:
    return get(state, key).agg((F.count("*") > 0).alias("exists"))


def metadata(state: DataFrame) -> DataFrame:
    return state.select("key", "version", F.octet_length("value").alias("size"), "expire_at_us")


def list_by_prefix(state: DataFrame, prefix: str) -> DataFrame:
    return state.where(F.col("key").startswith(prefix) & is_data(F.col("key")))


def count_prefix(state: DataFrame, prefix: str) -> DataFrame:
    return list_by_prefix(state, prefix).agg(F.count("*").alias("n"))


def get_next(state: DataFrame, prefix: str, after: str | None = None) -> DataFrame:
    """The smallest data key under prefix, or the smallest above a cursor."""
    rows = list_by_prefix(state, prefix)
    rows = rows.where(F.col("key") > after) if after is not None else rows
    return rows.orderBy("key").limit(1)


def expired(state: DataFrame, now_us: int) -> DataFrame:
    return state.where(F.col("expire_at_us") < now_us)


def ttl_left(state: DataFrame, now_us: int) -> DataFrame:
    """Microseconds left; 0 without an expiry, negative past it."""
    return state.select("key", F.coalesce(F.col("expire_at_us") - now_us, F.lit(0)).alias("ttl_us"))


def delete_by_prefix(state: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(state without the keys, their number)."""
    return state.where(~F.col("key").startswith(prefix)), count_prefix(state, prefix)


def counters(log: DataFrame) -> DataFrame:
    """log_index, key, counter after each increment (delta); a key of any size is shared among tasks by ranges of log_index."""
    return running(log.select("log_index", "key", "delta"), ["key"], ["log_index"], {"counter": F.col("delta")}).select("log_index", "key", "counter")


def increments(log: DataFrame) -> DataFrame:
    """log_index, key, ok, counter, version, error after each increment of a log (log_index, key, delta as text).

    The delta is a JSON number; no delta, an empty one and the JSON null add 1. One that is no whole number of 64 bits,
    or no JSON (007), is an error and changes nothing. A counter beyond 64 bits goes on from the other end.
    """
    delta = F.trim(F.coalesce("delta", F.lit("")), F.lit(" \t\r\n"))
    number = F.when((F.octet_length(F.coalesce("delta", F.lit(""))) == 0) | (delta == "null"), F.lit(1).cast("long")).when(delta.rlike(r"^-?(0|[1-9][0-9]*)$"), delta.try_cast("long"))
    rows = running(log.select("log_index", "key", number.alias("n")), ["key"], ["log_index"], {"total": F.col("n").cast("decimal(20,0)"), "version": F.col("n").isNotNull().cast("long")})
    ok, half = F.col("n").isNotNull(), F.lit("9223372036854775808").cast("decimal(38,0)")
    wrapped = (F.pmod(F.col("total").cast("decimal(38,0)") + half, F.lit("18446744073709551616").cast("decimal(38,0)")) - half).cast("long")
    return rows.select("log_index", "key", ok.alias("ok"), wrapped.alias("counter"), "version", F.when(~ok, "failed to parse increment value").alias("error"))


def _conditional(state: dict, row: dict) -> dict:
    op, ok, error, alone = row["op"], True, None, not row.get("in_batch")
    if op == "put":
        if alone and row["version"] > 0 and row["version"] != state["version"] + 1:
            ok, error = False, "version mismatch"
    elif op == "cas":
        by_version = alone and row["version"] > 0
        if by_version:
            ok = row["version"] == state["version"]
        elif row["expected"] is not None:
            ok = row["expected"] == state["value"]
        error = None if ok else "version mismatch" if by_version else "value mismatch" if alone else "value mismatch in batch"
    elif op == "delete":
        state.update(value=None, version=0)
        return {"log_index": row["log_index"], "ok": True, "error": None, "version_after": 0, "value_after": None}
    elif op == "delete_if_exists" and not alone:
        if state["version"] == 0:
            ok, error = False, "key not found"
        else:
            state.update(value=None, version=0)
        return {"log_index": row["log_index"], "ok": ok, "error": error, "version_after": state["version"], "value_after": state["value"]}
    else:
        ok, error = False, "unknown command"
    if ok:
        state.update(value=row["value"], version=state["version"] + 1)
    return {"log_index": row["log_index"], "ok": ok, "error": error, "version_after": state["version"], "value_after": state["value"]}


def apply_conditional(log: DataFrame) -> DataFrame:
    """The result row of every command of a log with conditions.

    log: log_index, key, op (put, cas, delete, delete_if_exists), value, expected (strings), version. A put with a
    version needs current + 1, a cas the current one; a cas with an expected value and no version needs that value,
    which on a missing key is null. Rows whose column in_batch (if there is one) is true are operations of a batch:
    they ignore versions, and only there is delete_if_exists known. A failed command changes nothing, whatever others
    of its batch do.
    """
    rows = log.select("key", "log_index", "op", "value", "expected", "version", *(["in_batch"] if "in_batch" in log.columns else []))
    return ordered_fold(rows, "key", ["log_index"], lambda: {"value": None, "version": 0}, _conditional, "log_index long, ok boolean, error string, version_after long, value_after string")


def explode_batch(log: DataFrame) -> DataFrame:
    """Commands with an array of operations as one row an operation, ordered by (log_index, ordinal), in_batch."""
    return log.select("log_index", F.posexplode("batch").alias("ordinal", "item")).select("log_index", "ordinal", "item.*", F.lit(True).alias("in_batch"))


NOW_US = 1706659200000000  # 2024-01-31 00:00:00


def _state(spark, sf):
    return latest(commands(spark, sf))


def _versioned(spark, sf, ttl: int = 86400):
    log = commands(spark, sf).withColumn("op", F.when(F.col("kind") == "node_error", "delete").otherwise("put"))
    return log.withColumn("key", F.concat(F.lit("workflow:"), F.col("user_id").cast("string"))).withColumn("ttl_seconds", F.when(F.col("kind") == "completed", ttl).otherwise(0))


def _replayed(spark, sf):
    return replay(_versioned(spark, sf))


_REPLAY = f"""WITH {SQL_COMMANDS}, k AS (SELECT *, 'workflow:' || user_id AS k, coalesce(max(log_index) FILTER (kind = 'node_error') OVER (PARTITION BY user_id), -1) AS cut FROM c),
r AS (SELECT k AS key, arg_max(value, log_index) FILTER (kind <> 'node_error' AND log_index > cut) AS value, count(*) FILTER (kind <> 'node_error' AND log_index > cut) AS version,
  max(CASE WHEN kind = 'completed' THEN ts_us + 86400000000 END) AS expire_at_us FROM k GROUP BY k)"""


def _conditional_log(spark, sf):
    log = commands(spark, sf)
    return log.select(
        F.col("user_id").cast("string").alias("key"), "log_index", F.when(F.col("kind") == "node_error", "delete").otherwise("put").alias("op"),
        F.col("value").cast("string").alias("value"), F.lit(None).cast("string").alias("expected"), (F.col("log_index") % 3).alias("version"),
    )


def _batch(spark, sf):
    log = commands(spark, sf)
    item = lambda op: F.struct(F.col("user_id").cast("string").alias("key"), F.lit(op).alias("op"), F.col("payload").alias("value"))
    log = log.withColumn("batch", F.when(F.col("kind") == "node_error", F.array(item("delete_if_exists"), item("delete_if_exists"))).otherwise(F.array(item("put"))))
    flat = explode_batch(log).withColumns({"expected": F.lit(None).cast("string"), "version": F.lit(0).cast("long"), "of": F.col("log_index"), "log_index": F.col("log_index") * 10 + F.col("ordinal")})
    return apply_conditional(flat).where("not ok").select("log_index", "key", "error")


def _cas(spark, sf):
    """Puts, compare-and-sets by version and by value, alone (even rows) and as operations of a batch."""
    e, n = commands(spark, sf), F.col("log_index")
    op = F.when(F.col("kind") == "node_error", "delete").when(n % 4 == 0, "put").otherwise("cas")
    log = e.select(
        F.col("user_id").cast("string").alias("key"), n.alias("log_index"), op.alias("op"), (n % 3).cast("string").alias("value"), F.when(n % 4 == 1, ((n + 1) % 3).cast("string")).alias("expected"),
        F.when(n % 4 == 2, n % 5).otherwise(0).cast("long").alias("version"), (n % 2 == 1).alias("in_batch"),
    )
    return apply_conditional(log).select("key", "log_index", "ok", "error", "version_after", "value_after")


_CAS = """WITH RECURSIVE l AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS n, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_id % 4 = 0 THEN 'put' ELSE 'cas' END AS op,
  CAST(event_id % 3 AS VARCHAR) AS value, CASE WHEN event_id % 4 = 1 THEN CAST((event_id + 1) % 3 AS VARCHAR) END AS expected, CASE WHEN event_id % 4 = 2 THEN event_id % 5 ELSE 0 END AS version,
  event_id % 2 = 1 AS batch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS n, true AS ok, CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS v, CAST(NULL AS VARCHAR) AS held FROM (SELECT DISTINCT key FROM l)
UNION ALL SELECT key, k, n, error IS NULL, error, CASE WHEN op = 'delete' THEN 0 WHEN error IS NULL THEN v + 1 ELSE v END, CASE WHEN op = 'delete' THEN NULL WHEN error IS NULL THEN value ELSE held END
FROM (SELECT l.*, f.v, f.held, CASE WHEN l.op <> 'cas' THEN NULL WHEN NOT l.batch AND l.version > 0 THEN CASE WHEN l.version <> f.v THEN 'version mismatch' END
  WHEN l.expected IS NOT NULL AND l.expected IS DISTINCT FROM f.held THEN CASE WHEN l.batch THEN 'value mismatch in batch' ELSE 'value mismatch' END END AS error FROM f JOIN l ON l.key = f.key AND l.k = f.k + 1))
SELECT key, n AS log_index, ok, error, v AS version_after, held AS value_after FROM f WHERE k > 0"""


def _increments(spark, sf):
    n = F.col("log_index")
    delta = F.when(n % 11 == 0, None).when(n % 19 == 0, "").when(n % 23 == 0, "007").when(n % 29 == 0, " 12 ").when(n % 13 == 0, "x1").when(n % 17 == 0, "-3").otherwise((n % 7).cast("string"))
    return increments(commands(spark, sf).select("log_index", F.col("user_id").cast("string").alias("key"), delta.alias("delta")))


def _sorted(spark, sf):
    return write_sorted(_state(spark, sf), shared_path(spark))


QUERIES = {
    "kv_sorted_prefix": lambda s, d: _sorted(s, d).list_by_prefix("workflow:1"),
    "kv_sorted_count": lambda s, d: _sorted(s, d).count_prefix("workflow:1"),
    "kv_sorted_next": lambda s, d: _sorted(s, d).get_next("workflow:", "workflow:2:started").select("key", "version"),
    "kv_latest": lambda s, d: _state(s, d),
    "kv_get": lambda s, d: get(_state(s, d), "workflow:7:started"),
    "kv_exists": lambda s, d: exists(_state(s, d), "workflow:7:started"),
    "kv_version": lambda s, d: _state(s, d).select("key", "version"),
    "kv_version_after_delete": lambda s, d: _replayed(s, d).select("key", "value", "version"),
    "kv_metadata": lambda s, d: metadata(_replayed(s, d).withColumn("value", F.concat(F.lit("v"), F.col("version").cast("string")))),
    "kv_list_prefix": lambda s, d: list_by_prefix(_state(s, d), "workflow:1"),
    "kv_count_prefix": lambda s, d: count_prefix(_state(s, d), "workflow:1"),
    "kv_get_next": lambda s, d: get_next(_state(s, d), "workflow:").select("key", "version"),
    "kv_get_next_after": lambda s, d: get_next(_state(s, d), "workflow:", "workflow:2:started").select("key", "version"),
    "kv_ttl_expired": lambda s, d: expired(_replayed(s, d), NOW_US - 3 * 86_400_000_000).select("key", "expire_at_us"),
    "kv_ttl_left": lambda s, d: ttl_left(_replayed(s, d), NOW_US),
    "kv_delete_prefix": lambda s, d: delete_by_prefix(_state(s, d), "workflow:1")[0].select("key", "version"),
    "kv_counter": lambda s, d: counters(commands(s, d).select("log_index", F.col("user_id").cast("string").alias("key"), (F.col("log_index") % 7).alias("delta"))),
    "kv_increment": _increments,
    "kv_cas": _cas,
    "kv_expire_at": lambda s, d: expire_at(_replayed(s, d), _replayed(s, d).where(F.col("version") >= 3), NOW_US, NOW_US - 1).select("key", "version", "expire_at_us"),
    "kv_delete_prefix_count": lambda s, d: delete_by_prefix(_state(s, d), "workflow:1")[1],
    "kv_conditional_put": lambda s, d: apply_conditional(_conditional_log(s, d)).select("key", "log_index", "ok", "version_after"),
    "kv_batch_partial": _batch,
}
_LATEST = f"WITH {SQL_COMMANDS}, s AS (SELECT key, arg_max(value, log_index) AS value, count(*) AS version FROM c GROUP BY key)"
ORACLES = {
    "kv_sorted_prefix": f"{_LATEST} SELECT * FROM s WHERE starts_with(key, 'workflow:1')",
    "kv_sorted_count": f"{_LATEST} SELECT count(*) AS n FROM s WHERE starts_with(key, 'workflow:1')",
    "kv_sorted_next": f"{_LATEST} SELECT key, version FROM s WHERE key = (SELECT min(key) FROM s WHERE key > 'workflow:2:started')",
    "kv_latest": f"{_LATEST} SELECT * FROM s",
    "kv_get": f"{_LATEST} SELECT * FROM s WHERE key = 'workflow:7:started'",
    "kv_exists": f"{_LATEST} SELECT count(*) > 0 AS \"exists\" FROM s WHERE key = 'workflow:7:started'",
    "kv_version": f"{_LATEST} SELECT key, version FROM s",
    "kv_version_after_delete": f"{_REPLAY} SELECT key, value, version FROM r WHERE version > 0",
    "kv_metadata": f"{_REPLAY} SELECT key, version, CAST(1 + length(CAST(version AS VARCHAR)) AS INT) AS size, expire_at_us FROM r WHERE version > 0",
    "kv_list_prefix": f"{_LATEST} SELECT * FROM s WHERE starts_with(key, 'workflow:1')",
    "kv_count_prefix": f"{_LATEST} SELECT count(*) AS n FROM s WHERE starts_with(key, 'workflow:1')",
    "kv_get_next": f"{_LATEST} SELECT key, version FROM s WHERE key = (SELECT min(key) FROM s)",
    "kv_get_next_after": f"{_LATEST} SELECT key, version FROM s WHERE key = (SELECT min(key) FROM s WHERE key > 'workflow:2:started')",
    "kv_ttl_expired": f"{_REPLAY} SELECT key, expire_at_us FROM r WHERE version > 0 AND expire_at_us < {NOW_US - 3 * 86_400_000_000}",
    "kv_ttl_left": f"{_REPLAY} SELECT key, coalesce(expire_at_us - {NOW_US}, 0) AS ttl_us FROM r WHERE version > 0",
    "kv_delete_prefix": f"{_LATEST} SELECT key, version FROM s WHERE NOT starts_with(key, 'workflow:1')",
    "kv_counter": "SELECT event_id AS log_index, CAST(user_id AS VARCHAR) AS key, CAST(sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS counter FROM events",
    "kv_increment": """WITH l AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 OR event_id % 19 = 0 THEN 1 WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 12 WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -3 ELSE event_id % 7 END AS n FROM events)
SELECT event_id AS log_index, CAST(user_id AS VARCHAR) AS key, n IS NOT NULL AS ok, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS counter, count(n) OVER w AS version,
  CASE WHEN n IS NULL THEN 'failed to parse increment value' END AS error FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "kv_cas": _CAS,
    "kv_expire_at": f"{_REPLAY} SELECT key, version, CASE WHEN version >= 3 THEN {NOW_US} ELSE expire_at_us END AS expire_at_us FROM r WHERE version > 0",
    "kv_delete_prefix_count": f"{_LATEST} SELECT count(*) AS n FROM s WHERE starts_with(key, 'workflow:1')",
    "kv_conditional_put": """WITH RECURSIVE l AS (SELECT user_id, event_id, event_type = 'error' AS del, event_id % 3 AS want, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, del OR want IN (0, 1) AS ok, CASE WHEN del THEN 0 WHEN want IN (0, 1) THEN 1 ELSE 0 END AS v FROM l WHERE n = 1
UNION ALL SELECT l.user_id, l.event_id, l.n, l.del OR l.want = 0 OR l.want = f.v + 1, CASE WHEN l.del THEN 0 WHEN l.want = 0 OR l.want = f.v + 1 THEN f.v + 1 ELSE f.v END FROM f JOIN l ON l.user_id = f.user_id AND l.n = f.n + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS log_index, ok, CAST(v AS BIGINT) AS version_after FROM f""",
    "kv_batch_partial": """WITH l AS (SELECT *, event_type = 'error' AS del, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id * 10 + 1 AS log_index, CAST(user_id AS VARCHAR) AS key, 'key not found' AS error FROM l WHERE del
UNION ALL SELECT event_id * 10, CAST(user_id AS VARCHAR), 'key not found' FROM l WHERE del AND (before IS NULL OR before = 'error')""",
}
