"""The work queue as one table of items in tiers, and the lease fold that guards its claims.

Items: sequence, workflow_id, data, tier (ready, blocked, claimed, deadletter), process_after_us, deferrals,
claim_id, claimed_at_us. Every clock and jitter is an argument.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.fold import ordered_fold
from ..plans.ranks import global_rank
from ..sources.connectors import status
from ..sources.tables import SQL_COMMANDS, commands, executions, load

MOST_BYTES, MOST_DEFERRALS, CLAIM_TTL_US, ORPHAN_US = 1 << 20, 10, 300_000_000, 30_000_000


def enqueue(items: DataFrame, first: int = 0, order: tuple[str | Column, ...] = ("workflow_id",), tier: str = "ready") -> DataFrame:
    """Items with a sequence from first on in the given order; those over the size limit are refused (left out), those without data are not.

    The numbering is one global order, so ranges are counted first and numbered from their offsets: no task
    holds all rows.
    """
    fits = items.where(F.coalesce(F.octet_length("data"), F.lit(0)) <= MOST_BYTES)
    return global_rank(fits, list(order), "sequence", first).withColumn("tier", F.lit(tier))


def peek(items: DataFrame) -> DataFrame:
    return items.where("tier = 'ready'").orderBy("sequence").limit(1)


def due(now_us: int) -> Column:
    return (F.col("tier") == "ready") & (F.coalesce("process_after_us", F.lit(0)) <= now_us)


def claim(items: DataFrame, now_us: int, k: int) -> DataFrame:
    """The k first due items, first in first out."""
    return items.where(due(now_us)).orderBy("sequence").limit(k)


def claim_rows(items: DataFrame, now_us: int, k: int, node: str) -> DataFrame:
    """sequence, claim_id, claimed_at_us, owner, expires_us and data of the k first due items that can be decoded.

    Items whose data is no JSON object are passed over and stay ready. The claim's id follows from its item, node and
    time, so a claim that is made again is the same.
    """
    decoded = F.startswith(F.schema_of_variant(F.try_parse_json("data")), F.lit("OBJECT"))
    first = items.where(due(now_us) & F.coalesce(decoded, F.lit(False))).orderBy("sequence", "data").limit(k)
    claim_id = F.sha2(F.concat_ws(":", F.lit(node), F.col("sequence").cast("string"), F.lit(str(now_us))), 256)
    return first.select("sequence", claim_id.alias("claim_id"), F.lit(now_us).cast("long").alias("claimed_at_us"), F.lit(node).alias("owner"), F.lit(now_us + CLAIM_TTL_US).cast("long").alias("expires_us"), "data")


def claim_per_queue(items: DataFrame, queue: str, now_us: int, k: int) -> DataFrame:
    """The k first due items of each queue. Only k rows a queue and task are shuffled."""
    at = F.row_number().over(Window.partitionBy(queue).orderBy("sequence"))
    return items.where(due(now_us)).withColumn("nth", at).where(F.col("nth") <= k)


def complete(items: DataFrame, claim_ids: DataFrame) -> DataFrame:
    """Items without the claimed ones whose claim_id is given; unknown ids change nothing."""
    return items.join(claim_ids.select("claim_id").distinct().withColumn("tier", F.lit("claimed")), ["claim_id", "tier"], "left_anti")


def release(items: DataFrame, now_us: int, jitter_us: Column) -> DataFrame:
    """Claimed items deferred once more: back to ready with the same sequence, or dead after ten deferrals."""
    times = F.coalesce("deferrals", F.lit(0)) + 1
    dead = times >= MOST_DEFERRALS
    return items.withColumns({
        "tier": F.when(dead, "deadletter").otherwise("ready"), "deferrals": times, "reason": F.when(dead, f"exceeded deferrals ({MOST_DEFERRALS})"),
        "process_after_us": F.when(~dead, F.lit(now_us) + jitter_us),
    })


def expired_claims(items: DataFrame, leases: DataFrame, now_us: int) -> DataFrame:
    """Claimed items to give back: their lease has expired, or they have none and were claimed long ago."""
    held = items.where("tier = 'claimed'").join(leases.select("claim_id", "expires_us"), "claim_id", "left")
    lost = F.when(F.col("expires_us").isNull(), F.col("claimed_at_us") <= now_us - ORPHAN_US).otherwise(F.col("expires_us") <= now_us)
    return held.where(lost)


def size(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(F.col("tier").isin("ready", "blocked")).alias("n"))


def with_text(items: DataFrame, text: str, *tiers: str) -> DataFrame:
    """Items of the tiers whose data holds the text anywhere; has_* are its count above 0."""
    return items.where(F.col("tier").isin(*tiers) & F.col("data").contains(text))


def promote(items: DataFrame) -> DataFrame:
    return items.withColumn("tier", F.when(F.col("tier") == "blocked", "ready").otherwise(F.col("tier")))


def demote(items: DataFrame) -> DataFrame:
    return items.withColumn("tier", F.when(F.col("tier") == "ready", "blocked").otherwise(F.col("tier")))


def extract_workflow_id(data: Column) -> Column:
    """The first "workflow_id":"..." in the text, without unescaping; empty if there is none."""
    return F.regexp_extract(data, '"workflow_id":"([^"]*)"', 1)


def id_of_prefix(prefix: Column) -> Column:
    """The id in a data prefix "workflow_id":"...": up to the next quote, or the rest without one; empty for others."""
    return F.regexp_extract(prefix, '^"workflow_id":"([^"]*)', 1)


def send_to_dead_letters(items: DataFrame, reason: Column, at_us: int, first: int = 1) -> DataFrame:
    """sequence, dead_id, data, reason, retry_count and at_us of items: dead letters are numbered by themselves, in the items' order."""
    rows = global_rank(items.select(F.col("sequence").alias("of_sequence"), "data", reason.alias("reason")), ["of_sequence", "data"], "sequence", first)
    return rows.select("sequence", F.concat(F.lit("dlq-"), F.col("sequence").cast("string"), F.lit(f"-{at_us * 1000}")).alias("dead_id"), "data", "reason", F.lit(0).alias("retry_count"), F.lit(at_us).cast("long").alias("at_us"))


def dead_letters(items: DataFrame, limit: int = 0) -> DataFrame:
    """Dead letters by key order, all of them for a limit of 0."""
    rows = items.where("tier = 'deadletter'").orderBy("sequence")
    return rows.limit(limit) if limit > 0 else rows


def retry_dead_letter(items: DataFrame, chosen: DataFrame, first: int, by: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Dead letters that chosen names by the columns ``by``, back to ready with new sequences in the order of the old ones.

    Where items of several workflows may have one sequence, the workflow belongs in by. Nulls in by name nulls, and
    items without a sequence come last. Those that have one sequence (ties) go by their data.
    """
    names = chosen.select(*(F.col(c).alias(f"_of_{c}") for c in by)).distinct()
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by))
    back = items.where("tier = 'deadletter'").join(names, same, "left_semi")
    return enqueue(back.withColumnRenamed("sequence", "was"), first, (F.col("was").asc_nulls_last(), F.col("data").asc_nulls_last()))


def _lease(state: dict, row: dict) -> dict:
    op, owner, now, ok, error = row["op"], row["owner"], row["ts_us"], True, None
    held = state["owner"] is not None
    if op == "acquire":
        if held and state["owner"] not in ("", owner) and state["expires_us"] > now:
            ok, error = False, "owned by other"
        else:
            state.update(owner=owner, generation=state["generation"] + 1 if held else 1, expires_us=now + row["ttl_us"])
    elif op == "renew":
        if not held:
            ok, error = False, "not found"
        elif state["owner"] != owner:
            ok, error = False, "owned by other"
        else:
            state["expires_us"] = now + row["ttl_us"]
    elif op in ("release", "force_release"):
        if held and op == "release" and state["owner"] != owner:
            ok, error = False, "owned by other"
        elif held:
            state.update(owner=None, generation=0, expires_us=None)
    return {"log_index": row["log_index"], "ok": ok, "error": error, "holder": state["owner"], "generation": state["generation"], "expires_us": state["expires_us"]}


def leases(log: DataFrame) -> DataFrame:
    """The outcome of every lease command (key, log_index, op, owner, ts_us, ttl_us) in order.

    acquire fails only while another owner's lease runs past now; the same owner acquires again and bumps the
    generation. renew needs the owner, not a live lease. release of a missing lease is fine; a released lease
    restarts at generation 1.
    """
    rows = log.select("key", "log_index", "op", "owner", "ts_us", "ttl_us")
    return ordered_fold(rows, "key", ["log_index"], lambda: {"owner": None, "generation": 0, "expires_us": None}, _lease, "log_index long, ok boolean, error string, holder string, generation long, expires_us long")


def latest_leases(log: DataFrame) -> DataFrame:
    return leases(log).groupBy("key").agg(F.max_by(F.struct("holder", "generation", "expires_us"), "log_index").alias("l")).select("key", "l.*").where("holder is not null")


def without_owner(records: DataFrame, owner: str) -> DataFrame:
    """Lease records but those of a node that has failed."""
    return records.where(F.col("holder") != owner)


NOW_US = 915148800000000  # 1999-01-01


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = executions(spark, sf_dir)
    tier = F.when(F.col("node_name") == "AF", "ready").when(F.col("node_name") == "AO", "blocked").when(F.col("node_name").startswith("N"), "claimed").otherwise("deadletter")
    sequence = F.col("workflow_id") * 1_000_000 + F.col("line") * 100_000 + F.col("part")
    data = F.concat(F.lit('{"workflow_id":"'), F.col("workflow_id").cast("string"), F.lit('","node":"'), F.col("node_name"), F.lit('"}'))
    return x.select(
        sequence.alias("sequence"), "workflow_id", data.alias("data"), tier.alias("tier"), F.col("due_us").alias("process_after_us"), F.pmod("part", F.lit(12)).cast("int").alias("deferrals"),
        sequence.cast("string").alias("claim_id"), F.col("due_us").alias("claimed_at_us"), "worker", "amount",
    )


_ITEMS = """i AS (SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS sequence, l_orderkey AS workflow_id, l_returnflag || l_linestatus AS node,
  '{"workflow_id":"' || l_orderkey || '","node":"' || l_returnflag || l_linestatus || '"}' AS data,
  CASE WHEN l_returnflag || l_linestatus = 'AF' THEN 'ready' WHEN l_returnflag || l_linestatus = 'AO' THEN 'blocked' WHEN l_returnflag = 'N' THEN 'claimed' ELSE 'deadletter' END AS tier,
  epoch_us(l_shipdate) AS process_after_us, CAST(l_partkey % 12 AS INT) AS deferrals, l_suppkey AS worker FROM lineitem)"""


def _lease_log(spark, sf):
    c = commands(spark, sf)
    op = F.when(F.col("kind").isin("started", "node_started"), "acquire").when(F.col("kind") == "node_completed", "renew").when(F.col("kind") == "completed", "release").otherwise("force_release")
    return c.select(F.col("user_id").cast("string").alias("key"), "log_index", op.alias("op"), F.concat(F.lit("n"), (F.col("log_index") % 3).cast("string")).alias("owner"), "ts_us", F.lit(3_600_000_000).alias("ttl_us"))


def _claimed_leases(spark, sf):
    return _items(spark, sf).where("tier = 'claimed' and sequence % 2 = 0").select("claim_id", (F.col("claimed_at_us") + CLAIM_TTL_US).alias("expires_us")).groupBy("claim_id").agg(F.max("expires_us").alias("expires_us"))


_LEASE_FOLD = f"""WITH RECURSIVE {SQL_COMMANDS}, l AS (SELECT CAST(user_id AS VARCHAR) AS key, log_index, ts_us, 'n' || (log_index % 3) AS owner,
  CASE WHEN kind IN ('started', 'node_started') THEN 'acquire' WHEN kind = 'node_completed' THEN 'renew' WHEN kind = 'completed' THEN 'release' ELSE 'force_release' END AS op,
  row_number() OVER (PARTITION BY user_id ORDER BY log_index) AS n FROM c),
f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS log_index, true AS ok, CAST(NULL AS VARCHAR) AS holder, CAST(0 AS BIGINT) AS generation, CAST(NULL AS BIGINT) AS expires_us FROM (SELECT DISTINCT key FROM l)
UNION ALL SELECT key, n, log_index, ok,
  CASE WHEN NOT ok THEN holder WHEN op = 'acquire' THEN owner WHEN op = 'renew' THEN holder ELSE NULL END,
  CASE WHEN NOT ok THEN generation WHEN op = 'acquire' THEN CASE WHEN holder IS NULL THEN 1 ELSE generation + 1 END WHEN op = 'renew' THEN generation ELSE 0 END,
  CASE WHEN NOT ok THEN expires_us WHEN op IN ('acquire', 'renew') THEN ts_us + 3600000000 ELSE NULL END
FROM (SELECT l.key, l.n, l.log_index, l.op, l.owner, l.ts_us, f.holder, f.generation, f.expires_us,
  CASE l.op WHEN 'acquire' THEN f.holder IS NULL OR f.holder = l.owner OR f.expires_us <= l.ts_us WHEN 'renew' THEN f.holder IS NOT NULL AND f.holder = l.owner
    WHEN 'release' THEN f.holder IS NULL OR f.holder = l.owner ELSE true END AS ok FROM f JOIN l ON l.key = f.key AND l.n = f.n + 1))"""

_ORDER = ("workflow_id", "worker", "amount", "data", "process_after_us", "claim_id")


def _enqueued(s, d):
    return enqueue(_items(s, d).drop("sequence", "tier"), 1, _ORDER)


def _retried(s, d):
    items = _items(s, d)
    return retry_dead_letter(items, items.where("tier = 'deadletter' and workflow_id % 3 > 0"), 1_000_000_001, ("workflow_id", "sequence"))


def _connectors(s, d):
    configs = load(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return status(configs, latest_leases(_lease_log(s, d)), 1706659200000000)


def _damaged(s, d):
    """Items of which every third is cut off."""
    return _items(s, d).withColumn("data", F.when(F.col("sequence") % 3 == 0, F.substring("data", 1, 12)).otherwise(F.col("data")))


QUERIES = {
    "queue_claim_rows": lambda s, d: claim_rows(_damaged(s, d), NOW_US, 50, "n1"),
    "cn_status": _connectors,
    "queue_enqueue_rows": lambda s, d: _enqueued(s, d).select("sequence", "workflow_id", "worker", "claim_id", "tier"),
    "queue_dlq_retry": lambda s, d: _retried(s, d).select("sequence", "was", "data", "tier"),
    "queue_dlq_records": lambda s, d: send_to_dead_letters(_items(s, d).where("tier = 'claimed' and deferrals >= 9"), F.concat(F.lit("exceeded deferrals of "), F.col("workflow_id").cast("string")), NOW_US),
    "queue_claimed_text": lambda s, d: with_text(_items(s, d), '"node":"NO"', "claimed").select("sequence", "data"),
    "queue_blocked_text": lambda s, d: with_text(_items(s, d), '"workflow_id":"7', "blocked").select("sequence", "data"),
    "queue_ready_text": lambda s, d: with_text(_items(s, d), '"workflow_id":"7', "ready").select("sequence", "data"),
    "queue_demote": lambda s, d: demote(_items(s, d)).select("sequence", "tier"),
    "queue_blocked_for_workflow": lambda s, d: _items(s, d).where((F.col("tier") == "blocked") & (extract_workflow_id(F.col("data")) == "68")).select("sequence", "data"),
    "queue_claim": lambda s, d: claim(_items(s, d), NOW_US, 20).select("sequence", "workflow_id"),
    "queue_prefix_id": lambda s, d: _items(s, d).select("sequence", id_of_prefix(F.expr("substr(data, 2, 10 + sequence % 12)")).alias("id")),
    "lease_node_cleanup": lambda s, d: without_owner(latest_leases(_lease_log(s, d)), "n1").select("key", "holder"),
    "queue_enqueue": lambda s, d: _enqueued(s, d).agg(F.count("*").alias("n"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count_distinct("sequence").alias("distinct_n")),
    "queue_peek": lambda s, d: peek(_items(s, d)).select("sequence", "workflow_id"),
    "queue_claim_topk": lambda s, d: claim_per_queue(_items(s, d).dropDuplicates(["worker", "sequence"]), "worker", NOW_US, 3).select("worker", "sequence", "nth"),
    "queue_complete": lambda s, d: complete(_items(s, d), _items(s, d).where("tier = 'claimed' and worker % 2 = 0").select("claim_id")).groupBy("tier").agg(F.count("*").alias("n")),
    "queue_release_route": lambda s, d: release(_items(s, d).where("tier = 'claimed'"), NOW_US, F.pmod("sequence", F.lit(150)) * 1000 + 50_000).select("sequence", "tier", "deferrals", "process_after_us", "reason"),
    "queue_expired_claims": lambda s, d: expired_claims(_items(s, d), _claimed_leases(s, d), NOW_US).select("sequence", "claimed_at_us", "expires_us"),
    "queue_size": lambda s, d: size(_items(s, d)),
    "queue_has_items": lambda s, d: with_text(_items(s, d), '"workflow_id":"77', "ready", "blocked").select("sequence", "data"),
    "queue_ready_for_workflow": lambda s, d: _items(s, d).where((F.col("tier") == "ready") & (extract_workflow_id(F.col("data")) == "77")).select("sequence", "data"),
    "queue_promote": lambda s, d: promote(_items(s, d)).groupBy("tier").agg(F.count("*").alias("n")),
    "queue_dlq_size": lambda s, d: dead_letters(_items(s, d)).agg(F.count("*").alias("n")),
    "queue_dlq_top": lambda s, d: dead_letters(_items(s, d).dropDuplicates(["sequence"]), 25).select("sequence"),
    "queue_extract_workflow_id": lambda s, d: _items(s, d).select("sequence", extract_workflow_id(F.col("data")).alias("found")).distinct(),
    "lease_fold": lambda s, d: leases(_lease_log(s, d)).select("key", "log_index", "ok", "holder", "generation", "expires_us"),
    "lease_latest": lambda s, d: latest_leases(_lease_log(s, d)),
}
ORACLES = {
    "queue_claim_rows": f"WITH {_ITEMS} SELECT sequence, sha256('n1:' || sequence || ':{NOW_US}') AS claim_id, CAST({NOW_US} AS BIGINT) AS claimed_at_us, 'n1' AS owner, CAST({NOW_US + CLAIM_TTL_US} AS BIGINT) AS expires_us, data FROM i WHERE tier = 'ready' AND process_after_us <= {NOW_US} AND sequence % 3 > 0 ORDER BY sequence, data LIMIT 50",
    "cn_status": f"{_LEASE_FOLD}, h AS (SELECT key, holder FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1 AND holder IS NOT NULL AND expires_us > 1706659200000000) SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, holder AS owner, holder IS NOT NULL AS active FROM nation LEFT JOIN h ON key = CAST(n_nationkey AS VARCHAR)",
    "queue_enqueue_rows": """WITH x AS (SELECT l_orderkey AS workflow_id, l_suppkey AS worker, l_extendedprice AS amount, '{"workflow_id":"' || l_orderkey || '","node":"' || l_returnflag || l_linestatus || '"}' AS data, epoch_us(l_shipdate) AS at_us,
  CAST(l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS VARCHAR) AS claim_id FROM lineitem)
SELECT row_number() OVER (ORDER BY workflow_id, worker, amount, data, at_us, claim_id) AS sequence, workflow_id, worker, claim_id, 'ready' AS tier FROM x""",
    "queue_dlq_retry": f"WITH {_ITEMS} SELECT row_number() OVER (ORDER BY sequence) + 1000000000 AS sequence, sequence AS was, data, 'ready' AS tier FROM i WHERE tier = 'deadletter' AND workflow_id % 3 > 0",
    "queue_dlq_records": f"WITH {_ITEMS}, d AS (SELECT row_number() OVER (ORDER BY sequence, data) AS n, data, 'exceeded deferrals of ' || workflow_id AS reason FROM i WHERE tier = 'claimed' AND deferrals >= 9) SELECT n AS sequence, 'dlq-' || n || '-{NOW_US * 1000}' AS dead_id, data, reason, 0 AS retry_count, CAST({NOW_US} AS BIGINT) AS at_us FROM d",
    "queue_claimed_text": f"WITH {_ITEMS} SELECT sequence, data FROM i WHERE tier = 'claimed' AND node = 'NO'",
    "queue_blocked_text": f"WITH {_ITEMS} SELECT sequence, data FROM i WHERE tier = 'blocked' AND starts_with(CAST(workflow_id AS VARCHAR), '7')",
    "queue_ready_text": f"WITH {_ITEMS} SELECT sequence, data FROM i WHERE tier = 'ready' AND starts_with(CAST(workflow_id AS VARCHAR), '7')",
    "queue_demote": f"WITH {_ITEMS} SELECT sequence, CASE tier WHEN 'ready' THEN 'blocked' ELSE tier END AS tier FROM i",
    "queue_blocked_for_workflow": f"WITH {_ITEMS} SELECT sequence, data FROM i WHERE tier = 'blocked' AND workflow_id = 68",
    "queue_claim": f"WITH {_ITEMS} SELECT sequence, workflow_id FROM i WHERE tier = 'ready' AND process_after_us <= {NOW_US} ORDER BY sequence LIMIT 20",
    "queue_prefix_id": f"WITH {_ITEMS} SELECT sequence, CASE WHEN 10 + sequence % 12 < 15 THEN '' ELSE substr(CAST(workflow_id AS VARCHAR), 1, CAST(sequence % 12 - 5 AS INT)) END AS id FROM i",
    "lease_node_cleanup": f"{_LEASE_FOLD} SELECT key, holder FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1 AND holder IS NOT NULL AND holder <> 'n1'",
    "queue_enqueue": "SELECT count(*) AS n, CAST(1 AS BIGINT) AS first, count(*) AS last, count(*) AS distinct_n FROM lineitem",
    "queue_peek": f"WITH {_ITEMS} SELECT sequence, workflow_id FROM i WHERE tier = 'ready' ORDER BY sequence LIMIT 1",
    "queue_claim_topk": f"WITH {_ITEMS} SELECT worker, sequence, CAST(n AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY sequence) AS n FROM (SELECT DISTINCT ON (worker, sequence) * FROM i) WHERE tier = 'ready' AND process_after_us <= {NOW_US}) WHERE n <= 3",
    "queue_complete": f"WITH {_ITEMS} SELECT tier, count(*) AS n FROM i WHERE NOT (tier = 'claimed' AND sequence IN (SELECT sequence FROM i WHERE tier = 'claimed' AND worker % 2 = 0)) GROUP BY tier",
    "queue_release_route": f"""WITH {_ITEMS} SELECT sequence, CASE WHEN deferrals + 1 >= 10 THEN 'deadletter' ELSE 'ready' END AS tier, CAST(deferrals + 1 AS INT) AS deferrals,
CASE WHEN deferrals + 1 < 10 THEN {NOW_US} + sequence % 150 * 1000 + 50000 END AS process_after_us, CASE WHEN deferrals + 1 >= 10 THEN 'exceeded deferrals (10)' END AS reason FROM i WHERE tier = 'claimed'""",
    "queue_expired_claims": f"""WITH {_ITEMS}, l AS (SELECT sequence, max(process_after_us) + {CLAIM_TTL_US} AS expires_us FROM i WHERE tier = 'claimed' AND sequence % 2 = 0 GROUP BY sequence)
SELECT sequence, process_after_us AS claimed_at_us, expires_us FROM i LEFT JOIN l USING (sequence) WHERE tier = 'claimed' AND CASE WHEN expires_us IS NULL THEN process_after_us <= {NOW_US - ORPHAN_US} ELSE expires_us <= {NOW_US} END""",
    "queue_size": f"WITH {_ITEMS} SELECT count(*) AS n FROM i WHERE tier IN ('ready', 'blocked')",
    "queue_has_items": f"WITH {_ITEMS} SELECT sequence, data FROM i WHERE tier IN ('ready', 'blocked') AND contains(data, '\"workflow_id\":\"77')",
    "queue_ready_for_workflow": f"WITH {_ITEMS} SELECT sequence, data FROM i WHERE tier = 'ready' AND workflow_id = 77",
    "queue_promote": f"WITH {_ITEMS} SELECT CASE tier WHEN 'blocked' THEN 'ready' ELSE tier END AS tier, count(*) AS n FROM i GROUP BY ALL",
    "queue_dlq_size": f"WITH {_ITEMS} SELECT count(*) AS n FROM i WHERE tier = 'deadletter'",
    "queue_dlq_top": f"WITH {_ITEMS} SELECT DISTINCT sequence FROM i WHERE tier = 'deadletter' ORDER BY sequence LIMIT 25",
    "queue_extract_workflow_id": f"WITH {_ITEMS} SELECT DISTINCT sequence, CAST(workflow_id AS VARCHAR) AS found FROM i",
    "lease_fold": f"{_LEASE_FOLD} SELECT key, log_index, ok, holder, generation, expires_us FROM f WHERE n > 0",
    "lease_latest": f"{_LEASE_FOLD} SELECT key, holder, generation, expires_us FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1 AND holder IS NOT NULL",
}
