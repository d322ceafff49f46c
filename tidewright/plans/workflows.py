"""Workflow instances over queue items and executions: triggers, completion, status documents, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import SQL_COMMANDS, SQL_WORKFLOWS, commands, executions, workflows
from ..operators.queue import _ITEMS, _items
from .prefix import prefixes
from .ranks import global_rank


def process_triggers(triggers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances, work items) of triggers (workflow_id, initial_nodes, initial_state, at_us): the last trigger of an id wins, each one's nodes are enqueued."""
    instances = triggers.groupBy("workflow_id").agg(F.max_by("initial_state", "at_us").alias("state"), F.max("at_us").alias("started_us")).withColumns({"status": F.lit("running"), "version": F.lit(0)})
    items = triggers.select("workflow_id", "at_us", F.posexplode("initial_nodes").alias("nth", "node_name")).withColumns({"retry_count": F.lit(0), "deferrals": F.lit(0)})
    return instances, items


def next_items(results: DataFrame, first: int) -> DataFrame:
    """The work items that results ask for: sequence, workflow_id, node_name, config, process_after_us and data.

    results: workflow_id, node_name, at_us and next, an array of (node_name, config, delay_us). Each entry becomes an
    item that is due after its delay, none being at once; sequences go on from ``first`` in the order of the results,
    then of their entries. A null or empty array asks for nothing; entries of one result that are equal are items each.
    """
    asked = results.select("workflow_id", F.col("node_name").alias("after"), "at_us", F.posexplode("next").alias("nth", "_next"))
    items = asked.select("workflow_id", "after", "at_us", "nth", F.col("_next.node_name").alias("node_name"), F.col("_next.config").alias("config"), (F.col("at_us") + F.coalesce("_next.delay_us", F.lit(0))).alias("process_after_us"))
    data = F.to_json(F.struct(F.col("workflow_id").cast("string").alias("workflow_id"), F.col("node_name").alias("node"), "config"))
    return global_rank(items.withColumn("data", data), ["at_us", "workflow_id", "after", "nth", "node_name", "config", "process_after_us"], "sequence", first)


def completed(instances: DataFrame, items: DataFrame) -> DataFrame:
    """Instances without an open item (ready, blocked or claimed)."""
    open_ = items.where(F.col("tier").isin("ready", "blocked", "claimed")).select("workflow_id").distinct()
    return instances.join(open_, "workflow_id", "left_anti")


def status_documents(instances: DataFrame, items: DataFrame) -> DataFrame:
    """workflow_id, status, executed, executing and pending: one aggregate of the items, one join."""
    tier = F.col("tier")
    counts = items.groupBy("workflow_id").agg(F.count_if(tier == "deadletter").alias("executed"), F.count_if(tier == "claimed").alias("executing"), F.count_if(tier.isin("ready", "blocked")).alias("pending"))
    out = instances.join(counts, "workflow_id", "left")
    return out.select("workflow_id", "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("executed", "executing", "pending")))


def executed_nodes(items: DataFrame) -> DataFrame:
    """workflow_id, nodes: distinct node names, sorted; a workflow has as many as there are node types."""
    return items.groupBy("workflow_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("node_name"))).alias("nodes"))


# The states of a workflow (none before its first transition), and where each operation leads from each.
STATES = (None, "running", "paused", "failed", "completed")
MOVES = {"start": (1, 1, 1, 1, 1), "pause": (0, 2, 2, 3, 4), "resume": (0, 1, 1, 3, 4), "stop": (3, 3, 3, 3, 3), "complete": (4, 4, 4, 4, 4)}


def transitions(log: DataFrame) -> DataFrame:
    """workflow_id, log_index, ok and status after every transition (workflow_id, log_index, op).

    pause needs running, resume paused, the others always hold; what does not hold, and an unknown op, changes nothing.
    A transition is a map over the five states, and maps compose, so the log of one workflow is shared among tasks.
    log_index is unique in a workflow.
    """
    to = lambda m: F.array(*(F.lit(x) for x in m))
    same = to(range(len(STATES)))
    step = F.coalesce(F.create_map(*(x for op, m in MOVES.items() for x in (F.lit(op), to(m))))[F.col("op")], same)
    then = lambda f, g: F.transform(f, lambda x: F.element_at(g, x + 1))
    rows = prefixes(log.select("workflow_id", "log_index", "op"), ["workflow_id"], ["log_index"], step, same, then, "_earlier")
    was = F.element_at("_earlier", 1)
    now = F.element_at(F.array(*(F.lit(x) for x in STATES)), F.element_at(step, was + 1) + 1)
    ok = F.when(F.col("op") == "pause", was == STATES.index("running")).when(F.col("op") == "resume", was == STATES.index("paused")).otherwise(F.col("op").isin(*MOVES))
    return rows.select("workflow_id", "log_index", F.coalesce(ok, F.lit(False)).alias("ok"), now.alias("status"))


def retry_route(items: DataFrame, most: int = 3) -> DataFrame:
    """Failed items to the dead letters after most retries, else back with the next delay."""
    from ..functions.scalars import backoff_seconds

    dead = F.col("retry_count") >= most
    return items.withColumns({"tier": F.when(dead, "deadletter").otherwise("ready"), "reason": F.when(dead, "max_retries_exceeded"), "delay_s": F.when(~dead, backoff_seconds(F.col("retry_count"))), "next_retry": F.least("retry_count", F.lit(20)) + 1})


def _named(s, d):
    return _items(s, d).withColumn("node_name", F.regexp_extract("data", '"node":"([^"]*)"', 1))


def _log(s, d):
    c = commands(s, d)
    op = F.when(F.col("kind") == "started", "start").when(F.col("kind") == "node_started", "pause").when(F.col("kind") == "node_completed", "resume").when(F.col("kind") == "completed", "complete").otherwise("stop")
    return c.select(F.col("user_id").alias("workflow_id"), "log_index", op.alias("op"))


def _triggers(s, d):
    w = workflows(s, d)
    nodes = F.when(F.col("priority") <= 2, F.array(F.lit("ingest"), F.lit("urgent"))).otherwise(F.array(F.lit("ingest")))
    return w.select((F.col("workflow_id") % 5000).alias("workflow_id"), nodes.alias("initial_nodes"), F.concat(F.lit('{"o":'), F.col("workflow_id").cast("string"), F.lit("}")).alias("initial_state"), (F.col("started_us") + F.col("workflow_id")).alias("at_us"))


def _results(s, d):
    """Every third run asks for nothing, every third for one node at once, the others for two, of which one waits."""
    x = executions(s, d)
    entry = lambda name, config, delay: F.struct(F.lit(name).alias("node_name"), config.alias("config"), delay.cast("long").alias("delay_us"))
    config = F.concat(F.lit("part "), F.col("part").cast("string"))
    one, two = entry("review", config, F.lit(None)), entry("archive", F.lit(None).cast("string"), F.col("line") * 1_000_000)
    return x.select("workflow_id", "node_name", F.col("due_us").alias("at_us"), F.when(F.col("part") % 3 == 1, F.array(one)).when(F.col("part") % 3 == 2, F.array(one, two)).alias("next"))


def _next(s, d):
    last = _items(s, d).agg(F.max("sequence")).first()[0] or 0
    return next_items(_results(s, d), last + 1).select("sequence", "workflow_id", "node_name", "config", "process_after_us", "data")


QUERIES = {
    "wf_next_items": _next,
    "wf_trigger": lambda s, d: process_triggers(_triggers(s, d))[0],
    "wf_initial_items": lambda s, d: process_triggers(_triggers(s, d))[1].groupBy("node_name").agg(F.count("*").alias("n"), F.count_distinct("workflow_id").alias("workflows")),
    "wf_completion": lambda s, d: completed(workflows(s, d), _items(s, d)).select("workflow_id"),
    "workflow_status": lambda s, d: status_documents(workflows(s, d), _items(s, d)),
    "wf_executed_nodes": lambda s, d: executed_nodes(_named(s, d)),
    "wf_pause_resume": lambda s, d: transitions(_log(s, d)),
    "wf_retry_route": lambda s, d: retry_route(_items(s, d).select("sequence", (F.col("deferrals") % 6).alias("retry_count"))),
}
ORACLES = {
    "wf_next_items": f"""WITH {_ITEMS}, r AS (SELECT l_orderkey AS workflow_id, l_returnflag || l_linestatus AS after, epoch_us(l_shipdate) AS at_us, l_linenumber AS line, l_partkey AS part FROM lineitem),
e AS (SELECT workflow_id, after, at_us, 0 AS nth, 'review' AS node_name, 'part ' || part AS config, at_us AS process_after_us FROM r WHERE part % 3 > 0 UNION ALL SELECT workflow_id, after, at_us, 1, 'archive', NULL, at_us + line * 1000000 FROM r WHERE part % 3 = 2)
SELECT (SELECT max(sequence) FROM i) + row_number() OVER (ORDER BY at_us, workflow_id, after, nth, node_name, config, process_after_us) AS sequence, workflow_id, node_name, config, process_after_us,
  '{{"workflow_id":"' || workflow_id || '","node":"' || node_name || CASE WHEN config IS NULL THEN '"}}' ELSE '","config":"' || config || '"}}' END AS data FROM e""",
    "wf_trigger": f"WITH {SQL_WORKFLOWS}, t AS (SELECT workflow_id % 5000 AS id, workflow_id, started_us + workflow_id AS at_us FROM w) SELECT id AS workflow_id, '{{\"o\":' || arg_max(workflow_id, at_us) || '}}' AS state, max(at_us) AS started_us, 'running' AS status, 0 AS version FROM t GROUP BY id",
    "wf_initial_items": f"WITH {SQL_WORKFLOWS} SELECT node_name, count(*) AS n, count(DISTINCT workflow_id % 5000) AS workflows FROM (SELECT workflow_id, unnest(CASE WHEN priority <= 2 THEN ['ingest', 'urgent'] ELSE ['ingest'] END) AS node_name FROM w) GROUP BY 1",
    "wf_completion": f"WITH {_ITEMS}, {SQL_WORKFLOWS} SELECT workflow_id FROM w WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.workflow_id = w.workflow_id AND tier <> 'deadletter')",
    "workflow_status": f"WITH {_ITEMS}, {SQL_WORKFLOWS} SELECT w.workflow_id, any_value(w.status) AS status, count(*) FILTER (tier = 'deadletter') AS executed, count(*) FILTER (tier = 'claimed') AS executing, count(*) FILTER (tier IN ('ready', 'blocked')) AS pending FROM w LEFT JOIN i USING (workflow_id) GROUP BY w.workflow_id",
    "wf_executed_nodes": "SELECT l_orderkey AS workflow_id, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS nodes FROM lineitem GROUP BY 1",
    "wf_pause_resume": f"""WITH RECURSIVE {SQL_COMMANDS}, l AS (SELECT user_id AS workflow_id, log_index, kind, row_number() OVER (PARTITION BY user_id ORDER BY log_index) AS k FROM c),
f AS (SELECT workflow_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS log_index, true AS ok, CAST(NULL AS VARCHAR) AS status FROM (SELECT DISTINCT workflow_id FROM l)
UNION ALL SELECT l.workflow_id, l.k, l.log_index, CASE kind WHEN 'node_started' THEN coalesce(f.status = 'running', false) WHEN 'node_completed' THEN coalesce(f.status = 'paused', false) ELSE true END,
  CASE kind WHEN 'started' THEN 'running' WHEN 'completed' THEN 'completed' WHEN 'node_error' THEN 'failed' WHEN 'node_started' THEN CASE WHEN f.status = 'running' THEN 'paused' ELSE f.status END ELSE CASE WHEN f.status = 'paused' THEN 'running' ELSE f.status END END
FROM f JOIN l ON l.workflow_id = f.workflow_id AND l.k = f.k + 1) SELECT workflow_id, log_index, ok, status FROM f WHERE k > 0""",
    "wf_retry_route": f"WITH {_ITEMS} SELECT sequence, CAST(r AS INT) AS retry_count, CASE WHEN r >= 3 THEN 'deadletter' ELSE 'ready' END AS tier, CASE WHEN r >= 3 THEN 'max_retries_exceeded' END AS reason, CASE WHEN r < 3 THEN pow(2.0, r)::DOUBLE END AS delay_s, CAST(r + 1 AS INT) AS next_retry FROM (SELECT sequence, deferrals % 6 AS r FROM i)",
}
