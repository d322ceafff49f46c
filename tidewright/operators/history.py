"""What a workflow leaves behind: lifecycle events, the archive of completed ones, whole status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import SQL_EXECUTIONS, SQL_WORKFLOWS, executions, workflows
from .queue import _ORDER, _items, enqueue

MOST_LISTED = 1000  # nodes of a section that a status document lists


def lifecycle_events(runs: DataFrame, kind: str = "completed") -> DataFrame:
    """key, version, workflow_id, node_name, last_us, result of node runs (workflow_id, node_name, at_us, result).

    A node that runs again writes the same key: the last run's body stays and the version counts the runs.
    """
    last = runs.groupBy("workflow_id", "node_name").agg(F.count("*").alias("version"), F.max(F.struct("at_us", "result")).alias("last"))
    key = F.concat(F.lit("workflow:"), F.col("workflow_id").cast("string"), F.lit(":node:"), "node_name", F.lit(f":{kind}"))
    return last.select(key.alias("key"), "version", "workflow_id", "node_name", F.col("last.at_us").alias("last_us"), F.col("last.result").alias("result"))


def completed_bodies(runs: DataFrame) -> DataFrame:
    """key, version and body (JSON) of what completed runs leave (workflow_id, node_name, at_us, duration_us, result, next_nodes).

    The body is the last run's: with result, times, an execution id made of the key and time, and the names of the next
    nodes, left out if there are none.
    """
    body = F.to_json(F.struct(F.col("workflow_id").cast("string").alias("workflow_id"), "node_name", "result", F.col("at_us").alias("completed_at_us"), "duration_us", _execution_id().alias("execution_id"), F.when(F.size("next_nodes") > 0, F.col("next_nodes")).alias("next_nodes")))
    return _bodies(runs, body, "completed")


def error_bodies(runs: DataFrame) -> DataFrame:
    """key, version and body (JSON) of what failed runs leave (workflow_id, node_name, at_us, duration_us, error, config, state)."""
    body = F.to_json(F.struct(F.col("workflow_id").cast("string").alias("workflow_id"), "node_name", "error", F.col("at_us").alias("failed_at_us"), "duration_us", _execution_id().alias("execution_id"), "config", F.col("state").alias("current_state"), F.lit(True).alias("recoverable")))
    return _bodies(runs, body, "error")


def _execution_id() -> Column:
    return F.concat_ws("-", F.col("workflow_id").cast("string"), "node_name", F.col("at_us").cast("string"))


def _bodies(runs: DataFrame, body: Column, kind: str) -> DataFrame:
    last = runs.groupBy("workflow_id", "node_name").agg(F.count("*").alias("version"), F.max(F.struct("at_us", body.alias("body"))).alias("last"))
    key = F.concat(F.lit("workflow:"), F.col("workflow_id").cast("string"), F.lit(":node:"), "node_name", F.lit(f":{kind}"))
    return last.select(key.alias("key"), "version", F.col("last.body").alias("body"))


def archive(instances: DataFrame, runs: DataFrame) -> DataFrame:
    """key, workflow_id, completed_us, duration_us and nodes (distinct names, sorted) of completed instances (workflow_id, status, started_us).

    An instance ends with its last run; one without runs ends as it starts.
    """
    done = instances.where("status = 'completed'").select("workflow_id", "started_us")
    ran = runs.groupBy("workflow_id").agg(F.max("at_us").alias("ended_us"), F.array_sort(F.collect_set("node_name")).alias("nodes"))  # as many as there are node types
    out = done.join(ran, "workflow_id", "left").withColumn("completed_us", F.coalesce("ended_us", "started_us"))
    key = F.concat(F.lit("workflow:"), F.col("workflow_id").cast("string"), F.lit(":completed"))
    return out.select(key.alias("key"), "workflow_id", "completed_us", (F.col("completed_us") - F.col("started_us")).alias("duration_us"), F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))


def without_archived(rows: DataFrame, archived: DataFrame) -> DataFrame:
    """Instances, snapshots or runs but those of archived workflows, which are deleted."""
    return rows.join(archived.select("workflow_id"), "workflow_id", "left_anti")


def status_with_archive(instances: DataFrame, archived: DataFrame) -> DataFrame:
    """workflow_id, status, started_us, completed_us: live instances, and archived ones, whose start follows from their duration."""
    live = without_archived(instances, archived).select("workflow_id", "status", "started_us", F.lit(None).cast("long").alias("completed_us"))
    return live.unionByName(archived.select("workflow_id", F.lit("completed").alias("status"), (F.col("completed_us") - F.col("duration_us")).alias("started_us"), "completed_us"))


def names_of_runs(keys: Column) -> Column:
    """The node name in the rest of an execution's key: up to the first underscore, so a name that holds one is cut there."""
    return F.regexp_extract(keys, "^([^_]+)_", 1)


def status_rows(runs: DataFrame, items: DataFrame) -> DataFrame:
    """workflow_id, section, sequence, node_name, at_us and data: every node of every workflow, one row each.

    section is executed for runs (node_name, at_us), executing for claimed items (sequence, node_name, data) and pending
    for ready and blocked ones. This is the whole of what status_documents lists, for workflows of any size.
    """
    done = runs.select("workflow_id", F.lit("executed").alias("section"), F.lit(None).cast("long").alias("sequence"), "node_name", "at_us", F.lit(None).cast("string").alias("data"))
    section = F.when(F.col("tier") == "claimed", "executing").when(F.col("tier").isin("ready", "blocked"), "pending")
    queued = items.select("workflow_id", section.alias("section"), "sequence", "node_name", F.lit(None).cast("long").alias("at_us"), "data").where("section is not null")
    return done.unionByName(queued)


def status_documents(instances: DataFrame, runs: DataFrame, items: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """workflow_id, status, started_us, the executed, executing and pending nodes as arrays of structs and their numbers n_*.

    executed are runs by name and time, executing and pending items by sequence, which is unique. A section lists its
    first ``most`` nodes and counts them all; status_rows has the rest.
    """
    rows = status_rows(runs, items)
    nth = Window.partitionBy("workflow_id", "section").orderBy(F.when(F.col("section") == "executed", F.struct("node_name", "at_us")), "sequence")
    first = rows.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= most)
    of = lambda section, *fields: F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("_nth", *fields))))
    fields = {"executed": ("node_name", "at_us"), "executing": ("sequence", "node_name", "data"), "pending": ("sequence", "node_name", "data")}
    lists = first.groupBy("workflow_id").agg(*(of(s, *f).alias(s) for s, f in fields.items()))
    counts = rows.groupBy("workflow_id").agg(*(F.count_if(F.col("section") == s).alias(f"n_{s}") for s in fields))
    out = instances.join(counts, "workflow_id", "left").join(lists, "workflow_id", "left")
    plain = lambda s, f: F.coalesce(F.transform(s, lambda x: F.struct(*(x[c].alias(c) for c in f))), F.array()).alias(s)
    return out.select("workflow_id", "status", "started_us", *(plain(s, f) for s, f in fields.items()), *(F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in fields))


def _runs(s: SparkSession, d: str) -> DataFrame:
    return executions(s, d).select("workflow_id", "node_name", F.col("due_us").alias("at_us"), F.col("part").alias("result"))


def _queued(s, d):
    """Items numbered anew by their whole row, since those of the tables share sequences."""
    items = enqueue(_items(s, d).drop("sequence").withColumnRenamed("tier", "held"), 1, _ORDER).drop("tier").withColumnRenamed("held", "tier")
    return items.withColumn("node_name", F.regexp_extract("data", '"node":"([^"]*)"', 1))


def _ran(s, d):
    return _runs(s, d).where("node_name in ('AF', 'RF')")


def _documents(s, d, most: int = MOST_LISTED):
    x = status_documents(workflows(s, d), _ran(s, d), _queued(s, d), most)
    lines = lambda c, f: F.concat_ws(";", F.transform(c, f)).alias(c)
    node = lambda n: F.concat_ws(" ", n["sequence"].cast("string"), n["node_name"], n["data"])
    return x.select("workflow_id", "status", "started_us", lines("executed", lambda n: F.concat_ws(" ", n["node_name"], n["at_us"].cast("string"))), lines("executing", node), lines("pending", node), "n_executed", "n_executing", "n_pending")


def _archive(s, d):
    return archive(workflows(s, d), _runs(s, d))


def _names(s, d):
    key = F.concat(F.when(F.col("line") % 2 == 0, "document_").otherwise(""), "node_name", F.lit("_"), F.col("due_us").cast("string"))
    return executions(s, d).select("workflow_id", names_of_runs(key).alias("node")).distinct()


def _bodies_of(s, d):
    x = executions(s, d).select("workflow_id", "node_name", F.col("due_us").alias("at_us"), (F.col("duration") * 1000).cast("long").alias("duration_us"), "part", "line")
    done = x.where(~F.startswith("node_name", F.lit("N"))).withColumns({"result": F.struct("part"), "next_nodes": F.when(F.col("part") % 3 == 0, F.array().cast("array<string>")).when(F.col("part") % 3 == 1, F.array(F.lit("review"))).otherwise(F.array(F.lit("review"), F.lit("archive")))})
    failed = x.where(F.startswith("node_name", F.lit("N"))).withColumns({"error": F.concat(F.lit("part "), F.col("part").cast("string"), F.lit(" is missing")), "config": F.lit(None).cast("string"), "state": F.struct("part")})
    return completed_bodies(done).unionByName(error_bodies(failed))


QUERIES = {
    "ev_bodies": _bodies_of,
    "ev_lifecycle": lambda s, d: lifecycle_events(_runs(s, d)),
    "wf_archive": lambda s, d: _archive(s, d).withColumn("nodes", F.concat_ws(",", "nodes")),
    "wf_archived_status": lambda s, d: status_with_archive(workflows(s, d), _archive(s, d)),
    "wf_delete": lambda s, d: without_archived(_runs(s, d), _archive(s, d)).groupBy("workflow_id").agg(F.count("*").alias("n")),
    "wf_status_document": _documents,
    "wf_status_first": lambda s, d: _documents(s, d, 2),
    "wf_status_rows": lambda s, d: status_rows(_ran(s, d), _queued(s, d)),
    "wf_executed_names": _names,
}
_ARCHIVE = f"""{SQL_EXECUTIONS}, {SQL_WORKFLOWS}, r AS (SELECT l_orderkey AS workflow_id, max(epoch_us(l_shipdate)) AS ended_us, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS nodes FROM lineitem GROUP BY 1),
a AS (SELECT 'workflow:' || w.workflow_id || ':completed' AS key, w.workflow_id, coalesce(ended_us, started_us) AS completed_us, coalesce(ended_us, started_us) - started_us AS duration_us, coalesce(nodes, '') AS nodes FROM w LEFT JOIN r USING (workflow_id) WHERE status = 'completed')"""
_NODES = f"""WITH {SQL_WORKFLOWS}, x AS (SELECT l_orderkey AS workflow_id, l_suppkey AS worker, l_extendedprice AS amount, l_returnflag || l_linestatus AS node_name, '{{"workflow_id":"' || l_orderkey || '","node":"' || l_returnflag || l_linestatus || '"}}' AS data,
  epoch_us(l_shipdate) AS at_us, CAST(l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS VARCHAR) AS claim_id FROM lineitem),
i AS (SELECT *, row_number() OVER (ORDER BY workflow_id, worker, amount, data, at_us, claim_id) AS sequence FROM x),
n AS (SELECT workflow_id, 'executed' AS section, CAST(NULL AS BIGINT) AS sequence, node_name, at_us, CAST(NULL AS VARCHAR) AS data FROM x WHERE node_name IN ('AF', 'RF')
UNION ALL SELECT workflow_id, CASE WHEN node_name IN ('AF', 'AO') THEN 'pending' ELSE 'executing' END, sequence, node_name, NULL, data FROM i WHERE node_name IN ('AF', 'AO') OR starts_with(node_name, 'N'))"""
_DOCUMENT = _NODES.replace("{", "{{").replace("}", "}}") + """, p AS (SELECT *, row_number() OVER (PARTITION BY workflow_id, section ORDER BY CASE WHEN section = 'executed' THEN node_name END, CASE WHEN section = 'executed' THEN at_us END, sequence) AS nth FROM n),
t AS (SELECT workflow_id, nth, section, CASE WHEN section = 'executed' THEN node_name || ' ' || at_us ELSE sequence || ' ' || node_name || ' ' || data END AS line FROM p),
d AS (SELECT workflow_id, string_agg(line, ';' ORDER BY nth) FILTER (section = 'executed' AND nth <= {most}) AS executed, string_agg(line, ';' ORDER BY nth) FILTER (section = 'executing' AND nth <= {most}) AS executing, string_agg(line, ';' ORDER BY nth) FILTER (section = 'pending' AND nth <= {most}) AS pending,
  count(*) FILTER (section = 'executed') AS n_executed, count(*) FILTER (section = 'executing') AS n_executing, count(*) FILTER (section = 'pending') AS n_pending FROM t GROUP BY 1)
SELECT w.workflow_id, status, started_us, coalesce(executed, '') AS executed, coalesce(executing, '') AS executing, coalesce(pending, '') AS pending, coalesce(n_executed, 0) AS n_executed, coalesce(n_executing, 0) AS n_executing, coalesce(n_pending, 0) AS n_pending FROM w LEFT JOIN d USING (workflow_id)"""
ORACLES = {
    "ev_bodies": """WITH x AS (SELECT l_orderkey AS w, l_returnflag || l_linestatus AS node, epoch_us(l_shipdate) AS at_us, CAST(l_quantity * 1000 AS BIGINT) AS took, l_partkey AS part FROM lineitem),
b AS (SELECT *, '{"workflow_id":"' || w || '","node_name":"' || node || CASE WHEN node LIKE 'N%' THEN '","error":"part ' || part || ' is missing","failed_at_us":' || at_us || ',"duration_us":' || took || ',"execution_id":"' || w || '-' || node || '-' || at_us || '","current_state":{"part":' || part || '},"recoverable":true}'
  ELSE '","result":{"part":' || part || '},"completed_at_us":' || at_us || ',"duration_us":' || took || ',"execution_id":"' || w || '-' || node || '-' || at_us || CASE part % 3 WHEN 0 THEN '"}' WHEN 1 THEN '","next_nodes":["review"]}' ELSE '","next_nodes":["review","archive"]}' END END AS body FROM x)
SELECT 'workflow:' || w || ':node:' || node || CASE WHEN node LIKE 'N%' THEN ':error' ELSE ':completed' END AS key, count(*) AS version, arg_max(body, (at_us, body)) AS body FROM b GROUP BY w, node""",
    "ev_lifecycle": "SELECT 'workflow:' || l_orderkey || ':node:' || l_returnflag || l_linestatus || ':completed' AS key, count(*) AS version, l_orderkey AS workflow_id, l_returnflag || l_linestatus AS node_name, max(epoch_us(l_shipdate)) AS last_us, arg_max(l_partkey, (l_shipdate, l_partkey)) AS result FROM lineitem GROUP BY ALL",
    "wf_archive": f"WITH {_ARCHIVE} SELECT * FROM a",
    "wf_archived_status": f"WITH {_ARCHIVE} SELECT workflow_id, 'completed' AS status, completed_us - duration_us AS started_us, completed_us FROM a UNION ALL SELECT workflow_id, status, started_us, NULL FROM w WHERE status <> 'completed'",
    "wf_delete": "SELECT l_orderkey AS workflow_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "wf_status_document": _DOCUMENT.format(most=1 << 30),
    "wf_status_first": _DOCUMENT.format(most=2),
    "wf_status_rows": f"{_NODES} SELECT * FROM n",
    "wf_executed_names": "SELECT DISTINCT l_orderkey AS workflow_id, CASE WHEN l_linenumber % 2 = 0 THEN 'document' ELSE l_returnflag || l_linestatus END AS node FROM lineitem",
}
