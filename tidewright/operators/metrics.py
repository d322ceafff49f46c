"""Counters, rolling rates, placement ranking, event routing and observability views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.fold import ordered_fold
from ..plans.prefix import following, prefixes, running, trailing
from ..plans.ranks import global_rank
from ..sources.tables import SQL_COMMANDS, SQL_EXECUTIONS, SQL_WORKFLOWS, commands, executions, load, workflows

FRESH_US, WINDOW = 30_000_000, 100


def execution_metrics(x: DataFrame, by: list[str], duration: str, failed: Column) -> DataFrame:
    """executed, failed, error_rate, total, average, least and most duration; zero denominators give 0."""
    n, bad = F.count("*"), F.count_if(failed)
    return x.groupBy(*by).agg(
        n.alias("executed"), bad.alias("failed"), F.when(n > 0, F.round(bad / n, 6)).otherwise(0.0).alias("error_rate"), F.round(F.sum(duration), 2).alias("total"),
        F.round(F.avg(duration), 6).alias("average"), F.min(F.when(F.col(duration) > 0, F.col(duration))).alias("least"), F.max(duration).alias("most"),
    )


def cluster_metrics(w: DataFrame) -> DataFrame:
    """status, n; the row with a null status is the total."""
    return w.rollup("status").agg(F.count("*").alias("n"))


def cluster_totals(w: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: all, active, completed and failed workflows and how many nodes have run."""
    status = F.col("status")
    counts = w.agg(F.count("*").alias("total"), F.count_if(status == "running").alias("active"), F.count_if(status == "completed").alias("completed"), F.count_if(status == "failed").alias("failed"))
    return counts.crossJoin(runs.agg(F.count("*").alias("nodes_executed")))  # one row each


def throughput(x: DataFrame, by: list[str], at_us: str, now_us: int) -> DataFrame:
    """executed and per_second: runs by the time since the last of them; 0 without time in between."""
    elapsed = (F.lit(now_us) - F.max(at_us)) / 1e6
    return x.groupBy(*by).agg(F.count("*").alias("executed"), F.when(elapsed > 0, F.round(F.count("*") / elapsed, 9)).otherwise(0.0).alias("per_second"))


def node_summary(shown: DataFrame) -> DataFrame:
    """One row over node_metrics: nodes, available ones, mean response time and error rate of all; none, no mean."""
    return shown.agg(F.count("*").alias("total_nodes"), F.count_if("available").alias("available_nodes"), F.round(F.avg("response_ms"), 6).alias("avg_response_time"), F.round(F.avg("error_rate"), 6).alias("avg_error_rate"))


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """section, metric and value of one-row tables of numbers, as one report."""
    rows = [unpivot(df.select(F.lit(name).alias("section"), *(F.col(c).cast("double").alias(c) for c in df.columns)), "section", df.columns) for name, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def rolling_error_rate(log: DataFrame, key: str, order: str, failed: Column, window: int = WINDOW) -> DataFrame:
    """log with rate, the share of failures among the last outcomes of the key, this one included; order is unique in a key.

    A key's log is cut into stretches that share their last rows with the next one, so a busy key is many tasks.
    """
    rate = lambda over: F.avg(F.col("_failed")).over(over)
    return trailing(log.withColumn("_failed", failed.cast("int")), [key], [order], window, {"rate": rate}).drop("_failed")


def _then(f: Column, g: Column) -> Column:
    """Two smoothing steps in one: x -> a * x + b for a key that has a value, r for one that has none yet; without any value, nothing."""
    both = F.struct(F.lit(True).alias("has"), (f["a"] * g["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), (g["a"] * f["r"] + g["b"]).alias("r"))
    return F.when(~f["has"], g).when(~g["has"], f).otherwise(both)


def ewma(log: DataFrame, key: str, order: str, value: str, keep: float = 0.8) -> DataFrame:
    """key, order and ewma: keep * old + (1 - keep) * new over positive values in order; the first value starts it.

    Others repeat it, and before any it is 0. A row is an affine map of the value before; maps compose, so a key of any
    length is a parallel scan of native expressions. order is unique in a key.
    """
    x = F.col(value)
    step = F.struct(F.coalesce(x > 0, F.lit(False)).alias("has"), F.lit(keep).alias("a"), (F.lit(1 - keep) * x).alias("b"), x.cast("double").alias("r"))
    none = F.struct(F.lit(False).alias("has"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("r"))
    rows = prefixes(log.select(key, order, value).withColumn("_own", step), [key], [order], F.col("_own"), none, _then, "_earlier")
    return rows.select(key, order, _then(F.col("_earlier"), F.col("_own"))["r"].alias("_r"), (F.col("_earlier.has") | F.col("_own.has")).alias("_any")).select(key, order, F.when(F.col("_any"), F.col("_r")).otherwise(0.0).alias("ewma"))


def node_loads(events: DataFrame) -> DataFrame:
    """node_id, log_index, units, latency_ms and error_rate after each lifecycle event (node_id, workflow_id, log_index, kind, duration_ms).

    kind is started, completed or failed. A node has a unit for each workflow that has started there and neither
    completed nor failed since: a start beside a running unit and an end without one change nothing. So an event moves
    the load by +1, 0 or -1 from what its workflow was on that node, and units are a sweep over those points. latency_ms
    is the smoothed duration of completed runs above 0, error_rate the share of failures among the last WINDOW ends.
    All three are shared among tasks by time, so one busy node is not one task. log_index is unique in a node.
    """
    is_on = (F.col("kind") == "started").cast("int")
    of_workflow = Window.partitionBy("node_id", "workflow_id").orderBy("log_index")
    points = events.withColumn("_moved", is_on - F.coalesce(F.lag(is_on).over(of_workflow), F.lit(0)))
    units = running(points, ["node_id"], ["log_index"], {"units": F.col("_moved")}).select("node_id", "log_index", "units")
    took = F.when(F.col("kind") == "completed", F.col("duration_ms"))
    smoothed = ewma(events.select("node_id", "log_index", took.cast("double").alias("took")), "node_id", "log_index", "took").withColumnRenamed("ewma", "latency_ms")
    ends = rolling_error_rate(events.where("kind <> 'started'").select("node_id", "log_index", "kind"), "node_id", "log_index", F.col("kind") == "failed")
    ends = ends.select("node_id", "log_index", "rate")
    # the rate of a start is that of the last end before it
    known = following(events.select("node_id", "log_index").join(ends, ["node_id", "log_index"], "left"), ["node_id"], ["log_index"], "rate", "_known")
    rates = known.select("node_id", "log_index", F.coalesce("_known", F.lit(0.0)).alias("error_rate"))
    return units.join(smoothed, ["node_id", "log_index"]).join(rates, ["node_id", "log_index"])


def current_loads(loads: DataFrame) -> DataFrame:
    """The last load of each node, as placement takes it: node_id, units, weight (the units), latency_ms, error_rate."""
    last = loads.groupBy("node_id").agg(F.max_by(F.struct("units", "latency_ms", "error_rate"), "log_index").alias("l"))
    return last.select("node_id", "l.*", F.col("l.units").cast("double").alias("weight"))


def placement(loads: DataFrame, now_us: int, self_id: int) -> DataFrame:
    """Fresh nodes (and this one) by truncated weight, pressure and id; rank 1 runs the work."""
    fresh = loads.where((F.col("updated_us") >= now_us - FRESH_US) | (F.col("node_id") == self_id))
    ranked = global_rank(fresh.withColumn("_whole", F.col("weight").cast("long")), ["_whole", "pressure", "node_id"], "rank", 1)
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("_whole")


def active(loads: DataFrame, members: DataFrame) -> DataFrame:
    """Loads of nodes that are members (node_id) of the cluster."""
    return loads.join(members.select("node_id").distinct(), "node_id", "left_semi")


def node_metrics(loads: DataFrame) -> DataFrame:
    """What monitoring shows of each load (node_id, units, weight, latency_ms, error_rate, updated_us).

    Without units, a node counts as active by its rounded weight, halves away from zero; without an update it is not available.
    """
    running = F.when((F.col("units") == 0) & (F.col("weight") > 0), F.floor(F.col("weight") + 0.5)).otherwise(F.col("units")).cast("long")
    return loads.select("node_id", running.alias("active"), F.col("weight").alias("pressure"), F.col("latency_ms").alias("response_ms"), "error_rate", (F.col("updated_us") > 0).alias("available"))


def runs_without_view(policy: str) -> Column:
    """Whether a node that has no view of the cluster runs the work."""
    return F.lit(policy != "fail-closed")


def winner(loads: DataFrame, now_us: int, self_id: int) -> DataFrame:
    fresh = loads.where((F.col("updated_us") >= now_us - FRESH_US) | (F.col("node_id") == self_id))
    return fresh.orderBy(F.col("weight").cast("long"), "pressure", "node_id").limit(1)


def load_summary(loads: DataFrame, now_us: int) -> DataFrame:
    fresh = F.col("updated_us") >= now_us - FRESH_US
    return loads.agg(F.count("*").alias("nodes"), F.count_if(fresh).alias("available"), F.round(F.avg(F.when(fresh, F.col("pressure"))), 6).alias("avg_pressure"))


def pressure(cpu: Column, memory: Column) -> Column:
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return clamp(cpu) + clamp(memory)


def dedup(events: DataFrame) -> DataFrame:
    """One of the events with the same key, version, node and time."""
    return events.dropDuplicates(["key", "version", "node_id", "ts_us"])


def route(key: Column) -> Column:
    """(channel, id, node, type) of an event key, null for keys of one segment."""
    parts = F.split(key, ":")
    head, node = parts[0], (F.size(parts) >= 5) & (F.try_element_at(parts, F.lit(3)) == "node")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.when(F.size(parts) >= 2, F.struct(head.alias("channel"), at(2).alias("id"), F.when(node, at(4)).alias("node"), F.when(node, at(5)).otherwise(at(3)).alias("type")))


def matches(key: Column, pattern: Column) -> Column:
    """* matches all, p* a prefix, anything else itself."""
    return F.when(pattern == "*", True).when(pattern.endswith("*"), F.startswith(key, F.regexp_replace(pattern, r"\*$", ""))).otherwise(key == pattern)


def subscribe(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event of each subscription (name, prefix) whose prefix its key has.

    A key is exploded to its prefixes of the lengths that subscriptions have, a handful, and joined once on equality.
    An empty prefix takes all keys.
    """
    lengths = [r[0] for r in subscriptions.where("prefix is not null").select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]  # a handful
    prefixes = F.explode(F.filter(F.array(*(F.when(F.length("key") >= n, F.substring("key", 1, n)) for n in lengths)), lambda p: p.isNotNull())) if lengths else F.lit(None).cast("string")
    return events.withColumn("_prefix", prefixes).join(subscriptions.select("name", F.col("prefix").alias("_prefix")), "_prefix").drop("_prefix")


def deltas(log: DataFrame) -> DataFrame:
    """Status changes: log_index, key, before, after, frequency (1 / seconds since the last command)."""
    w = Window.partitionBy("key").orderBy("log_index")
    gap = (F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6
    out = log.select("key", "log_index", F.lag("status").over(w).alias("before"), F.col("status").alias("after"), F.when(gap > 0, F.round(1 / gap, 6)).alias("frequency"), F.row_number().over(w).alias("version"))
    return out


def write_strategy(version: Column, frequency: Column, size: Column) -> Column:
    """How a state is written: new, fast-changing or small ones at once, large slow ones as deltas."""
    return F.when(version <= 1, "immediate").when(frequency >= 5, "immediate").when(size >= 10 * 1024, "incremental").otherwise("immediate")


def config_diff(desired: DataFrame, running: DataFrame) -> DataFrame:
    """id and what to do: start, stop, restart or keep."""
    both = desired.withColumnRenamed("config", "want").join(running.withColumnRenamed("config", "have"), "id", "full")
    return both.select("id", F.when(F.col("have").isNull(), "start").when(F.col("want").isNull(), "stop").when(F.col("want") != F.col("have"), "restart").otherwise("keep").alias("action"))


def unpivot(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a metric, as text exporters list them."""
    return wide.unpivot(key, columns, "metric", "value")


def _token_bucket(rate: float, burst: int):
    def start():
        return {"tokens": float(burst), "at": None}

    def step(state: dict, row: dict) -> dict:
        if state["at"] is not None:
            state["tokens"] = min(state["tokens"] + (row["ts_us"] - state["at"]) / 1e6 * rate, float(burst))
        state["at"] = row["ts_us"]
        allowed = state["tokens"] >= row["n"]
        if allowed:
            state["tokens"] -= row["n"]
        return {"log_index": row["log_index"], "allowed": allowed, "tokens": state["tokens"]}

    return start, step


def token_bucket(log: DataFrame, rate: float, burst: int) -> DataFrame:
    """allowed and tokens left for each request (key, log_index, ts_us, n); buckets start full and refill with time."""
    start, step = _token_bucket(rate, burst)
    return ordered_fold(log.select("key", "log_index", "ts_us", "n"), "key", ["log_index"], start, step, "log_index long, allowed boolean, tokens double")


def breaker(log: DataFrame, failures: int = 5, successes: int = 1, interval_us: int = 10_000_000, most_half_open: int = 1) -> DataFrame:
    """state and allowed for each call (key, log_index, ts_us, ok): closed, open after failures in a row, half-open after
    the interval, closed again after successes in a row there."""

    def start():
        return {"state": "closed", "bad": 0, "good": 0, "retry": 0, "tried": 0}

    def step(s: dict, row: dict) -> dict:
        if s["state"] == "open" and row["ts_us"] > s["retry"]:
            s.update(state="half-open", tried=0, bad=0)
        allowed = s["state"] == "closed" or (s["state"] == "half-open" and s["tried"] < most_half_open)
        if allowed:
            s["tried"] += s["state"] == "half-open"
            if row["ok"]:
                s.update(bad=0, good=s["good"] + 1)
                if s["state"] == "half-open" and s["good"] >= successes:
                    s.update(state="closed", tried=0, bad=0)
            else:
                s.update(bad=s["bad"] + 1, good=0)
                if s["state"] == "half-open" or s["bad"] >= failures:
                    s.update(state="open", retry=row["ts_us"] + interval_us, good=0, tried=0)
        return {"log_index": row["log_index"], "allowed": allowed, "state": s["state"]}

    return ordered_fold(log.select("key", "log_index", "ts_us", "ok"), "key", ["log_index"], start, step, "log_index long, allowed boolean, state string")


NOW_US = 1706659200000000


def _loads(s, d):
    return load(s, d, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_acctbal") / 1000).alias("weight"), F.round(F.abs(F.col("s_acctbal")) % 1, 2).alias("pressure"), (F.lit(NOW_US) - F.col("s_nationkey") * 2_000_000).alias("updated_us"))


_LOADS = f"n AS (SELECT s_suppkey AS node_id, s_acctbal / 1000 AS weight, round(abs(s_acctbal) % 1, 2) AS pressure, {NOW_US} - s_nationkey * 2000000 AS updated_us FROM supplier)"


def _status_log(s, d):
    return commands(s, d).select(F.col("user_id").cast("string").alias("key"), "log_index", "ts_us", F.col("kind").alias("status"))


def _events(s, d):
    c = commands(s, d).select("key", "log_index", "ts_us", (F.col("user_id") % 5).alias("node_id"), F.col("log_index").alias("version"))
    return c.unionAll(c.where("log_index % 3 = 0"))


def _subscriptions(s):
    return s.createDataFrame([("ones", "workflow:1"), ("nines", "workflow:9"), ("all", "workflow:"), ("none", "node:")], "name string, prefix string")


def _requests(s, d):
    return commands(s, d).select(F.col("user_id").cast("string").alias("key"), "log_index", "ts_us", (F.col("log_index") % 3 + 1).alias("n"))


def _calls(s, d):
    return commands(s, d).select(F.col("user_id").cast("string").alias("key"), "log_index", "ts_us", (F.col("value") < 40).alias("ok"))


_RATE, _BURST = 1 / 4096, 3  # a power of two, so both engines round alike

def _node_events(s, d):
    """Keys of five segments, of three, and of one."""
    n = F.col("log_index")
    key = F.when(n % 3 == 0, F.concat(F.lit("workflow:"), F.col("user_id").cast("string"), F.lit(":node:"), "kind", F.lit(":started"))).when(n % 7 == 0, F.col("kind")).otherwise(F.col("key"))
    return commands(s, d).select("log_index", key.alias("key"))


def _lifecycle(s, d):
    """Runs of 97 nodes: node_started and started begin one, completions end it, errors fail it."""
    kind = F.when(F.col("kind").isin("started", "node_started"), "started").when(F.col("kind") == "node_error", "failed").otherwise("completed")
    return commands(s, d).select((F.col("user_id") % 97).alias("node_id"), F.col("user_id").alias("workflow_id"), "log_index", kind.alias("kind"), F.col("value").alias("duration_ms"))


_LOAD = f"""WITH RECURSIVE {SQL_COMMANDS}, l AS (SELECT user_id % 97 AS node_id, user_id AS workflow_id, log_index, value, CASE WHEN kind IN ('started', 'node_started') THEN 1 ELSE 0 END AS is_on,
  CASE WHEN kind IN ('node_completed', 'completed') AND value > 0 THEN value END AS took, CASE WHEN kind = 'node_error' THEN 1.0 WHEN kind IN ('node_completed', 'completed') THEN 0.0 END AS bad FROM c),
p AS (SELECT *, is_on - coalesce(lag(is_on) OVER (PARTITION BY node_id, workflow_id ORDER BY log_index), 0) AS moved, count(bad) OVER (PARTITION BY node_id ORDER BY log_index) AS ends, row_number() OVER (PARTITION BY node_id ORDER BY log_index) AS k FROM l),
e AS (SELECT node_id, ends, avg(bad) OVER (PARTITION BY node_id ORDER BY log_index ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rate FROM p WHERE bad IS NOT NULL),
u AS (SELECT p.*, CAST(sum(moved) OVER (PARTITION BY node_id ORDER BY log_index) AS BIGINT) AS units FROM p),
f AS (SELECT node_id, k, coalesce(took, 0.0)::DOUBLE AS v FROM p WHERE k = 1 UNION ALL SELECT p.node_id, p.k, CASE WHEN took IS NULL THEN f.v WHEN f.v = 0 THEN took ELSE 0.8::DOUBLE * f.v + 0.2::DOUBLE * took END FROM f JOIN p ON p.node_id = f.node_id AND p.k = f.k + 1)"""


def _node_loads(s, d):
    return _loads(s, d).select("node_id", F.when(F.col("node_id") % 3 == 0, 0).otherwise(F.col("node_id") % 4).cast("long").alias("units"), "weight", (F.col("node_id") % 50).alias("latency_ms"), F.col("pressure").alias("error_rate"), F.when(F.col("node_id") % 5 > 0, F.col("updated_us")).otherwise(0).alias("updated_us"))


def _report(s, d):
    runs = executions(s, d)
    engine = runs.agg(F.count("*").alias("nodes_executed"), F.count_if(F.startswith("node_name", F.lit("R"))).alias("nodes_failed"), F.round(F.sum("duration"), 2).alias("total_duration"))
    queue = runs.agg(F.count_if(F.col("node_name").isin("AF", "AO")).alias("size"), F.count_if(F.startswith("node_name", F.lit("R"))).alias("dead_letter_size"))
    return sections({"engine": engine, "cluster": cluster_totals(workflows(s, d), runs), "queue": queue, "load": node_summary(node_metrics(_node_loads(s, d)))})


_SHOWN = "(SELECT count(*) AS total_nodes, count(*) FILTER (node_id % 5 > 0) AS available_nodes, round(avg(node_id % 50), 6) AS avg_response_time, round(avg(pressure), 6) AS avg_error_rate FROM n)"
QUERIES = {
    "ag_cluster_totals": lambda s, d: cluster_totals(workflows(s, d), executions(s, d)),
    "ag_throughput": lambda s, d: throughput(executions(s, d), ["node_name"], "due_us", NOW_US),
    "lb_node_summary": lambda s, d: node_summary(node_metrics(_node_loads(s, d))),
    "ob_report": _report,
    "ev_route_nodes": lambda s, d: _node_events(s, d).select("log_index", route(F.col("key")).alias("r")).where("r is not null").select("log_index", "r.*"),
    "lb_active": lambda s, d: active(_loads(s, d), load(s, d, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("node_id"))).select("node_id", "weight"),
    "lb_node_metrics": lambda s, d: node_metrics(_node_loads(s, d)),
    "lb_failure_policy": lambda s, d: _loads(s, d).select("node_id", *(runs_without_view(p).alias(p.replace("-", "_")) for p in ("fail-open", "fail-closed"))),
    "ag_metrics": lambda s, d: execution_metrics(executions(s, d), ["node_name"], "duration", F.col("node_name").startswith("R")),
    "ag_cluster": lambda s, d: cluster_metrics(workflows(s, d)),
    "ag_error_rate_100": lambda s, d: rolling_error_rate(_status_log(s, d), "key", "log_index", F.col("status") == "node_error").select("key", "log_index", F.round("rate", 6).alias("rate")),
    "ag_ewma": lambda s, d: ewma(commands(s, d).select("key", "log_index", "value"), "key", "log_index", "value").select("key", "log_index", F.round("ewma", 4).alias("ewma")),
    "lb_node_load": lambda s, d: node_loads(_lifecycle(s, d)).select("node_id", "log_index", "units", F.round("latency_ms", 4).alias("latency_ms"), F.round("error_rate", 6).alias("error_rate")),
    "lb_current_load": lambda s, d: current_loads(node_loads(_lifecycle(s, d))).select("node_id", "units", "weight"),
    "lb_winner": lambda s, d: winner(_loads(s, d), NOW_US, 3).select("node_id"),
    "lb_rank": lambda s, d: placement(_loads(s, d), NOW_US, 3).select("node_id", "rank"),
    "lb_fresh_peers": lambda s, d: _loads(s, d).where(F.col("updated_us") >= NOW_US - FRESH_US).select("node_id", "updated_us"),
    "lb_summary": lambda s, d: load_summary(_loads(s, d), NOW_US),
    "lb_pressure": lambda s, d: _loads(s, d).select("node_id", F.round(pressure(F.col("weight") / 10, F.col("pressure") * 2), 4).alias("pressure")),
    "ev_dedup": lambda s, d: dedup(_events(s, d)),
    "ev_route": lambda s, d: commands(s, d).select("log_index", route(F.col("key")).alias("r")).select("log_index", "r.*"),
    "ev_subscribe": lambda s, d: subscribe(commands(s, d).select("key", "log_index"), _subscriptions(s)),
    "ev_match": lambda s, d: commands(s, d).select("log_index", matches(F.col("key"), F.when(F.col("log_index") % 3 == 0, "*").when(F.col("log_index") % 3 == 1, "workflow:1*").otherwise("workflow:7:started")).alias("hit")),
    "state_delta": lambda s, d: deltas(_status_log(s, d)).where("before is distinct from after").select("key", "log_index", "before", "after"),
    "state_frequency": lambda s, d: deltas(_status_log(s, d)).select("key", "log_index", "frequency"),
    "state_strategy": lambda s, d: deltas(_status_log(s, d)).select("key", "log_index", write_strategy(F.col("version"), F.coalesce("frequency", F.lit(0.0)), F.col("log_index") % 20_000).alias("strategy")),
    "cn_config_diff": lambda s, d: config_diff(load(s, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4).alias("config")), load(s, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("config"))),
    "ob_prometheus_long": lambda s, d: unpivot(workflows(s, d).groupBy("status").agg(F.count("*").alias("workflows"), F.sum("priority").alias("priorities")), "status", ["workflows", "priorities"]),
    "rl_token_bucket": lambda s, d: token_bucket(_requests(s, d), _RATE, _BURST).select("key", "log_index", "allowed"),
    "rl_metrics": lambda s, d: token_bucket(_requests(s, d), _RATE, _BURST).groupBy("key").agg(F.count("*").alias("total"), F.count_if("allowed").alias("allowed_n"), F.count_if(~F.col("allowed")).alias("denied_n")),
    "cb_states": lambda s, d: breaker(_calls(s, d), 2, 1, 600_000_000).select("key", "log_index", "allowed", "state"),
}
_STATUS = f"WITH {SQL_COMMANDS}, l AS (SELECT CAST(user_id AS VARCHAR) AS key, log_index, ts_us, kind AS status, lag(kind) OVER w AS before, (ts_us - lag(ts_us) OVER w) / 1e6 AS gap, row_number() OVER w AS version FROM c WINDOW w AS (PARTITION BY user_id ORDER BY log_index))"
_BUCKET = f"""WITH RECURSIVE {SQL_COMMANDS}, l AS (SELECT CAST(user_id AS VARCHAR) AS key, log_index, ts_us, CAST(log_index % 3 + 1 AS DOUBLE) AS n, row_number() OVER (PARTITION BY user_id ORDER BY log_index) AS k FROM c),
f AS (SELECT key, log_index, ts_us, k, {_BURST}.0::DOUBLE >= n AS allowed, CASE WHEN {_BURST}.0::DOUBLE >= n THEN {_BURST}.0::DOUBLE - n ELSE {_BURST}.0::DOUBLE END AS tokens FROM l WHERE k = 1
UNION ALL SELECT key, log_index, ts_us, k, t >= n, CASE WHEN t >= n THEN t - n ELSE t END FROM (SELECT l.*, least(f.tokens + (l.ts_us - f.ts_us)::DOUBLE / 1e6::DOUBLE * (1.0::DOUBLE / 4096), {_BURST}.0::DOUBLE) AS t FROM f JOIN l ON l.key = f.key AND l.k = f.k + 1))"""
_TOTALS = "(SELECT count(*) AS total, count(*) FILTER (status = 'running') AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, (SELECT count(*) FROM lineitem) AS nodes_executed FROM w)"
ORACLES = {
    "ag_cluster_totals": f"WITH {SQL_WORKFLOWS} SELECT * FROM {_TOTALS}",
    "ag_throughput": f"WITH {SQL_EXECUTIONS} SELECT node_name, count(*) AS executed, CASE WHEN {NOW_US} > max(due_us) THEN round(count(*) / (({NOW_US} - max(due_us)) / 1e6), 9) ELSE 0.0 END::DOUBLE AS per_second FROM x GROUP BY 1",
    "lb_node_summary": f"WITH {_LOADS} SELECT * FROM {_SHOWN}",
    "ob_report": f"""WITH {_LOADS}, {SQL_WORKFLOWS}, {SQL_EXECUTIONS}, e AS (SELECT count(*) AS nodes_executed, count(*) FILTER (starts_with(node_name, 'R')) AS nodes_failed, round(sum(duration), 2) AS total_duration FROM x), q AS (SELECT count(*) FILTER (node_name IN ('AF', 'AO')) AS size, count(*) FILTER (starts_with(node_name, 'R')) AS dead_letter_size FROM x)
SELECT section, metric, CAST(value AS DOUBLE) AS value FROM (
SELECT 'engine' AS section, unnest(['nodes_executed', 'nodes_failed', 'total_duration']) AS metric, unnest([nodes_executed, nodes_failed, total_duration]::DOUBLE[]) AS value FROM e
UNION ALL SELECT 'cluster', unnest(['total', 'active', 'completed', 'failed', 'nodes_executed']), unnest([total, active, completed, failed, nodes_executed]::DOUBLE[]) FROM {_TOTALS}
UNION ALL SELECT 'queue', unnest(['size', 'dead_letter_size']), unnest([size, dead_letter_size]::DOUBLE[]) FROM q
UNION ALL SELECT 'load', unnest(['total_nodes', 'available_nodes', 'avg_response_time', 'avg_error_rate']), unnest([total_nodes, available_nodes, avg_response_time, avg_error_rate]::DOUBLE[]) FROM {_SHOWN})""",
    "ev_route_nodes": f"WITH {SQL_COMMANDS} SELECT log_index, 'workflow' AS channel, CAST(user_id AS VARCHAR) AS id, CASE WHEN log_index % 3 = 0 THEN kind END AS node, CASE WHEN log_index % 3 = 0 THEN 'started' ELSE kind END AS type FROM c WHERE log_index % 3 = 0 OR log_index % 7 > 0",
    "lb_active": f"WITH {_LOADS} SELECT node_id, weight FROM n WHERE node_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 1)",
    "lb_node_metrics": f"""WITH {_LOADS}, l AS (SELECT *, CASE WHEN node_id % 3 = 0 THEN 0 ELSE node_id % 4 END AS units FROM n)
SELECT node_id, CAST(CASE WHEN units = 0 AND weight > 0 THEN floor(weight + 0.5) ELSE units END AS BIGINT) AS active, weight AS pressure, node_id % 50 AS response_ms, pressure AS error_rate, node_id % 5 > 0 AS available FROM l""",
    "lb_failure_policy": "SELECT s_suppkey AS node_id, true AS fail_open, false AS fail_closed FROM supplier",
    "ag_metrics": f"WITH {SQL_EXECUTIONS} SELECT node_name, count(*) AS executed, count(*) FILTER (starts_with(node_name, 'R')) AS failed, round(count(*) FILTER (starts_with(node_name, 'R')) / count(*), 6) AS error_rate, round(sum(duration), 2) AS total, round(avg(duration), 6) AS average, min(duration) FILTER (duration > 0) AS least, max(duration) AS most FROM x GROUP BY 1",
    "ag_cluster": f"WITH {SQL_WORKFLOWS} SELECT status, count(*) AS n FROM w GROUP BY ROLLUP (status)",
    "ag_error_rate_100": f"WITH {SQL_COMMANDS} SELECT CAST(user_id AS VARCHAR) AS key, log_index, round(avg(CASE WHEN kind = 'node_error' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY log_index ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS rate FROM c",
    "ag_ewma": f"""WITH RECURSIVE {SQL_COMMANDS}, l AS (SELECT key, log_index, value, row_number() OVER (PARTITION BY key ORDER BY log_index) AS k FROM c),
f AS (SELECT key, log_index, k, CASE WHEN value > 0 THEN value ELSE 0.0::DOUBLE END AS v FROM l WHERE k = 1 UNION ALL SELECT l.key, l.log_index, l.k, CASE WHEN NOT l.value > 0 THEN f.v WHEN f.v = 0 THEN l.value ELSE 0.8::DOUBLE * f.v + 0.2::DOUBLE * l.value END FROM f JOIN l ON l.key = f.key AND l.k = f.k + 1)
SELECT key, log_index, round(v, 4) AS ewma FROM f""",
    "lb_node_load": f"{_LOAD} SELECT node_id, log_index, units, round(v, 4) AS latency_ms, coalesce(round(rate, 6), 0.0)::DOUBLE AS error_rate FROM u JOIN f USING (node_id, k) LEFT JOIN e USING (node_id, ends)",
    "lb_current_load": f"{_LOAD} SELECT node_id, arg_max(units, log_index) AS units, CAST(arg_max(units, log_index) AS DOUBLE) AS weight FROM u GROUP BY node_id",
    "lb_winner": f"WITH {_LOADS} SELECT node_id FROM n WHERE updated_us >= {NOW_US - FRESH_US} OR node_id = 3 ORDER BY trunc(weight), pressure, node_id LIMIT 1",
    "lb_rank": f"WITH {_LOADS} SELECT node_id, CAST(row_number() OVER (ORDER BY trunc(weight), pressure, node_id) AS INT) AS rank FROM n WHERE updated_us >= {NOW_US - FRESH_US} OR node_id = 3",
    "lb_fresh_peers": f"WITH {_LOADS} SELECT node_id, updated_us FROM n WHERE updated_us >= {NOW_US - FRESH_US}",
    "lb_summary": f"WITH {_LOADS} SELECT count(*) AS nodes, count(*) FILTER (updated_us >= {NOW_US - FRESH_US}) AS available, round(avg(pressure) FILTER (updated_us >= {NOW_US - FRESH_US}), 6) AS avg_pressure FROM n",
    "lb_pressure": f"WITH {_LOADS} SELECT node_id, round(least(greatest(weight / 10, 0), 1) + least(greatest(pressure * 2, 0), 1), 4) AS pressure FROM n",
    "ev_dedup": f"WITH {SQL_COMMANDS} SELECT key, log_index, ts_us, user_id % 5 AS node_id, log_index AS version FROM c",
    "ev_route": f"WITH {SQL_COMMANDS} SELECT log_index, 'workflow' AS channel, CAST(user_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS node, kind AS type FROM c",
    "ev_subscribe": f"WITH {SQL_COMMANDS} SELECT key, log_index, name FROM c JOIN (VALUES ('ones', 'workflow:1'), ('nines', 'workflow:9'), ('all', 'workflow:'), ('none', 'node:')) v(name, prefix) ON starts_with(key, prefix)",
    "ev_match": f"WITH {SQL_COMMANDS} SELECT log_index, CASE log_index % 3 WHEN 0 THEN true WHEN 1 THEN starts_with(key, 'workflow:1') ELSE key = 'workflow:7:started' END AS hit FROM c",
    "state_delta": f"{_STATUS} SELECT key, log_index, before, status AS after FROM l WHERE before IS DISTINCT FROM status",
    "state_frequency": f"{_STATUS} SELECT key, log_index, CASE WHEN gap > 0 THEN round(1 / gap, 6) END AS frequency FROM l",
    "state_strategy": f"{_STATUS} SELECT key, log_index, CASE WHEN version <= 1 OR (gap > 0 AND round(1 / gap, 6) >= 5) THEN 'immediate' WHEN log_index % 20000 >= 10240 THEN 'incremental' ELSE 'immediate' END AS strategy FROM l",
    "cn_config_diff": "SELECT id, CASE WHEN have IS NULL THEN 'start' WHEN want IS NULL THEN 'stop' WHEN want <> have THEN 'restart' ELSE 'keep' END AS action FROM (SELECT s_suppkey AS id, s_nationkey % 4 AS want FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS id, s_nationkey % 3 AS have FROM supplier WHERE s_suppkey % 5 <> 0) b USING (id)",
    "ob_prometheus_long": f"WITH {SQL_WORKFLOWS} SELECT status, 'workflows' AS metric, count(*) AS value FROM w GROUP BY 1 UNION ALL SELECT status, 'priorities', CAST(sum(priority) AS BIGINT) FROM w GROUP BY 1",
    "rl_token_bucket": f"{_BUCKET} SELECT key, log_index, allowed FROM f",
    "rl_metrics": f"{_BUCKET} SELECT key, count(*) AS total, count(*) FILTER (allowed) AS allowed_n, count(*) FILTER (NOT allowed) AS denied_n FROM f GROUP BY key",
    "cb_states": f"""WITH RECURSIVE {SQL_COMMANDS}, l AS (SELECT CAST(user_id AS VARCHAR) AS key, log_index, ts_us, value < 40 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY log_index) AS k FROM c),
f AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS log_index, true AS allowed, 'closed' AS state, 0 AS bad, CAST(0 AS BIGINT) AS retry FROM (SELECT DISTINCT key FROM l)
UNION ALL SELECT key, k, log_index, was <> 'open', CASE WHEN was = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN was = 'half-open' OR bad + 1 >= 2 THEN 'open' ELSE 'closed' END,
  CASE WHEN was = 'open' THEN bad WHEN ok THEN 0 ELSE bad + 1 END, CASE WHEN was <> 'open' AND NOT ok AND (was = 'half-open' OR bad + 1 >= 2) THEN ts_us + 600000000 ELSE retry END
FROM (SELECT l.key, l.k, l.log_index, l.ts_us, l.ok, CASE WHEN f.state = 'open' AND l.ts_us > f.retry THEN 'half-open' ELSE f.state END AS was, CASE WHEN f.state = 'open' AND l.ts_us > f.retry THEN 0 ELSE f.bad END AS bad, f.retry FROM f JOIN l ON l.key = f.key AND l.k = f.k + 1))
SELECT key, log_index, allowed, state FROM f WHERE k > 0""",
}
