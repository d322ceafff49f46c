"""Ordered work along keys, against one pass over each key; one key with all rows is the work of many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import metrics
from tidewright.plans import prefix, workflows


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    keys = [("hot",)] * 5000 + [("warm",)] * 300 + [(f"k{i}",) for i in range(40)] * 3 + [(None,)] * 7
    rng.shuffle(keys)
    rows = [(k, i, rng.choice([None, -1.0, 0.0, rng.random(), rng.random() * 100])) for i, (k,) in enumerate(keys)]
    return spark.createDataFrame(rows, "key string, n long, value double").repartition(6), rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def tasks_of(df, key):
    """How many partitions hold rows of the key where it is worked on last."""
    return df.where(F.col("key") == key).select(F.spark_partition_id().alias("p")).distinct().count()


def test_running_and_numbered(log):
    df, rows = log
    out = prefix.running(df, ["key"], ["n"], {"total": F.col("value"), "seen": F.lit(1)})
    got = {(r["key"], r["n"]): (r["total"], r["seen"]) for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["key", "n", "value", "total", "seen"]
    for key, mine in by_key(rows).items():
        total = 0.0
        for i, (_, n, v) in enumerate(mine):
            total += v or 0
            assert got[key, n][0] == pytest.approx(total, abs=1e-6) and got[key, n][1] == i + 1
    assert {(r["key"], r["n"]): r["at"] for r in prefix.numbered(df, ["key"], ["n"], "at").collect()} == {k: v[1] - 1 for k, v in got.items()}
    placed = prefix.ordered(df, ["key"], ["n"])
    assert placed.where("key = 'hot'").select(prefix.PART).distinct().count() > 4


@pytest.mark.parametrize("rows,length", [(1, 10), (3, 3), (100, 128), (100, 4096)])
def test_trailing(log, rows, length):
    df, all_rows = log
    out = prefix.trailing(df, ["key"], ["n"], rows, {"most": lambda w: F.max("value").over(w), "seen": lambda w: F.count("*").over(w)}, length)
    got = {(r["key"], r["n"]): (r["most"], r["seen"]) for r in out.collect()}
    assert len(got) == out.count() == len(all_rows)
    for key, mine in by_key(all_rows).items():
        for i, (_, n, _) in enumerate(mine):
            last = mine[max(0, i - rows + 1) : i + 1]
            assert got[key, n] == (max((v for *_, v in last if v is not None), default=None), len(last))


@pytest.mark.parametrize("size", [2, 7, 256])
def test_prefixes_of_maps_that_do_not_commute(log, size):
    df, rows = log
    then = lambda f, g: F.struct((f["a"] * g["a"] % 10007).alias("a"), ((g["a"] * f["b"] + g["b"]) % 10007).alias("b"))
    step = F.struct((F.col("n") % 13 + 1).alias("a"), (F.col("n") % 7).alias("b"))
    unit = F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"))
    out = prefix.prefixes(df, ["key"], ["n"], step, unit, then, "before", size)
    got = {(r["key"], r["n"]): tuple(r["before"]) for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["key", "n", "value", "before"]
    for key, mine in by_key(rows).items():
        a, b = 1, 0
        for _, n, _ in mine:
            assert got[key, n] == (a, b)
            c, d = n % 13 + 1, n % 7
            a, b = a * c % 10007, (c * b + d) % 10007


def test_ewma_and_rates_of_a_hot_key(log):
    df, rows = log
    got = {(r["key"], r["n"]): r["ewma"] for r in metrics.ewma(df, "key", "n", "value").collect()}
    rates = {(r["key"], r["n"]): r["rate"] for r in metrics.rolling_error_rate(df, "key", "n", F.coalesce(F.col("value") > 50, F.lit(False)), 10).collect()}
    for key, mine in by_key(rows).items():
        held = 0.0
        for i, (_, n, v) in enumerate(mine):
            if v is not None and v > 0:
                held = v if held == 0 else 0.8 * held + (1 - 0.8) * v
            last = mine[max(0, i - 9) : i + 1]
            assert got[key, n] == pytest.approx(held, rel=1e-12)
            assert rates[key, n] == pytest.approx(sum((x[2] or 0) > 50 for x in last) / len(last))
    assert "ython" not in metrics.ewma(df, "key", "n", "value")._jdf.queryExecution().executedPlan().toString()


def test_transitions_of_a_hot_workflow(spark):
    rng, ops = random.Random(8), ["start", "pause", "resume", "pause", "resume", "stop", "complete", "nothing", None]
    rows = [(0 if rng.random() < 0.9 else rng.randint(1, 30), i, rng.choice(ops)) for i in range(6000)]
    df = spark.createDataFrame(rows, "workflow_id long, log_index long, op string").repartition(5)
    got = {(r["workflow_id"], r["log_index"]): (r["ok"], r["status"]) for r in workflows.transitions(df).collect()}
    assert len(got) == len(rows)
    for key, mine in by_key(rows).items():
        held = None
        for _, n, op in mine:
            ok = {"pause": held == "running", "resume": held == "paused"}.get(op, op in ("start", "stop", "complete"))
            held = {"start": "running", "pause": "paused", "resume": "running", "stop": "failed", "complete": "completed"}[op] if ok else held
            assert got[key, n] == (ok, held)


def test_loads_of_one_busy_node(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.95 else 1, rng.randint(0, 25), i, rng.choice(["started", "completed", "failed"]), rng.choice([None, 0, 10, 250])) for i in range(4000)]
    df = spark.createDataFrame(rows, "node_id long, workflow_id long, log_index long, kind string, duration_ms long").repartition(5)
    got = {r["log_index"]: (r["units"], r["latency_ms"], r["error_rate"]) for r in metrics.node_loads(df).collect()}
    state = {n: {"on": set(), "latency": 0.0, "ends": []} for n in (0, 1)}
    for node, workflow, i, kind, took in rows:
        s = state[node]
        if kind == "started":
            s["on"].add(workflow)
        else:
            s["on"].discard(workflow)
            s["ends"] = [*s["ends"], kind == "failed"][-100:]
            if kind == "completed" and took:
                s["latency"] = took if s["latency"] == 0 else 0.8 * s["latency"] + (1 - 0.8) * took
        want = (len(s["on"]), s["latency"], sum(s["ends"]) / max(1, len(s["ends"])))
        assert got[i][0] == want[0] and got[i][1:] == pytest.approx(want[1:], rel=1e-9)
    last = {r["node_id"]: r["units"] for r in metrics.current_loads(metrics.node_loads(df)).collect()}
    assert last == {n: len(s["on"]) for n, s in state.items()}


def test_empty(spark, log):
    none = log[0].limit(0)
    assert prefix.numbered(none, ["key"], ["n"], "at").collect() == [] == metrics.ewma(none, "key", "n", "value").collect() == metrics.rolling_error_rate(none, "key", "n", F.lit(True)).collect()
