"""Subscriptions by the hundred thousand, typed parameters, sorted state by few files, follow-up items."""

import random

import duckdb
from pyspark.sql import functions as F

from tidewright.operators import kv, subscriptions
from tidewright.plans import workflows
from tidewright.sources import sorted_state


def test_a_hundred_thousand_patterns(spark, tmp_path):
    rng = random.Random(6)
    path = lambda: ":".join(rng.choice("abcdé") * rng.randint(1, 3) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 4)))
    keys = [(k, path()) for k in range(3000)] + [(3000 + k, "hot:1") for k in range(500)] + [(9999, None), (9998, "")]
    patterns = [(f"s{k}", path() + rng.choice(["*", "*", ""]) if k % 20_000 else "*") for k in range(100_000)] + [("none", None), ("hot", "hot:1"), ("hot2", "ho*"), ("hot3", "hot:1*"), ("hot4", "hot:1:*"), ("empty", "")]
    events, subs = spark.createDataFrame(keys, "n long, key string"), spark.createDataFrame(patterns, "name string, pattern string")
    events.write.parquet(str(tmp_path / "e"))
    subs.write.parquet(str(tmp_path / "s"))
    want = duckdb.sql(f"""with e as (select * from '{tmp_path}/e/*.parquet'), k as (select distinct key from e), s as (select * from '{tmp_path}/s/*.parquet'),
      m as (select key, name from k join s on suffix(pattern, '*') and starts_with(key, left(pattern, length(pattern) - 1)) union all select key, name from k join s on pattern = key and not suffix(pattern, '*'))
      select n, name from m join e using (key)""").fetchall()
    got = subscriptions.subscribe(spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "s"))).select("n", "name").collect()
    assert len(got) == len(want) > 3000 and set(map(tuple, got)) == set(want)
    assert subscriptions.subscribe(events, subs.limit(0)).collect() == [] == subscriptions.subscribe(events.limit(0), subs).collect()


def test_typed_parameters(spark):
    rows = [("a", '{"n": 5, "s": "x"}'), ("a", '{"n": "5"}'), ("a", '{"n": 5.5}'), ("a", "{}"), ("a", '{"n": null}'), ("b", '{"x": 1, "f": true}'), ("b", '{"x": 2.5, "f": 1}'), ("c", "{}"), (None, "{}"), ("a", "nope"), ("a", None), ("a", "[5]"), ("a", '"n"')]
    log = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, command string, params string")
    good, bad = subscriptions.typed_commands(log, "command", "params", {"a": {"n": "long", "s": "string"}, "b": {"x": "double", "f": "boolean"}})
    assert sorted((r["i"], r["n"], r["s"]) for r in good["a"].collect()) == [(0, 5, "x"), (3, None, None), (4, None, None)]
    assert [(r["i"], r["x"], r["f"]) for r in good["b"].collect()] == [(5, 1.0, True)]
    assert {r["i"]: r["error"] for r in bad.collect()} == {1: "n is not a long", 2: "n is not a long", 6: "f is not a boolean", 7: "unknown command: c", 8: "unknown command: ", 9: "not a JSON object", 10: "not a JSON object", 11: "not a JSON object", 12: "not a JSON object"}


def test_sorted_state_reads_few_files(spark, tmp_path):
    keys = [f"{a}:{i:04d}" for a in ("queue", "v", "workflow") for i in range(400)] + ["ttl:x", "é:1"]
    state = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, value long").repartition(3)
    table = sorted_state.write_sorted(state, str(tmp_path / "t"), files=12)
    data = [k for k in keys if not k.startswith(("v:", "ttl:"))]
    assert len(table.rows.inputFiles()) == 12
    for prefix in ("workflow:01", "queue:", "v:", "z", "é", "", "workflow:0399"):
        rows = table.list_by_prefix(prefix)
        assert sorted(r["key"] for r in rows.collect()) == sorted(k for k in data if k.startswith(prefix))
        assert table.count_prefix(prefix).first()["n"] == sum(k.startswith(prefix) for k in data)
    assert len(table.list_by_prefix("workflow:01").inputFiles()) <= 3 and len(table.get("queue:0007").inputFiles()) == 1
    for prefix, after in (("queue:", None), ("queue:", "queue:0123"), ("queue:", "queue:0399"), ("workflow:", "a"), ("v:", None), ("", "workflow:0399"), ("ttl", None)):
        want = min((k for k in data if k.startswith(prefix) and (after is None or k > after)), key=lambda k: k.encode(), default=None)
        got = table.get_next(prefix, after)
        assert [r["key"] for r in got.collect()] == ([want] if want else []) and len(got.inputFiles()) <= 1


def test_next_items(spark):
    kinds = "workflow_id long, node_name string, at_us long, next array<struct<node_name:string, config:string, delay_us:long>>"
    rows = [(2, "a", 10, [("x", None, None), ("x", None, None), ("y", "{}", 5)]), (1, "b", 10, None), (1, "a", 7, []), (1, "a", 9, [("z", "c", 0)])]
    out = workflows.next_items(spark.createDataFrame(rows, kinds), 100).orderBy("sequence")
    assert [(r["sequence"], r["workflow_id"], r["node_name"], r["config"], r["process_after_us"]) for r in out.collect()] == [(100, 1, "z", "c", 9), (101, 2, "x", None, 10), (102, 2, "x", None, 10), (103, 2, "y", "{}", 15)]


def test_increments_as_json_numbers(spark):
    deltas = [None, "", "5", "007", "-3", " 4\n", "1.0", "x", "null", "-0", "9223372036854775807", "9223372036854775808", "2"]
    log = spark.createDataFrame([(i, "k", d) for i, d in enumerate(deltas)], "log_index long, key string, delta string")
    got = {r["log_index"]: (r["ok"], r["counter"], r["version"]) for r in kv.increments(log).collect()}
    held, version = 0, 0
    for i, d in enumerate(deltas):
        step = {None: 1, "": 1, "null": 1, "5": 5, "-3": -3, " 4\n": 4, "-0": 0, "9223372036854775807": 2**63 - 1, "2": 2}.get(d)
        if step is not None:
            held, version = (held + step + 2**63) % 2**64 - 2**63, version + 1
        assert got[i] == (step is not None, held, version)


def test_overlapping_patterns_of_a_name_count_once(spark, monkeypatch):
    monkeypatch.setattr(subscriptions, "NAMES", 3)
    monkeypatch.setattr(subscriptions, "ROWS", 20)
    keys = ["a", "ab", "abc", "b", "", "a*", None] * 4 + ["hot"] * 50
    patterns = [("x", "*"), ("x", "a*"), ("x", "ab"), ("y", "a*"), ("y", "ab*"), ("y", "ab"), ("y", "b"), ("y", "b"), (None, "ab*"), (None, "abc"), (None, "a"), ("z", ""), ("z", None), ("w", "a**"), ("v", "abc"), ("v", "ab*")]
    patterns += [(f"n{k}", "h*") for k in range(20)] + [(f"n{k}", "hot") for k in range(30)]
    events, subs = spark.createDataFrame(list(enumerate(keys)), "n long, key string"), spark.createDataFrame(patterns, "name string, pattern string")
    out = subscriptions.subscribe(events, subs)
    takes = lambda k, p: p is not None and (k.startswith(p[:-1]) if p.endswith("*") else k == p)
    want = {(k, n, name) for n, k in enumerate(keys) if k is not None for name, p in patterns if takes(k, p)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and out.columns == ["key", "n", "name"]


def test_the_result_is_not_shuffled(spark):
    keys = spark.createDataFrame([(n, f"k:{n % 50}") for n in range(400)], "n long, key string")
    subs = spark.createDataFrame([(f"s{k}", "*") for k in range(300)], "name string, pattern string")
    plan = subscriptions.subscribe(keys, subs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(_names" in plan and plan.index("Generate explode(_names") < plan.index("Exchange")


def test_customers_of_one_name_count_each(spark, tmp_path):
    # as in the SQL: a row for each subscription, though a name has several or another of its prefixes covers it
    customers = [(0, "a"), (500, "a"), (3, "a"), (30, "a"), (300, "b"), (1, "b"), (1, "b"), (2, "b"), (3, None), (500, None)]
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    events = [(n, user, kind) for n, (user, kind) in enumerate([(1, "signup"), (30, "signup"), (300, "view"), (2, "click"), (2, "error"), (7, "purchase"), (None, "view")])]
    spark.createDataFrame([(n, u, k, 1.0, "{}") for n, u, k in events], "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("customer", "events"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"select key, log_index, name from ({subscriptions.ORACLES['ev_subscribe_many']})").fetchall()
    got = [tuple(r) for r in subscriptions.QUERIES["ev_subscribe_many"](spark, str(tmp_path)).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want) and len(got) > len(set(got)) > 10
