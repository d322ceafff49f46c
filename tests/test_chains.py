"""Chains of bases and deltas against a replay of the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import chains


def replay(rows, at):
    """key -> (last change, state) of a log up to a sequence."""
    out = {}
    for key, n, op, field, value in sorted(rows, key=lambda r: r[1]):
        if n > at:
            break
        state = out.setdefault(key, [n, {}])
        state[0] = n
        if op == "delete":
            state[1] = {}
        elif op == "set" and field is not None:
            state[1] = {**state[1], field: value}
        elif op == "unset":
            state[1] = {k: v for k, v in state[1].items() if k != field}
    return {k: (n, s) for k, (n, s) in out.items() if s}


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    rows = []
    for n in range(3000):
        key = rng.choice(["hot"] * 8 + [f"k{i}" for i in range(20)] + [None])
        rows.append((key, n, rng.choices(["set", "unset", "delete", "odd", None], [80, 12, 3, 1, 1])[0], rng.choice(["a", "b", "c", "d", None]), rng.choice([None, "", str(n)])))
    return spark.createDataFrame(rows, "key string, log_index long, op string, field string, value string").repartition(4), rows


def states(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["as_of"], {})[r["key"]] = (r["sequence"], r["state"])
    return out


@pytest.mark.parametrize("batch,most", [(1, 50), (1, 7), (40, 3), (3000, 5)])
def test_states_as_of_any_sequence(log, batch, most):
    df, rows = log
    chain = chains.chain(chains.deltas(df, F.floor(F.col("log_index") / batch)), most)
    chain = chain.sparkSession.createDataFrame(chain.collect(), chains.CHAIN)
    ends = sorted({max(n for _, n, *_ in rows if n // batch == b) for b in {0, 5 // batch, 777 // batch, 1500 // batch, 2999 // batch}})
    got = states(chains.resolve(chain, ends))
    for at in ends:
        want = replay(rows, at)
        assert {k: s for k, (_, s) in got.get(at, {}).items()} == {k: s for k, (_, s) in want.items()}
        assert {k: n for k, (n, _) in got.get(at, {}).items()} == {k: n for k, (n, _) in want.items()}
    most_rows = chain.groupBy("key", "segment").count().agg(F.max("count")).first()[0]
    assert most_rows <= most + 1
    links = {(r["key"], r["sequence"]) for r in chain.collect()}
    assert all(r["based_on_sequence"] is None or (r["key"], r["based_on_sequence"]) in links for r in chain.collect())
    asked = chain.sparkSession.createDataFrame([("hot", ends[0]), ("k3", ends[-1]), (None, ends[-1]), ("nowhere", 5)], "key string, as_of long")
    assert states(chains.resolve(chain, asked)) == {a: x for a in {ends[0], ends[-1]} if (x := {k: v for k, v in replay(rows, a).items() if (k, a) in {("hot", ends[0]), ("k3", ends[-1]), (None, ends[-1])}})}


def test_compaction_changes_no_answer(log):
    df, rows = log
    chain = chains.chain(chains.deltas(df, F.col("log_index")), 10)
    before, later = 1234, [1234, 1300, 2000, 2999]
    small = chains.compact(chain, before)
    assert small.count() < chain.count() and small.where(F.col("sequence") < before).where("kind = 'delta'").isEmpty()
    want = {at: replay(rows, at) for at in later}
    assert states(chains.resolve(small, later)) == want
    for most in (3, 40):
        assert states(chains.resolve(chains.shorten(small, most), later)) == want
    twice = chains.compact(small, 2000)
    assert states(chains.resolve(twice, later[2:])) == {at: want[at] for at in later[2:]}


def test_empty(spark, log):
    none = log[0].limit(0)
    chain = chains.chain(chains.deltas(none, F.col("log_index")))
    assert chain.collect() == [] == chains.resolve(chain, [5]).collect() == chains.compact(chain, 3).collect()
