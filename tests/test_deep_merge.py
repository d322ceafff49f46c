"""Deep merges by rows of nodes against the merge of two values, one after the other."""

import json
import random

from tidewright.plans import deep_merge, merge

# (current, results, merged)
CASES = [
    ('{"name": "John", "age": 30}', '{"age": 31, "city": "NYC"}', '{"age":31,"city":"NYC","name":"John"}'),
    ('{"user": {"name": "John", "age": 30}, "count": 5}', '{"user": {"age": 31, "email": "j@e.com"}, "status": "active"}', '{"count":5,"status":"active","user":{"age":31,"email":"j@e.com","name":"John"}}'),
    ("[1, 2, 3]", "[4, 5, 6]", "[1,2,3,4,5,6]"), ('["a", "b"]', "[1, 2]", '["a","b",1,2]'), ("[]", "[1, 2]", "[1,2]"), ('[{"id": 1}]', '[{"id": 3}]', '[{"id":1},{"id":3}]'),
    ('{"a": [1]}', '{"a": {"b": 2}}', '{"a":{"b":2}}'), ('{"a": {"b": 2}}', '{"a": [1]}', '{"a":[1]}'), ('{"a": 1}', "[1]", "[1]"), ('"x"', '{"a": null}', '{"a":null}'), ('{"a": 1}', "null", "null"), ("", '{"a": 1}', '{"a":1}'), ('{"a": 1}', None, '{"a":1}'), ("{}", "{}", "{}"),
    ('{"a/b": {"~": 1}}', '{"a/b": {"~1": 2}, "a": {"b": 3}}', '{"a":{"b":3},"a/b":{"~":1,"~1":2}}'), ('{"é\\"": [true]}', '{"é\\"": [false, ""]}', '{"é\\"":[true,false,""]}'),
]


def test_pairs(spark):
    rows = [(k, n, s) for k, (a, b, _) in enumerate(CASES) for n, s in enumerate((a, b))]
    got = {r["k"]: r["s"] for r in deep_merge.merge_states(spark.createDataFrame(rows, "k long, n long, s string"), "k", "n", "s").collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)}


def value(rng, depth):
    r = rng.random()
    if depth and r < 0.5:
        return {rng.choice("abcd"): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [rng.randint(0, 9) for _ in range(rng.randint(0, 3))] if r < 0.75 else rng.choice([1, "x", None, True, -2.5])


def test_folds_equal_one_merge_after_another(spark):
    rng = random.Random(12)
    rows = [(k, n, rng.choice([json.dumps(value(rng, 4)), json.dumps(value(rng, 4)), "", None])) for k in [*range(60), None] for n in range(rng.randint(1, 9))]
    want = {}
    for k, _, s in rows:
        want[k] = merge.merge_texts(want.get(k), merge.merge_texts(s, None))
    got = deep_merge.merge_states(spark.createDataFrame(rows, "k long, n long, s string").repartition(3), "k", "n", "s")
    assert {r["k"]: json.loads(r["s"]) for r in got.collect()} == {k: json.loads(s) for k, s in want.items() if s}
    assert deep_merge.merge_states(spark.createDataFrame([], "k long, n long, s string"), "k", "n", "s").collect() == []
