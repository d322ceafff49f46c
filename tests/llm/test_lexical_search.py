"""Lexical search over inverted treaps against SQL and a plain version that scores every document."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import lexical_search as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in tf]
    N, L, df = sum(x > 0 for x in n), sum(n), Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        rows = []
        for (doc, c), length in zip(tf, n):
            score = sum(q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * length * N // L))) for t, q in Counter(terms(text)).items() if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, at):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '/root/testdata/{at}/{t}.parquet'")
    out = ls.op11_lexical_search(spark, f"/root/testdata/{at}")
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert got(out) == sorted(repr(r) for r in con.sql(ls.ORACLES["op11_lexical_search"]).select("item_id, rank, doc_id, score").fetchall())


def test_odd_rows(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "word1 word2 WORD2"), (1, "lorem"), (2, None), (3, ""), (None, "one a é 日本語"), (4, "nowhere"), (5, "a " * 40_000)]
    frame = spark.createDataFrame([(*i, "x", 7) for i in items + items[:1]], "item_id long, text string, DOC_ID string, rank int")
    assert got(ls.search(ls.build(odd_docs), frame, 3)) == plain(docs, items, 3)
    assert got(ls.search(ls.build(odd_docs.limit(0)), frame)) == [] == got(ls.search(ls.build(odd_docs), frame.limit(0)))


def test_ties_and_copies(spark):
    docs = [(i % 50 if i % 7 else None, ["same words here", "here words", "other words same same", ""][i % 4]) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(0, "same"), (1, "here same words"), (2, "other")]
    assert got(ls.search(ls.build(frame), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_blocks_of_queries_and_small_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 300)
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in rng.permutation(900)]
    items = [(i, text(12)) for i in range(40)]
    monkeypatch.setattr(ls, "BLOCK_ROWS", 60)
    index = ls.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert got(ls.search(index, spark.createDataFrame(items, "item_id long, text string"), 5)) == plain(docs, items, 5)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=40), min_size=1, max_size=5))
def test_treaps(lists):
    impact = np.array([x for one in lists for x in one], np.int64)
    size = np.array([len(x) for x in lists])
    first = np.cumsum(size) - size
    root, left, right = ls.treaps(first, impact)

    def walk(node, a, b):
        if a == b:
            return node == -1
        return a <= node < b and impact[node] == impact[a:b].max() and walk(left[node], a, node) and walk(right[node], node + 1, b)

    assert all(walk(r, a, a + n) for r, a, n in zip(root, first, size))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.booleans())
def test_shards_in_small_steps(seed, k, small):
    """Whole shards, one after the other, in steps of a few entries as well: the best of all documents, most of them never scored."""
    rng = np.random.default_rng(seed)
    steps = ls.STEP_ENTRIES
    ls.STEP_ENTRIES = 7 if small else steps
    try:
        vocabulary = [f"t{i}" for i in range(12)]
        texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 9), p=np.arange(12, 0, -1) / 78)) for _ in range(120)]
        ids = rng.permutation(120)
        n = sum(bool(t) for t in texts)
        queries = [(i, j) for i in range(3) for j in rng.choice(12, 4, replace=False).tolist()]
        block = ls.Block([(i, 0, vocabulary[j], int(w)) for (i, j), w in zip(queries, rng.integers(1, 99, len(queries)))])
        rows = []
        for s in range(3):
            for batch in ls.shard_rows(pa.array(ids[s * 40 : s * 40 + 40]), pa.array(texts[s * 40 : s * 40 + 40]), s, s, n, max(1, sum(len(t.split()) for t in texts))):
                rows += [r for r in batch.drop_columns(["slot"]).to_pylist() if r["term"] is None or r["term"] in block.terms]
        columns = ["shard", "term", "df", "root", "docs", "impacts", "left", "right"]
        part = pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64() if c in columns[:1] + columns[2:4] else pa.string() if c == "term" else pa.binary()) for c in columns]))
        out = next(iter(ls._searched(block, k)([part]))).to_pylist()
        length = sum(len(t.split()) for t in texts)
        for q, (item, _) in enumerate(block.queries):
            scores = []
            for i, t in zip(ids.tolist(), texts):
                c = Counter(t.split())
                total = sum(int(w) * (10**9 * c[term] // (1000 * c[term] + 8 * (25 + 75 * sum(c.values()) * n // length))) for term, (a, b) in block.terms.items() for e, w in zip(block.query[a:b].tolist(), block.weight[a:b].tolist()) if e == q and c[term])
                scores += [(-total, i)] if total else []
            assert [(-r["score"], r["doc_id"]) for r in out if r["item_id"] == item] == sorted(scores)[:k]
    finally:
        ls.STEP_ENTRIES = steps


def test_most_documents_are_pruned():
    """Of documents with one term more than others, only those near the best are scored, once each."""
    texts = ["rare common"] * 12 + ["common x y z"] * 3000
    rows = [r for b in ls.shard_rows(pa.array(range(3012)), pa.array(texts), 0, 0, 3012, 12024) for r in b.to_pylist()]
    held = [tuple(r[c] for c in ("term", "df", "root", "docs", "impacts", "left", "right")) for r in rows[1:] if r["term"] in ("rare", "common")]
    best = ls.Best(1, 10)
    shard = ls.Shard(rows[0]["docs"], rows[0]["df"], rows[0]["root"], held)
    weight = np.array([{"rare": 5000, "common": 1}[r[0]] for r in held])
    assert ls.search_shard(shard, np.zeros(2, np.int64), np.arange(2), weight, best) <= 100
    assert best.id[0].tolist() == list(range(10))
