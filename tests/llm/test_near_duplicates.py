import collections
import re

import numpy as np
import pytest

from tidewright.llm import embedding_dedup, minhash_dedup
from tidewright.llm._graph import components
from tidewright.llm._shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def smallest(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def brute(ids, texts, width, percent):
    sets, holders, links = [shingles(t, width) for t in texts], collections.defaultdict(list), []
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in holders[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.append((i, j))
        for g in s:
            holders[g].append(i)
    return {ids[i]: (len(s), ids[r]) for i, (s, r) in enumerate(zip(sets, smallest(len(ids), links)))}


def test_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").toPandas()
    want = brute(docs["doc_id"].tolist(), docs["text"].tolist(), 3, 85)
    got = minhash_dedup.op10_minhash_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_of_edited_copies(spark):
    """Each text differs a little from the last, so components are long and no member is like all others."""
    rng = np.random.default_rng(2)
    texts, words = [], [f"w{i}" for i in range(120)]
    for k in range(150):
        words = list(words)
        for at in rng.integers(0, 120, 1 if k % 10 else 30):
            words[at] = f"n{k}_{at}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(rows, 5, 80).collect()}
    assert got == brute([i * 3 for i in range(150)], texts, 5, 80)


def test_odd_documents(spark, odd_docs):
    got = minhash_dedup.near_duplicates(odd_docs, 3, 85).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(got) == odd_docs.count()
    assert by[1] == by[2][:0] + [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] * 2
    assert [by[i][0][1] for i in (6, 7, 8)] == [6, 6, 6] and by[10][0][1] == 9 and by[13][0][1] == 12
    assert all(x[1] is None and x[2] for x in by[None])
    assert minhash_dedup.near_duplicates(odd_docs.limit(0)).count() == 0
    assert minhash_dedup.near_duplicates(odd_docs.where("doc_id = 1")).count() == 1


def test_every_pair_within_distance_shares_a_key():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, (300, 64), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(64, minhash_dedup.DISTANCE, replace=False)] ^= 1
    ka, kb = minhash_dedup.keys_of(a), minhash_dedup.keys_of(b)
    assert (ka == kb).any(1).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(0, 200) if i % 40] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))] + [(7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = smallest(400, links)
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: roots[x] for x in ends}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(ids, vectors, least=0.9):
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    roots = smallest(len(ids), zip(*np.nonzero(near)))
    return {i: (int(n), ids[r]) for i, n, r in zip(ids, near.sum(1), roots)}


@pytest.mark.parametrize("cell", [4096, 40])
def test_vectors_equal_brute_force(spark, sf_dir, cell):
    rows = table(spark, sf_dir, "embeddings")
    data = rows.orderBy("vec_id").toPandas()
    rng = np.random.default_rng(0)
    x = np.array(data["embedding"].tolist(), float)
    tight = x[0] + rng.normal(0, 0.02, (120, x.shape[1])) * np.abs(x[0]).mean()
    every = np.concatenate([x, tight, np.repeat(x[:1], 30, 0), 3 * x[5:6]])
    ids = list(range(len(every)))
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, every)], "vec_id long, embedding array<double>"), cell=cell).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_vectors(ids, every)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None, 0), (2, [], 0), (3, [0.0, -0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], 0), (8, [2.0, 0.0], 0), (9, [1.0, 0.0], 0), (10, [1.0], 0), (11, [5.0], 0), (12, [-1.0], 0), (13, [1e300, 1e300], 0), (14, [1.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, key int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(rows).collect()}
    want = {i: (0, i) for i in range(1, 15)} | {7: (2, 7), 8: (2, 7), 9: (2, 7), 10: (1, 10), 11: (1, 10), 13: (1, 13), 14: (1, 13), None: (0, None)}
    assert got == want
    assert embedding_dedup.near_vectors(rows.limit(0)).count() == 0 and embedding_dedup.near_vectors(rows.limit(2)).count() == 2
