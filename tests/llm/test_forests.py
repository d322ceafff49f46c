"""Groups of near copies of which no member is like all others: their pairs grow with the members, not with their square."""

import random

from tidewright.llm import _graph, minhash_dedup


def texts(rng, n, base, changed):
    out = []
    for _ in range(n):
        words = base.split()
        for at in rng.sample(range(len(words)), rng.choice(changed)):
            words[at] = f"x{rng.getrandbits(40)}"
        out.append(" ".join(words))
    return out


def brute(rows, width, percent):
    sets = {i: {tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            same = len(sets[i] & sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_pairs_of_a_borderline_group(spark, monkeypatch):
    rng = random.Random(11)
    base = " ".join(f"w{k}" for k in range(300))
    other = " ".join(f"v{k}" for k in range(300))
    rows = list(enumerate(texts(rng, 400, base, (3, 4, 5)) + texts(rng, 30, other, (0, 3)) + texts(rng, 30, other, (9, 12))))
    rng.shuffle(rows)
    tried, confirm = [], minhash_dedup.confirm

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(minhash_dedup, "confirm", counted)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, percent=80).collect()}
    assert got == brute(rows, 5, 80) and 3 < len(set(got.values())) < 300
    assert sum(tried[1:]) < 3 * len(rows)


def test_merged_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(3, 6), (2, 6), (2, 5), (1, 2), (10, 9), (12, 11), (12, 11)], "a long, b long")
    got = {r["node"]: r["component"] for r in _graph.merged(labels, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 8: 8, 9: 8, 10: 8, 11: 11, 12: 11}
    assert {r["node"]: r["component"] for r in _graph.merged(labels, links.limit(0)).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 8, 9: 8}
    assert _graph.merged(labels.limit(0), links.limit(0)).collect() == []
