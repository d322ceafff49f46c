"""Pairs at the least similarity whose signatures differ more than those of most such pairs."""

import numpy as np

from tidewright.llm import minhash_dedup
from tidewright.llm.minhash_dedup import keys_of, limits, shingles, signatures


def sketched(texts):
    return signatures(*shingles(texts, 5), len(texts))


def test_limits_keep_the_chance_of_a_miss_low():
    assert limits(85) == (minhash_dedup.DISTANCE, minhash_dedup.CHUNKS)
    rng = np.random.default_rng(8)
    for percent in (50, 70, 80, 85, 95):
        distance, chunks = limits(percent)
        assert minhash_dedup.beyond(percent, distance) < 1e-4
        a = rng.integers(0, 1 << 16, (300, 64), dtype=np.uint16)
        b = a.copy()
        for row in b:
            row[rng.choice(64, distance, replace=False)] ^= 1
        assert (keys_of(a, distance, chunks) == keys_of(b, distance, chunks)).any(1).all()
    assert ((rng.random((200_000, 64)) < 0.2).sum(1) > limits(80)[0]).mean() < 1e-4


def test_a_pair_at_four_fifths_links_though_its_signatures_differ_much(spark):
    """The pair shares its keys with a smaller id that is like neither, so that only the second look can link it."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(184)]
    a, others = " ".join(words), []
    for k in range(8000):  # four words far apart: 160 of 200 shingles are the same
        new = list(words)
        for at in 8 + 40 * np.arange(4) + rng.integers(0, 30, 4):
            new[at] = f"n{k}_{at}"
        others.append(" ".join(new))
    sa, sb = sketched([a]), sketched(others)
    apart = (sb != sa).sum(1)
    common = keys_of(sb, 22, 13) == keys_of(sa, 22, 13)
    at = min(np.flatnonzero((apart >= 23) & (apart <= 27)), key=lambda i: common[i].sum())
    first = [a + "".join(f" j{k}_{i}" for i in range(50)) for k in range(2000)]  # 180 of 230 shingles are those of a
    held = keys_of(sketched(first), 22, 13) == keys_of(sa, 22, 13)
    smaller = first[int(np.flatnonzero(held[:, common[at]].all(1))[0])]
    rows = spark.createDataFrame([(1, smaller), (2, a), (3, others[at])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(rows).collect()} == {1: 1, 2: 2, 3: 2}
