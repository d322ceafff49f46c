"""Importance resampling against a plain version, word by word."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import importance
from tidewright.llm._bytes import Terms
from tidewright.llm._shared import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text, most=1, n=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain(docs, target):
    s, t = (Counter(b for _, x in rows for b in buckets(x)) for rows in (docs, target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, x in docs:
        f = buckets(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(repr, map(tuple, rows)))


def got(df):
    return sorted(repr((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in df.collect())


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_query_equals_the_plain_version(spark, at):
    d = f"/root/testdata/{at}"
    docs, target = ([tuple(r) for r in table(spark, d, t).select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got(importance.op12_importance(spark, d)) == plain(docs, target)


def test_odd_rows(spark, odd_docs):
    target = spark.createDataFrame([(None,), ("",), ("word1 word2 WORD3 é",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(importance.resample(odd_docs, target)) == plain(docs, [(0, r["text"]) for r in target.collect()])
    many = [r for r in docs if r[0] in (6, 7, 9)] * 20  # equal ids, texts and scores
    frame = spark.createDataFrame(many, "doc_id long, text string")
    assert got(importance.resample(frame, target)) == plain(many, [(0, r["text"]) for r in target.collect()])


def test_empty_tables(spark, odd_docs):
    none = odd_docs.limit(0)
    assert importance.resample(none, odd_docs).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(importance.resample(odd_docs, none.select("text"))) == plain(docs, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09 .\n`{é日\x00\x7f\U0001f600", max_size=150)), max_size=6), st.integers(1, 3))
def test_runs_of_words(texts, most):
    column = pa.array(texts, pa.string())
    of, bucket, counts = importance.features(column, most)
    assert counts.tolist() == [len(words(t)) for t in texts]
    for k, t in enumerate(texts):
        assert sorted(bucket[of == k].tolist()) == sorted(buckets(t, most))
    sliced = pa.array(["skip me", *texts, "and me"], pa.string()).slice(1, len(texts))
    w = Terms(sliced)
    numbers, distinct = w.numbered()
    assert [distinct[i].as_py().decode() for i in numbers.tolist()] == [x for t in texts for x in words(t)]


def test_words_of_any_length():
    texts = ["a" * k for k in (0, 1, 63, 64, 65, 100_000)]
    _, bucket, _ = importance.features(pa.array(texts))
    assert bucket.tolist() == [b for t in texts for b in buckets(t)]
    assert importance.CRC[255] == np.uint32(0x2D02EF8D)
