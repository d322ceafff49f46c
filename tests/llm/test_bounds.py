"""What a task holds is bounded: shards of very short documents, and near pairs of vectors that single precision only guesses."""

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import embedding_dedup, token_shards


def test_shards_of_a_million_empty_texts_roll(spark, tmp_path):
    docs = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    manifest = token_shards.write_shards(docs, str(tmp_path), shards=2)
    rows = manifest.orderBy("range", "part").collect()
    assert sum(r["n_docs"] for r in rows) == sum(r["n_ids"] for r in rows) == 1_000_000
    assert max(r["n_docs"] for r in rows) == token_shards.ROLL_DOCS and len(rows) >= 4
    assert all(a["last_id"] < b["first_id"] for a, b in zip(rows, rows[1:]))


def test_near_pairs_on_the_bound():
    rng = np.random.default_rng(7)
    for dense in (False, True):
        a = rng.normal(size=(300, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(500, 64))
        b -= (b * a[np.arange(500) % 300]).sum(1, keepdims=True) * a[np.arange(500) % 300]
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        cosine = 0.9 + rng.choice([-1e-6, -1e-9, -1e-12, 1e-12, 1e-9, 1e-6], 500)
        b = cosine[:, None] * a[np.arange(500) % 300] + np.sqrt(1 - cosine**2)[:, None] * b
        if dense:
            a, b = np.repeat(a[:3], 100, 0), np.repeat(b[:3], 100, 0)
        i, j = embedding_dedup.near_pairs(a, a.astype(np.float32), b, b.astype(np.float32), 0.9)
        want = np.argwhere(a @ b.T >= 0.9)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist())) and len(i) > 0
        assert (np.diff(i) >= 0).all()
