import numpy as np
import pytest

from tidewright.llm import mixing
from tidewright.llm._shared import staged, table


def targets(sizes):
    """Water filling step by step: sizes by source in order."""
    weights = dict(zip(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]))
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        share = (total - sum(fixed.values())) / (sum(weights[s] for s in free) or 1)
        over = [s for s in free if share * weights[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: share * weights[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 500, "d": 5}, {"a": 0, "b": 7}, {"a": 10, None: 20}, {"B": 3, "a": 4, "é": 5}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(targets(sizes))


def test_mix(spark, sf_dir):
    out = mixing.op9_mixing(spark, sf_dir).toPandas().sort_values("doc_id")
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"].clip(lower=1) == 0).all()
    by = out.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 0.1 * by["target"] + 50).all()
    again = mixing.op9_mixing(spark, sf_dir).toPandas().sort_values("doc_id")
    assert out["taken"].tolist() == again["taken"].tolist()


def test_many_groups_and_levels(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id * 37 % 90 as int)) as text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) as source")
    out = mixing.mix(rows, group=40).toPandas()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 200


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    q = mixing.fly(size, p, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_odd_mix(spark, odd_docs):
    out = mixing.mix(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert sum(r["doc_id"] is None for r in out) == 2
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(odd_docs.where("text is null or text = ''")).collect())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"t{k}")
        if name != "packing":
            assert docs.columns == columns
            assert k > 2 or 0.5 * n < docs.count() <= n
            n = docs.count()
    assert docs.count() == corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_odd_rows(spark, sf_dir, odd_docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd_docs, odd_docs.limit(0)):
            out = stage(spark, rows, sf_dir)
            assert name == "packing" or out.columns == rows.columns
            out.collect()
    kept = corpus_pipeline.near_duplicates(spark, odd_docs, sf_dir).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, -1, 1, 2, 3, 4, 6, 9, 11, 12, 14]
