"""Rows that share an id but not their contents, hubs, and stages that must keep each row's own decision."""

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import embedding_dedup, minhash_dedup, mixing
from tidewright.llm._graph import components


def test_vectors_of_one_id_have_their_own_links(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [0.02, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(rows).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 2, 2), (4, 2, 2)]


def test_texts_of_one_id_have_their_own_links(spark):
    words = [f"w{i}" for i in range(101)]
    near, far = " ".join(words), " ".join(f"x{i}" for i in range(50))
    rows = spark.createDataFrame([(3, " ".join([*words[:-1], "end"])), (5, near), (5, far), (5, far), (9, far + " more")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"], r["stays"]) for r in minhash_dedup.near_duplicates(rows, 3, 85).collect())
    assert got == [(3, 3, True, True), (5, 3, False, False), (5, 5, True, True), (5, 5, True, True), (9, 5, False, False)]


def test_near_duplicate_stage_keeps_texts_of_one_id(spark, sf_dir):
    import corpus_pipeline

    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    data = [(1, one, "x"), (1, two, "x"), (2, one, "x"), (1, one, "y"), (3, two + " end", "x"), (4, None, "x"), (4, None, "x"), (None, one, "x")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string, source string"), sf_dir)
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["source"]) for r in out.collect()) == sorted([(1, one, "x"), (1, two, "x"), (4, "", "x"), (4, "", "x"), (-1, one, "x")])


def test_near_duplicate_stage_takes_maps_and_arrays(spark, sf_dir):
    import corpus_pipeline

    text = " ".join(f"a{i}" for i in range(40))
    data = [(1, text, {"k": 2}, [[{"x": "y"}]], ["b"]), (1, text, {"k": 1}, None, ["a"]), (1, text, None, None, None), (2, text, {}, [], [])]
    kinds = "doc_id long, text string, m map<string,int>, nested array<array<map<string,string>>>, names array<string>"
    frame = spark.createDataFrame(data, kinds)
    kept = [corpus_pipeline.near_duplicates(spark, frame.repartition(n), sf_dir).collect() for n in (1, 3)]
    assert kept[0] == kept[1] and [r["doc_id"] for r in kept[0]] == [1] and kept[0][0].asDict() in [r.asDict() for r in frame.collect()]


def test_a_hub_is_dealt_to_many_tasks(spark):
    links = spark.range(1, 20_000).selectExpr("0L as a", "id as b").unionAll(spark.range(20_001, 20_400).selectExpr("id - 1 as a", "id as b"))
    got = components(links)
    assert got.groupBy("component").count().orderBy("component").collect()[:] == [(0, 20_000), (20_000, 400)]


def test_mix_takes_each_row_by_its_own_draw(spark):
    rows = spark.range(1200).selectExpr("if(id % 3 = 0, null, id div 2) as doc_id", "repeat('w ', cast(5 + id * 13 % 40 as int)) as text", "if(id % 2 = 0, 'a', 'b') as source", "id as n")
    out = mixing.take(rows)
    assert out.columns == rows.columns
    targets = {r["source"]: r["target"] for r in mixing.mix(rows).select("source", "target").distinct().collect()}
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert set(taken) == {"a", "b"} and all(abs(taken[s] - targets[s]) <= 45 for s in taken)
    assert out.groupBy("n").count().agg(F.max("count")).first()[0] <= 3
    again = mixing.take(rows.repartition(5, "n"))
    assert sorted(r["n"] for r in again.where("doc_id is not null").collect()) == sorted(r["n"] for r in out.where("doc_id is not null").collect())


def test_mix_of_one_row_many_times(spark):
    rows = spark.range(9000).selectExpr("if(id < 7000, 1, id) as doc_id", "repeat('w ', 7) as text", "if(id % 2 = 0, 'a', 'b') as source")
    out = mixing.mix(rows, group=200)
    by = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert out.count() == 9000 and all(abs(r["taken"] - r["target"]) <= 30 for r in by)


def test_pairs_near_the_limit_are_found(spark):
    """Recall over planted pairs at 0.85 of three-word shingles."""
    rng, rows, want = np.random.default_rng(3), [], 0
    for k in range(1500):
        words = [f"p{k}_{i}" for i in range(102)]
        other = list(words)
        for at in 1 + 12 * rng.permutation(8)[:5]:  # five words alter 15 of 100 shingles: 85 of 115 shared is below, so three are altered
            if (np.array([a != b for a, b in zip(words, other)]).sum()) < 2:
                other[at] = f"q{k}_{at}"
        a, b = ({tuple(w[i : i + 3]) for i in range(100)} for w in (words, other))
        want += 100 * len(a & b) >= 85 * len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert want == 1500 and got.where("not kept").count() == want
