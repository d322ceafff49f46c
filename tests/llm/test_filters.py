import re

import numpy as np
import pytest

from tidewright.llm import quality_classifier, quality_rules, url_filter
from tidewright.llm._labels import remainder
from tidewright.llm._shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words, seen, covered = WORD.findall(text), {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    for r in quality_rules.op7_quality_rules(spark, sf_dir).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r["base_failed"] and r["kept"])


def test_counts_of_odd_texts():
    texts = [None, "", " \n ", "a\x0bb\x0cc", "é日 \U0001f600", "x\n\nx\n x\nx", "a b c d e f g h " * 3, "a b c d e f g h\n" * 2]
    got = quality_rules.count(texts)
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t)


def test_rules_are_learned_and_read_as_they_run(spark):
    rng = np.random.default_rng(0)
    x = {f: rng.random(900) for f in quality_rules.FEATURES}
    bad = (x["symbols_per_word"] > 0.6) & (x["upper_share"] < 0.4) | (x["bangs_per_word"] > 0.9)
    rules = quality_rules.learn(x, bad)
    rejects = np.zeros(900, bool)
    for rule in rules:
        rejects |= np.logical_and.reduce([t.holds(x) for t in rule])
    assert (rejects == bad).mean() > 0.95
    assert quality_rules.learn({f: v[:0] for f, v in x.items()}, bad[:0]) == []
    assert quality_rules.learn(x, np.zeros(900, bool)) == [] and quality_rules.learn(x, np.ones(900, bool)) == []
    rule = [quality_rules.Test("n_words", False, 5.0), quality_rules.Test("symbols_per_word", True, 0.5)]
    row = spark.sql("select named_struct('n_words', 4L, 'n_symbols', 3L) as c union all select named_struct('n_words', 9L, 'n_symbols', 9L)")
    assert [r[0] for r in row.select(quality_rules.verdict([rule], "c")).collect()] == [False, True]


def test_rules_on_odd_rows(spark, odd_docs, odd_labels):
    out, name = quality_rules.apply_rules(odd_docs, quality_rules.fit_rules(odd_docs, odd_labels), odd_docs.columns)
    assert out.columns == [*odd_docs.columns, name] and name not in odd_docs.columns
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert tuple(r[name][c] for c in quality_rules.COUNTS[:5]) == brute_counts(r["text"])
    assert quality_rules.apply_rules(odd_docs.limit(0), [], ["doc_id"])[0].count() == 0


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = quality_classifier.op4_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    good, bad = out[out["quality"] == 1], out[out["quality"] == 0]
    assert good["predicted"].mean() > 0.99 and bad["predicted"].mean() < 0.1
    assert (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()[None]).mean() > 0.99


def test_classifier_never_sees_held_out_labels(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.when(remainder("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.fit_quality(docs, x).score(["some words here", None]) for x in (labels, turned))
    assert np.array_equal(a, b)


def test_classifier_on_odd_rows(spark, odd_docs, odd_labels):
    model = quality_classifier.fit_quality(odd_docs, odd_labels)
    out = quality_classifier.with_score(odd_docs, model, odd_docs.columns, "_score").collect()
    assert len(out) == odd_docs.count() and all(0 <= r["_score"] <= 1 for r in out)
    empty = quality_classifier.fit_quality(odd_docs.limit(0), odd_labels.limit(0))
    assert empty.score([None, "x"]) == pytest.approx([0.5, 0.5])
    assert quality_classifier.with_score(odd_docs.limit(0), empty, ["doc_id"]).count() == 0


URLS = [
    ("http://example.net/en/x", "example.net", "/en/x", "example.net/en/", "allow"), ("https://A.Example.NET/de", "a.example.net", "/de", "net/", "block"), ("http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
    ("http://x.org/fr/1?q#z", "x.org", "/fr/1", "org/fr/", "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("http://b.net", "b.net", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme/porn", "", "", None, "block"),
    ("http://a.com/xxx/", "a.com", "/xxx/", None, "block"), ("http://a.com/xxxl", "a.com", "/xxxl", None, "allow"), ("http://cheap-pills.com/", "cheap-pills.com", "/", None, "block"), ("http://cheap.com/cheap", "cheap.com", "/cheap", None, "allow"), ("http://h.com?a=/b", "h.com", "", None, "allow"),
]


def test_urls(spark):
    rows = spark.createDataFrame([(k, u, "x") for k, (u, *_) in enumerate(URLS)], "page_id long, url string, verdict string")
    got = url_filter.filter_urls(rows).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [tuple(x[1:]) for x in URLS]
    assert url_filter.filter_urls(rows.limit(0)).count() == 0


def test_url_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.sql(url_filter.ORACLES["op1_url_filter"]).df().sort_values("page_id").reset_index(drop=True)
    got = url_filter.op1_url_filter(spark, sf_dir).toPandas().sort_values("page_id").reset_index(drop=True)
    assert got[want.columns].astype(object).where(got.notna(), None).equals(want.astype(object).where(want.notna(), None))


def test_terms_within_words_of_any_script(spark):
    urls = ["http://x.org/caf\u00e9xxx\u00e9", "http://x.org/\u00e9xxx", "http://x.org/xxx\u65e5", "http://x.org/xxx/\u00e9", "http://x.org/-xxx\u2019s", "http://x.org/\u0663xxx"]
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["allow", "allow", "allow", "block", "block", "allow"]
    import duckdb

    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    want = con.sql(url_filter.ORACLES["op1_url_filter"]).select("page_id, verdict, strict_hits").fetchall()
    assert sorted(want) == [(r["page_id"], r["verdict"], r["strict_hits"]) for r in rows]
