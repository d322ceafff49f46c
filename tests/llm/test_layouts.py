"""Page layouts without telling names, deep nests, held-out layouts of the generator, and vocabularies from tables."""

import time

import numpy as np
import pytest

from tidewright.llm import html_extract, quality_classifier, url_filter
from tidewright.llm._words import Words

TEXTS = [f"Paragraph number {i} tells something about the matter, at some length, and with a point or two." for i in range(6)]
WHOLE = "\n\n".join(TEXTS)
P, DIV = ("".join(f"<{e}>{t}</{e}>" for t in TEXTS) for e in ("p", "div"))
PAGES = {
    "nameless": (f"<body><div><a href=/>Home</a> <a href=/>News</a></div><div>{DIV}</div><div>Copyright 2020</div></body>", WHOLE),
    "table": (f"<body><table><tr><td><a href=/>Home</a></td><td>{P}</td></tr></table></body>", WHOLE),
    "hashed": (f'<body><div class="x9f"><div class="y1">{P}</div></div></body>', WHOLE),
    "own header": ("<body><nav><a href=/>x</a></nav><article><header><h1>Title here</h1></header><p>One short text.</p></article><footer>c 2020</footer></body>", "Title here\n\nOne short text."),
    "open head": ("<html><head><title>T</title><article><h1>Hi</h1><p>Some text of the article that goes on.</p></article>", "Hi\n\nSome text of the article that goes on."),
    "links only": ('<body><nav class=menu><a href=/>a b c</a></nav><div class="footer">Copyright, all rights reserved, and so on for a while</div></body>', ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, want = PAGES[name]
    assert html_extract.main_texts([page], html_extract.default_model()) == [want]


def f1(pages):
    model, right, wrong = html_extract.default_model(), 0, 0
    for page, labels in pages:
        content, _ = model.marginals(*html_extract.features([page]))
        for node, text in page.blocks:
            got = content[node] >= 0.5
            right += 2 * len(text) * bool(got and labels[node])
            wrong += len(text) * bool(got != labels[node])
    return right / (right + wrong)


def anonymous(seed):
    w = html_extract.Writer(seed)
    w.open("body", False)
    w.anonymous()
    return html_extract.read_page("".join(w.out)), np.array(w.labels)


def test_held_out_pages():
    assert f1(zip(*html_extract.labelled_pages(200, 100_000))) > 0.98
    assert f1((p, y) for p, y in map(anonymous, range(9000, 9100)) if len(p.nodes) == len(y)) > 0.97


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</p>" * 1000, "<div>" * 16_000 + "</p>" * 16_000, "<b>" * 20_000 + "<p>x" * 2000, "<div hidden>" + "<div>" * 50_000 + "</div>" * 50_001 + "<p>y</p>"])
def test_deep_nests_take_linear_time(page):
    model, began = html_extract.default_model(), time.time()
    html_extract.main_texts([page], model)
    assert time.time() - began < 15


def test_context_vectors_are_those_of_all_documents(spark):
    texts = ["a b c a b", "b c", None, "", "c", "The cat, the CAT! 12"] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    sums = np.zeros((quality_classifier.BUCKETS + quality_classifier.SHAPES, quality_classifier.DIM))
    for t in texts:
        bucket, shape = quality_classifier.terms(Words([t]))
        for i in range(len(bucket)):
            for j in range(max(0, i - 2), min(len(bucket), i + 3)):
                if i != j:
                    for term in (bucket[i], shape[i]):
                        sums[term] += quality_classifier.INDEX[bucket[j]] + quality_classifier.INDEX[shape[j]]
    np.testing.assert_allclose(quality_classifier.context_vectors(rows), quality_classifier.unit_rows(sums), atol=1e-6)


def test_vocabulary_of_a_table(spark):
    terms = spark.createDataFrame([("Bad", None), ("bad", 3), ("cheap", 1), ("cheap", 2), ("", 4), (None, None), ("Pills", 2)], "term string, weight int")
    strict, soft = url_filter.vocabulary(terms)
    assert strict == ["bad"] and soft == {"cheap": 2, "pills": 2}
    urls = spark.createDataFrame([(1, "http://x/BAD"), (2, "http://x/badly"), (3, "http://x/cheap-pills"), (4, "http://x/cheap-cheap")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(urls, strict=strict, soft=soft).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    with pytest.raises(ValueError):
        url_filter.vocabulary(terms, 2)
