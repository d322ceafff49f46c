import base64
import hashlib
import re
from html import unescape

from tidewright.llm import html_extract, warc
from tidewright.llm._shared import shared_dir, table


def article(html):
    inner = html[html.index("<article>") + 9 :].split("</article>")[0]
    blocks = (" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_extract_equals_the_article(spark, sf_dir):
    html = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    for r in html_extract.op2_html_extract(spark, sf_dir).collect():
        assert r["text"] == article(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


PAGES = [
    ('<div class="cookie-notice">We use cookies</div><main><p>Hello &lt;b&gt; &#233; \n world</p><p>x<br>y</p></main><div id="comments"><p>nice post, I really like it</p></div>', "Hello <b> é world\n\nx y"),
    ("<body><header><h1>Site</h1></header><article><h1>T</h1><p>One.<p>Two <a href=x>link</a> more.<ul><li>i1<li>i2</ul><form>name</form><aside>Related stuff here</aside><p>Last</article><section class=comments><h2>Comments</h2><p>good</p></section><footer>(c)</footer>", "T\n\nOne.\n\nTwo link more.\n\ni1\n\ni2\n\nLast"),
    ('<article><p>a</p><div class="advert">Buy</div><script>x<p></script><p>b</p></article>', "a\n\nb"),
    ('<nav><a href=/>x</a></nav><div class="post-body"><h2>Head</h2>Loose text here.<p>Body text</p></div><div class="sidebar"><p>side text</p></div>', "Head\n\nLoose text here.\n\nBody text"),
    ("", ""), (None, ""), ("<", ""), ("<p <b></i></p></div></div>", ""),
]


def test_pages_by_hand(spark):
    rows = spark.createDataFrame([(k, None, h, 1) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    assert [r["text"] for r in html_extract.extract(rows).orderBy("page_id").collect()] == [t for _, t in PAGES]
    assert html_extract.extract(rows.limit(0)).count() == 0
    deep = "<div>" * 3000 + "<article><p>x</p></article>"
    assert html_extract.main_texts([deep], html_extract.default_model())[0] in ("x", "")


def test_model_on_unseen_pages():
    pages, labels = html_extract.labelled_pages(100, 50_000)
    content, _ = html_extract.default_model().marginals(*html_extract.features(pages))
    import numpy as np

    assert ((content >= 0.5) == np.concatenate(labels)).mean() > 0.97


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    page = html_extract.read_page("<body><div class=nav><p>a</p></div><article><p>b c d</p></article></body>")
    x, parent, depth = html_extract.features([page])
    model = html_extract.default_model()
    sort, total, sums = html_extract.sorts(x), 0.0, np.zeros(len(x))
    for y in itertools.product((0, 1), repeat=len(x)):
        score = np.exp(sum(v * (x[k] @ model.node) for k, v in enumerate(y)) + sum(model.pair[sort[k], y[p], y[k]] for k, p in enumerate(parent) if p >= 0))
        total += score
        sums += score * np.array(y)
    np.testing.assert_allclose(model.marginals(x, parent, depth)[0], sums / total, atol=1e-9)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark, sf_dir):
    html = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    first = {}
    for i in sorted(html):
        first.setdefault(html[i] or "", i)
    rows = warc.op6_warc(spark, sf_dir).collect()
    assert len(rows) == len(html)
    for r in rows:
        i, text = r["page_id"], html[r["page_id"]] or ""
        want = ("response", None) if first[text] == i else ("revisit", first[text])
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(text.encode()), sha(text), *want)


def test_warc_of_odd_rows(spark):
    data = [(5, "http://a/ b", "x", 1), (3, None, "x", 1), (3, "u", "x", 2), (9, "v", None, 1), (7, "w", "", 1), (3, "u", "y", 1), (8, "z", "é", 0), (11, "l", "long " * 400_000, 0), (None, "n", "x", 0), (None, "n", "alone", 0)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, payload int")
    manifest = warc.write_warc(pages, f"{shared_dir(spark)}/w", roll_bytes=600).cache()
    assert manifest.agg({"part": "max"}).first()[0] >= 1  # files rolled
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.read_warc(manifest).fillna(-1, ["refers_to", "page_id"]).collect())
    want = [(3, "response", -1, sha("x")), (3, "response", -1, sha("y")), (3, "revisit", 3, sha("x")), (5, "revisit", 3, sha("x")), (7, "response", -1, sha("")), (8, "response", -1, sha("é")), (9, "revisit", 7, sha("")), (11, "response", -1, sha("long " * 400_000)), (-1, "revisit", 3, sha("x")), (-1, "response", -1, sha("alone"))]
    assert got == sorted(want)
    large = warc.read_warc(warc.write_warc(pages, f"{shared_dir(spark)}/v", least=2)).where("record_type = 'revisit'")
    assert large.count() == 0
    again = warc.write_warc(pages, f"{shared_dir(spark)}/x", roll_bytes=600)
    read = lambda m: sorted(bytes(r["content"]) for r in spark.read.format("binaryFile").load([r["path"] for r in m.collect()]).collect())
    assert read(again) == read(manifest)  # the same bytes
    assert warc.read_warc(warc.write_warc(pages.limit(0), f"{shared_dir(spark)}/y")).count() == 0
