"""Elements that are left out end where HTML ends them, and not at the end of the page."""

import pytest

from tidewright.llm import html_extract

TEXT = "<article><h1>Title here</h1><p>First paragraph of the article, with some words.</p><p>The second one.</p></article>"
WANT = "Title here\n\nFirst paragraph of the article, with some words.\n\nThe second one."
BEFORE = [
    "<svg viewBox='0 0 1 1'/>", "<div><svg class=x /></div>", "<iframe src=x />", '<script src="x"/>', "<svg><svg/><text>no</text></svg>", "<svg><path d=x></svg>", "<div><svg><path d=x></div>",
    "<ul><li>a<li hidden>no<li hidden>no</ul>", "<ul><li hidden>no<ul><li>no<li>no</ul>no</ul>", "<div><p hidden>no</div>", "<div><p hidden>no <b>no</div>", "<p hidden>no<hr>", "<table><tr><td aria-hidden=true>no<tr><td hidden>no</table>",
    "<table><tbody hidden><tr><td>no</table>", "<dl><dt hidden>no<dd hidden>no</dl>", "<div><span hidden>no</div>", "<div hidden/>", "<div><select><option>no</div>", "<div hidden><p>no</p><div>no</div>no</div>",
]


def main_text(html):
    return html_extract.main_texts([html], html_extract.default_model())[0]


@pytest.mark.parametrize("before", BEFORE)
def test_the_article_after_a_skipped_element_stays(before):
    assert main_text(f"<body><nav>{before}</nav>{TEXT}</body>") == WANT


def test_a_head_without_its_end_tag():
    assert main_text(f"<html><head><title>no</title><meta name=x><body>{TEXT}") == WANT
    assert main_text(f"<html><head><title>no</title><link rel=x>{TEXT}") == WANT


@pytest.mark.parametrize("inside,text", [
    ("<p>One <svg/>two.</p>", "One two."), ("<p hidden>no<p>Shown words of the text.", "Shown words of the text."), ("<div hidden>no<p>no</p>no</div><p>Shown words.</p>", "Shown words."), ("<p>a <a href=x><span hidden>no</a> b</p>", "a b"),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "So x=2 holds."), ("<p>See <object data=x>the fallback text</object> here.</p>", "See the fallback text here."), ("<p hidden>no <svg><path d=x></path></svg> no</p><p>Shown.</p>", "Shown."),
])
def test_text_around_and_in_elements(inside, text):
    assert main_text(f"<body><article><h1>Title here</h1>{inside}<p>Last words of the article.</p></article></body>") == f"Title here\n\n{text}\n\nLast words of the article."
