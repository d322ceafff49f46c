"""License scans against a plain version: phrases word by word, every block against every template."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import license_scan
from tidewright.llm._bytes import Terms
from tidewright.llm._shared import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PARTS = re.compile(r"(?<=[.!?])(?=[ \t\r\n\x0b\x0c])|(?<=\n)(?=[ \t\r]*\n)")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_blocks(text):
    """(first word, words) of each block, windows of long ones."""
    at, out = 0, []
    for part in PARTS.split((text or "").translate(LOWER)):
        w = WORD.findall(part)
        if len(w) > 64:
            k = 0
            while True:
                out.append((at + k, w[k : k + 64]))
                if k + 64 >= len(w):
                    break
                k += 32
        elif w:
            out.append((at, w))
        at += len(w)
    return out


def plain(text, rows=license_scan.TEMPLATES, percent=80):
    w, places, base = words(text), [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        got = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += got
        base |= {label} if got else set()
    found = []
    for first, block in plain_blocks(text):
        best = None
        for k, (label, must, notice) in enumerate(rows):
            t = set(words(notice))
            shared = len(t & set(block))
            if 100 * shared >= percent * len(t) and set(words(must)) <= set(block):
                best = min(best or (1,), (-shared / len(t), -len(t), k, label))
        if best and best != (1,):
            found.append((best[3], first, len(block), -best[0]))
    labels = base | {f[0] for f in found}
    score = 1.0 if base else max((f[3] for f in found), default=0.0)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found


def got(r):
    return *(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")), [tuple(f) for f in r["found"]]


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_scan_equals_the_plain_version(spark, at):
    docs = table(spark, f"/root/testdata/{at}", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = license_scan.scan(docs).collect()
    assert len(rows) == len(texts) and any(r["labels"] == "cc-by-nc" for r in rows) and any(r["base_labels"] for r in rows)
    for r in rows:
        assert got(r) == plain(texts[r["doc_id"]])
    query = license_scan.op13_license_scan(spark, f"/root/testdata/{at}")
    assert query.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_odd_rows(spark, odd_docs):
    for rows, base in ((odd_docs.collect(), odd_docs), ([], odd_docs.limit(0))):
        out = license_scan.scan(base).collect()
        assert sorted(map(repr, ((r["doc_id"], *got(r)) for r in out))) == sorted(map(repr, ((r["doc_id"], *plain(r["text"])) for r in rows)))


NOTICES = [r[2] for r in license_scan.TEMPLATES]
PIECES = st.one_of(st.sampled_from(NOTICES), st.sampled_from(["MIT license", "mit  LICENSE", "general public", "license", ". ", "\n", "\n \n", "! ", " ", "v2.0", "é", "the of under licensed", "x " * 70, "BSD"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=9).map(" ".join), min_size=1, max_size=5), st.randoms())
def test_blocks(texts, random):
    dropped = [" ".join(x for x in t.split(" ") if random.random() > 0.08) for t in texts]
    for some in (texts, dropped):
        w = Terms(pa.array(some))
        first, last = license_scan.blocks(w)
        number, distinct = w.numbered()
        held = [distinct[i].as_py().decode() for i in number.tolist()]
        mine = sorted((int(a), held[a:b]) for a, b in zip(first.tolist(), last.tolist()))
        want = sorted((int(w.first[k]) + a, b) for k, t in enumerate(some) for a, b in plain_blocks(t))
        assert mine == want


def test_noticed_notices(spark):
    texts = [
        "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "Released under the\nMIT\nLicense", "Released under the ISC License.", "Released, under the old mill, a license to mit", "x " * 500 + NOTICES[3] + " y" * 500,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met:", "MIT", "mit license mit license", "Apache-License", "apachelicense", "mit\x00license", None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.scan(frame).collect()}
    assert [out[k]["labels"] for k in range(len(texts))] == ["cc-by", "cc-by-nc", "mit", "", "mit", "mit", "bsd", "", "mit", "apache", "", "mit", ""]
    for k, t in enumerate(texts):
        assert got(out[k]) == plain(t)
    assert (out[8]["n_base"], out[8]["first_word"], out[8]["last_word"]) == (2, 0, 2)


def test_templates_are_bounded():
    for bad in ([("x", "", "w " * 33)], [("x", "", " . ")], [("x", "y", "z")], [("x", "", "z")] * 5001):
        with pytest.raises(ValueError):
            license_scan.templates(bad)


def test_every_block_is_compared(spark):
    """At 100 and at 50 percent the joins agree with all pairs as well, so no filter is tuned to one threshold."""
    texts = [" ".join(n.split()[i:] + ["the", "of"]) for n in NOTICES for i in range(0, 8, 2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (50, 100):
        for r in license_scan.scan(frame, percent=percent).collect():
            assert got(r) == plain(texts[r["doc_id"]], percent=percent)
