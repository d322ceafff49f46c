"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A text falls into blocks at sentence ends and blank lines; longer blocks are cut into overlapping windows, so that any
template that stands in a text lies whole in one. A block matches a template if it holds at least PERCENT of the
template's distinct words. Words are ordered globally by their frequency in the whole corpus, rarest first, and the join
is exact: a block and a template that share enough words share one among the template's first words (prefix), the block
has enough template words at all (length), and enough words are left behind the first shared one on both sides
(position); what passes is counted in full. Templates are few and bounded, blocks never leave the task that reads them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import Terms, slices
from ._shared import table

PERCENT, WINDOW, MOST_TEMPLATES = 80, 64, 5000

# Base phrases with their labels, and license notices as (label, words that must be there, notice).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "mit", "Licensed under the MIT License"),
    ("mit", "mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "permission granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "license compliance", "You may not use this file except in compliance with the License"),
    ("gpl", "gnu general", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gnu general", "You can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "gnu lesser", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "gnu affero", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "bsd", "Licensed under the BSD License"),
    ("isc", "permission granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("cc-by", "cc by", "Licensed under CC BY 4.0"),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "creative commons attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "unencumbered public", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    must: frozenset[bytes]
    words: frozenset[bytes]


def _words(text: str) -> list[bytes]:
    number, distinct = Terms(pa.array([text])).numbered()
    return [distinct[i].as_py() for i in number.tolist()]


def templates(rows: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    """Templates of (label, words that must be there, notice); a notice of more words than half a window is an error."""
    out = [Template(label, frozenset(_words(must)), frozenset(_words(notice))) for label, must, notice in rows]
    if len(out) > MOST_TEMPLATES or any(len(_words(r[2])) > WINDOW // 2 for r in rows):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of at most {WINDOW // 2} words; cut longer ones into sentences")
    if any(not t.words or not t.must <= t.words for t in out):
        raise ValueError("a template has words, and those that must be there are among them")
    return out


def frequencies(docs: DataFrame, words: Sequence[bytes]) -> dict[bytes, int]:
    """How often each of a bounded set of words stands in all texts."""
    wanted = pa.array(list(words), pa.large_binary())

    def run(parts):
        total = np.zeros(len(wanted), np.int64)
        for part in parts:
            for _, some in slices(part.column(0)):
                number, distinct = Terms(some).numbered()
                at = pc.fill_null(pc.index_in(distinct, value_set=wanted), len(wanted)).to_numpy(zero_copy_only=False)
                total += np.bincount(at[number], minlength=len(wanted) + 1)[: len(wanted)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(wanted)), pa.int32()), pa.array(total)], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in counted}
    return {w: n.get(k, 0) for k, w in enumerate(words)}


class Matcher:
    """Templates as sets of word numbers in the global order, and the inverted index of their prefixes."""

    def __init__(self, found: Sequence[Template], frequency: dict[bytes, int], percent: int):
        order = sorted(frequency, key=lambda w: (frequency[w], w))
        rank = {w: k for k, w in enumerate(order)}
        self.order, self.labels = pa.array(order, pa.large_binary()), [t.label for t in found]
        self.size = np.array([len(t.words) for t in found])
        self.least = -(-percent * self.size // 100)  # shared words that are enough
        self.held = np.zeros((len(found), len(order)), bool)
        self.must = np.zeros((len(found), len(order)), bool)
        entries = []
        for k, t in enumerate(found):
            ranks = sorted(rank[w] for w in t.words)
            self.held[k, ranks] = True
            self.must[k, [rank[w] for w in t.must]] = True
            entries += [(r, k, i) for i, r in enumerate(ranks[: len(ranks) - int(self.least[k]) + 1])]
        entries = np.array(sorted(entries), np.int64).reshape(-1, 3)
        self.start = np.searchsorted(entries[:, 0], np.arange(len(order) + 1))
        self.template, self.place = entries[:, 1], entries[:, 2]

    def join(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, shared words) of all matches of the sets given as distinct (block, rank), sorted."""
        first = np.flatnonzero(np.diff(block, prepend=-1))
        size = np.diff(first, append=len(block))
        of = np.repeat(np.arange(len(first)), size)  # blocks by place
        position = np.arange(len(block)) - first[of]
        n = self.start[rank + 1] - self.start[rank]
        row = np.repeat(np.arange(len(block)), n)
        entry = np.repeat(self.start[rank] - np.cumsum(n) + n, n) + np.arange(len(row))
        pair, at = np.unique(of[row] * len(self.size) + self.template[entry], return_index=True)  # at: the first shared word
        row, entry = row[at], entry[at]
        b, t = np.divmod(pair, len(self.size))
        ok = size[b] >= self.least[t]
        ok &= 1 + np.minimum(self.size[t] - self.place[entry] - 1, size[b] - position[row] - 1) >= self.least[t]
        b, t = b[ok], t[ok]
        n = size[b]
        at = np.repeat(first[b] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        pair = np.repeat(np.arange(len(b)), n)
        shared = np.bincount(pair, self.held[t[pair], rank[at]], len(b)).astype(np.int64)
        musts = np.bincount(pair, self.must[t[pair], rank[at]], len(b)).astype(np.int64)
        ok = (shared >= self.least[t]) & (musts == self.must.sum(1)[t])
        return block[first[b[ok]]], t[ok], shared[ok]

    def best(self, block: np.ndarray, template: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """One match a block: the largest share, then the larger template, then the first."""
        order = np.lexsort((template, -self.size[template], -(shared / self.size[template]), block))
        return order[np.flatnonzero(np.diff(block[order], prepend=-1))]


_BLANK = np.isin(np.arange(256), list(b" \t\r"))
_SPACE = np.isin(np.arange(256), list(b" \t\r\n\x0b\x0c"))
_STOP = np.isin(np.arange(256), list(b".!?"))


def blocks(w: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(first word, past the last) of every block of the texts, windows of long ones included, by first word."""
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(_STOP[w.raw[:-1]] & _SPACE[w.raw[1:]])
    ink = np.flatnonzero(~_BLANK[w.raw])
    feeds = w.raw[ink] == 10
    ends = np.concatenate([ends, ink[:-1][feeds[:-1] & feeds[1:]]])
    cut = np.unique(np.concatenate([w.first, np.searchsorted(w.starts, ends, side="right")]))  # a new text is a new block
    a, b = cut[:-1], cut[1:]
    step = WINDOW // 2
    pieces = np.where(b - a > WINDOW, -(-(b - a - step) // step), 1)
    of = np.repeat(np.arange(len(a)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = a[of] + k * step
    return first, np.where(pieces[of] > 1, np.minimum(first + WINDOW, b[of]), b[of])


def phrase_places(number: np.ndarray, distinct: pa.Array, text: np.ndarray, phrase: str) -> np.ndarray:
    """The words at which the phrase's words stand one after the other in one text."""
    wanted = pc.index_in(pa.array([x.encode() for x in phrase.split()], pa.large_binary()), value_set=distinct)
    k = len(wanted)
    if wanted.null_count or len(number) < k:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[: len(number) - k + 1] == wanted[0].as_py())
    for j in range(1, k):
        at = at[(number[at + j] == wanted[j].as_py()) & (text[at + j] == text[at])]
    return at


def scan(docs: DataFrame, rows: Sequence[tuple[str, str, str]] = TEMPLATES, percent: int = PERCENT, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found of every row of docs (doc_id, text).

    base_labels are those of phrases that stand in the text; found has label, first_word, n_words and score (the share
    of the template's words) of each block that matches a template, each by its best one: the largest share, then the
    larger template. labels are both, sorted; score is 1 with a base label, else the best of found, else 0.
    Null, empty and wordless texts have nothing; texts of any length are read whole. Rows that repeat, and rows with a
    null doc_id, are scanned each; other columns are not read, whatever their names; an empty table gives no rows.
    """
    known = templates(rows)
    words = sorted({w for t in known for w in t.words})
    matcher = Matcher(known, frequencies(docs, words), percent) if known else None
    probing = np.zeros(len(words) + 1, bool)
    if matcher:
        probing[:-1] = np.diff(matcher.start) > 0
    item = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])

    def one(texts):
        w = Terms(texts)
        number, distinct = w.numbered()
        text = w.text()
        base: dict[int, list] = {}
        for phrase, label in phrases:
            at = phrase_places(number, distinct, text, phrase)
            for k, n, low, high in _by_text(text[at], at - w.first[text[at]]):
                base.setdefault(k, []).append((label, n, low, high))
        found: dict[int, list] = {}
        if matcher and len(number):
            rank = pc.fill_null(pc.index_in(distinct, value_set=matcher.order), len(words)).to_numpy(zero_copy_only=False)[number]
            first, last = blocks(w)
            seen = np.concatenate([[0], np.cumsum(probing[rank])])
            some = np.flatnonzero(seen[last] > seen[first])  # blocks with a prefix word
            n = last[some] - first[some]
            block = np.repeat(some, n)
            at = np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(len(block))
            known_word = rank[at] < len(words)
            keys = np.unique(block[known_word] * len(words) + rank[at][known_word])
            if len(keys):
                got = matcher.join(*np.divmod(keys, len(words)))
                for i in matcher.best(*got).tolist():
                    b, t, shared = (int(x[i]) for x in got)
                    k = int(text[first[b]])
                    found.setdefault(k, []).append({"label": matcher.labels[t], "first_word": int(first[b] - w.first[k]), "n_words": int(last[b] - first[b]), "score": shared / int(matcher.size[t])})
        return w.counts, base, found

    def run(parts):
        for part in parts:
            out: list[list] = [[] for _ in range(8)]
            for _, some in slices(part.column(1)):
                counts, base, found = one(some)
                for k, n in enumerate(counts.tolist()):
                    b, f = base.get(k, ()), found.get(k, ())
                    labels = {x[0] for x in b}
                    row = (n, sum(x[1] for x in b), min((x[2] for x in b), default=None), max((x[3] for x in b), default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x["label"] for x in f})), 1.0 if b else max((x["score"] for x in f), default=0.0), list(f))
                    for values, x in zip(out, row):
                        values.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(item))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, kind) for v, kind in zip(out, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label string, first_word long, n_words long, score double>>")


def _by_text(text: np.ndarray, at: np.ndarray):
    """(text, places, the first, the last) of sorted places by text."""
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(text)]):
        yield int(text[i]), j - i, int(at[i]), int(at[j - 1])


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {"op13_license_scan": op13_license_scan}
ORACLES: dict[str, str] = {}
