"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, which
is the pattern [^\\x20\\x09-\\x0D]+ over characters. Texts are laid end to end with a line feed after each, so
one set of array operations serves a whole batch. Words and lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        p = np.full(max(n, 2 * len(_POWERS[0])), _BASE, np.uint64)
        p[0] = 1
        _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last indices of each run of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of these runs, in order and without overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    within = np.arange(int(lengths.sum()))
    at = within + np.repeat(starts - first, lengths)
    within -= np.repeat(first, lengths)
    values = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) ^ lengths.astype(np.uint64))


class Words:
    """bytes, word starts and ends, hashes, first word and first byte of each text (and past the last)."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        encoded = [(t or "").encode() for t in texts]
        self.n = len(encoded)
        self.data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.at = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(e) + 1 for e in encoded], out=self.at[1:])
        self.inside = ~SPACE[self.data]
        self.starts, self.ends = runs(self.inside)
        self.hashes = run_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n), self.counts)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each text where mask holds."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of k words within a text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: n or None] == self.text[k - 1 :]) if k > 1 else np.arange(n)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at + j]
        return at, mix(h)


def groups(texts, most_chars: int = 300_000):
    """(first index, texts) with a bounded number of characters each, one text at least; an Arrow column is read bit by bit."""
    run, size, first = [], 0, 0
    for i, t in enumerate((x.as_py() for x in texts) if isinstance(texts, pa.Array) else texts):
        n = len(t) if t else 0
        if run and size + n > most_chars:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += n
    if run:
        yield first, run
