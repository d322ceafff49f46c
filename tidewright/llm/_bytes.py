"""Words of whole Arrow columns, taken from their UTF-8 buffers without a Python string for any text.

A word is a maximal run of bytes that are digits, ASCII letters or above 0x7F, with A-Z as a-z: over characters,
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: 0 for bytes between words, else the byte with A-Z in lower case.
WORD = np.arange(256, dtype=np.uint8)
WORD[65:91] += 32
WORD[[b for b in range(128) if not chr(b).isalnum()]] = 0


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) with a bounded number of bytes each, one row at least."""
    _, at = utf8(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, side="right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


class Terms:
    """The words of texts: folded bytes, starts and ends of words, words of each text and its first word (and past the last)."""

    def __init__(self, texts: pa.Array):
        self.raw, self.at = utf8(texts)
        self.n = len(texts)
        self.data = WORD[self.raw]
        inside = (self.data != 0).astype(np.int8)
        begin = np.diff(inside, prepend=0) > 0
        firsts = self.at[:-1][self.at[:-1] < self.at[1:]]
        begin[firsts] = inside[firsts] > 0  # a word does not go on in the next text
        stop = inside > 0
        stop[:-1] &= (inside[1:] == 0) | begin[1:]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)

    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word, the distinct words by number)."""
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[self.data != 0]))])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
