"""Whole texts to token ids with the tokenizers library, remembering the ids of units met before.

A byte-level BPE encodes each of a text's words by itself, and its pattern parts words in places that can be
told from the bytes around them: before a space that a non-space follows, between a visible ASCII character
and white space, beside a lone line end, and between ASCII letters and marks. A text is cut there into units,
whose ids in a row are the text's. Units of a whole batch are hashed and looked up at once in sorted arrays;
only new ones go to the library. Memory is bounded: past ``limit`` units, new ones are encoded and forgotten.
"""

from __future__ import annotations

import json
import re

import numpy as np

from ._words import groups, run_hashes

#: Byte-level models write each byte as a character: printable bytes as themselves, the others from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _table(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


VISIBLE = _table(range(0x21, 0x7F))
#: First bytes of what is surely no white space: the lead bytes of all wide white space are left out.
SOLID = VISIBLE | _table(set(range(0xC3, 0x100)) - {0xE1, 0xE2, 0xE3})
BLANK = _table([0x20, *range(0x09, 0x0E)])
BREAK = _table(range(0x09, 0x0E))
ALPHA = _table([*range(65, 91), *range(97, 123)])
MARK = _table(b".,;:!?*#$%&|<>()")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a unit may begin: True at p if data parts before p. Any other byte below 0x21 may stand between texts."""
    out = np.zeros(len(data), bool)
    solid, visible, blank, alpha, mark = SOLID[data], VISIBLE[data], BLANK[data], ALPHA[data], MARK[data]
    out[:-1] |= (data[:-1] == 0x20) & solid[1:]
    out[1:] |= blank[1:] & visible[:-1]
    out[2:] |= solid[2:] & BREAK[data[1:-1]] & visible[:-2]
    out[1:] |= (alpha[:-1] & mark[1:]) | (mark[:-1] & alpha[1:])
    return out


def by_unit(file: dict) -> bool:
    """Whether a tokenizer file is of the kind whose texts may be cut into units: byte-level BPE with its usual pattern."""
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    around = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file.get("added_tokens", ()))
    return plain and model["type"] == "BPE" and not any(model.get(k) for k in odd) and not file.get("normalizer") and not around


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers in one bytes object.

    added: strings of the vocabulary's added tokens become their ids, as with a tokenizer at its defaults; else
    those of special tokens are ordinary text. A file of another kind than byte-level BPE without a normalizer, for
    which texts cannot be cut like this, is used for whole texts, as the library does.
    """

    def __init__(self, path: str, limit: int = 1_500_000, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_unit = by_unit(json.loads(self.tokenizer.to_str()))
        if not self.by_unit:
            self.tokenizer.encode_special_tokens = not added
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            return
        self.tokenizer.encode_special_tokens = True  # units are parts of texts, where no such string is left whole
        tokens = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        self.added = {text: np.array([i], "<u4").tobytes() for text, (i, _) in tokens.items()}
        # the library takes the leftmost token, and the longest of those
        self.between = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if tokens else None
        kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.limit, self.pool, self.used = limit, np.zeros(1 << 16, kind), 0
        self.keys, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _new(self, words: list[str]) -> list[list[int]]:
        """Ids of new units: letters alone are one word of the model, the rest goes through the whole tokenizer."""
        one, out, rest = self.tokenizer.model.tokenize, [], []
        for k, word in enumerate(words):
            letters = word[1:] if word[0] == " " else word
            if letters.isalpha():
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(_BYTE_CHARS)
                out.append([t.id for t in one("Ġ" + letters if word[0] == " " else letters)])
            else:
                rest.append(k)
                out.append([])
        for k, got in zip(rest, self.tokenizer.encode_batch([words[k] for k in rest], add_special_tokens=False)):
            out[k] = got.ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            got = (self.tokenizer.encode_batch(some, add_special_tokens=False) for _, some in groups(texts, 100_000))
            return [np.array(x.ids, "<u4").tobytes() for some in got for x in some]
        if self.between is None:
            return self._encode(texts)
        parts = [self.between.split(t) for t in texts]  # every second one is a token
        ids = iter(self._encode([x for p in parts for x in p[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(ids) for k, x in enumerate(p)) for p in parts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\0".join([b"", *raw, b""]), np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        begin = np.cumsum(sizes + 1) - sizes  # of each text in data
        part = cuts(data)
        part[begin] = True
        part[begin + sizes] = True  # the byte between texts, a unit that is left out
        starts = np.flatnonzero(part)
        ends = np.append(starts[1:], len(data))
        kept = np.ones(len(starts), bool)
        kept[np.searchsorted(starts, begin + sizes)] = False
        starts, ends = starts[kept], ends[kept]
        hashes, first, unit = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, hashes)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == hashes[known]
        at, length = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32)
        at[known], length[known] = self.at[found[known]], self.length[found[known]]
        new = np.flatnonzero(~known)
        used = self.used
        if len(new):
            flat = data.tobytes()
            ids = self._new([flat[i:j].decode() for i, j in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            length[new] = [len(x) for x in ids]
            at[new] = used + np.cumsum(length[new]) - length[new]
            used += int(length[new].sum())
            if used > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), used - len(self.pool)), self.pool.dtype)])
            self.pool[self.used : used] = [i for x in ids for i in x]
        length_of, at_of = length[unit].astype(np.int64), at[unit]
        total = np.zeros(len(unit) + 1, np.int64)
        np.cumsum(length_of, out=total[1:])
        ids = self.pool[np.arange(total[-1]) + np.repeat(at_of - total[:-1], length_of)].astype("<u4").tobytes()
        if len(new) and len(self.keys) + len(new) <= self.limit:
            place = np.searchsorted(self.keys, hashes[new])
            self.keys, self.at, self.length = np.insert(self.keys, place, hashes[new]), np.insert(self.at, place, at[new]), np.insert(self.length, place, length[new])
            self.used = used
        bounds = (total[np.searchsorted(starts, np.append(begin, len(data)))] * 4).tolist()
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker, with the ids of a tokenizer at its defaults."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]


def batches(texts, most_chars: int = 700_000):
    """(first index, texts) as groups() has them, with empty texts for nulls."""
    for first, run in groups(texts, most_chars):
        yield first, [t or "" for t in run]
