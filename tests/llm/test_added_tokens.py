"""Texts that hold the string of an added token, against a tokenizer left at its defaults."""

import random
import zlib

import numpy as np
import pytest

from tidewright.llm import packing, token_shards
from tidewright.llm._shared import shared_dir
from tidewright.llm._tokens import Encoder, default_vocabulary, encoder

END = "<|endoftext|>"
TEXTS = [f"a {END} b", END, END * 3, f"word{END}word\n{END} \n x", f"<|{END}|>", "<|endoftext|", "plain text", ""]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoder_equals_library_at_its_defaults(tokenizer):
    rng = random.Random(6)
    parts = [*"aß日1 \n\t'.|<>\x00\x1c ", "'s", "  ", "word", END, END, "<|", "|>", "endoftext"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for some in (encoder(default_vocabulary()), Encoder(default_vocabulary(), limit=100, added=True)):
        for at in range(0, len(texts), 97):
            assert [ids(x) for x in some.encode(texts[at : at + 97])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at : at + 97]]


def test_shards_and_packs_hold_the_added_token(spark, tokenizer):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(TEXTS)}
    rows = token_shards.read_shards(token_shards.write_shards(docs, f"{shared_dir(spark)}/added", shards=2)).collect()
    assert {r["doc_id"]: ids(r["ids"]) for r in rows} == {k: [*x, 2] for k, x in want.items()}
    pieces = packing.pack(docs).collect()
    assert {p["doc_id"]: (p["doc_tokens"], p["ids_crc32"]) for p in pieces} == {k: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for k, x in want.items()}
