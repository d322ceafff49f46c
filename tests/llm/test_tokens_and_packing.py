import random
import zlib

import numpy as np
import pytest

from tidewright.llm import packing, token_shards
from tidewright.llm._shared import shared_dir, table
from tidewright.llm._tokens import Encoder, default_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(default_vocabulary())
    out.encode_special_tokens = True
    return out


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_encoder_equals_library(tokenizer):
    rng = random.Random(5)
    parts = list("aéß日1 2\n\t '.,!*sS  \x1c|\x00\x7f\r  　¿» ") + ["'s", "'ll", "\n\n", "  ", "word", "don't", "<|endoftext|>"]
    texts = ["", " ", "\n"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    encoder = Encoder(default_vocabulary(), limit=200)  # most units are forgotten
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        assert [ids(g) for g in encoder.encode(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_shards_round_trip(spark, sf_dir, tokenizer):
    docs = table(spark, sf_dir, "documents").toPandas().sort_values("doc_id")
    got = token_shards.op8_token_shards(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    start = 0
    for k, (doc_id, text) in enumerate(zip(docs["doc_id"], docs["text"])):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        row = got.loc[k]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_shards_of_odd_rows(spark, odd_docs, tokenizer):
    docs = odd_docs
    manifest = token_shards.write_shards(docs, f"{shared_dir(spark)}/t", frame_bytes=4096, shards=3)
    got = token_shards.read_shards(manifest).orderBy("start").collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    assert [ids(r["ids"]) for r in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for _, t in want]
    assert token_shards.write_shards(docs.limit(0), f"{shared_dir(spark)}/e").count() == 0


def test_reader_reads_one_frame_and_finds_damage(tmp_path):
    path = tmp_path / "x.zst"
    with open(path, "wb") as out:
        writer = token_shards.ShardWriter(out, frame_bytes=64)
        for k in range(50):
            writer.add(k, np.arange(k, 2 * k, dtype="<u4").tobytes())
        writer.close()
    size = path.stat().st_size
    with open(path, "rb") as file:
        reader = token_shards.ShardReader(file, size)
        assert len(reader.frames) > 5
        assert [d for k in range(len(reader.frames)) for d, _, _ in reader.read(k)] == list(range(50))
        assert [ids(x) for _, _, x in reader.read(3)] == [list(range(d, 2 * d)) for d, _, _ in reader.read(3)]
    import zstandard

    raw = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert ids(raw) == [x for k in range(50) for x in range(k, 2 * k)]  # any reader reads the whole
    data = bytearray(path.read_bytes())
    data[-40] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as file, pytest.raises(ValueError):
        token_shards.ShardReader(file, size)


@pytest.mark.parametrize("histogram", [{}, {1024: 3, 1: 1}, {700: 1000, 10: 50}, {3: 5}, {512: 4, 511: 1}, {i: i * 7 % 13 for i in range(1, 1024)}])
def test_patterns_place_everything(histogram):
    got: dict[int, int] = {}
    for packs, inside in packing.shortest_pack_first(histogram, 1024):
        assert packs > 0 and sum(inside) <= 1024
        for x in inside:
            got[x] = got.get(x, 0) + packs
    assert got == {k: n for k, n in histogram.items() if n}


def check_pieces(out, texts, tokenizer, size=1024):
    out = out.sort_values(["sequence_id", "offset"])
    by = out.groupby("sequence_id")["length"]
    assert (out["offset"] == by.cumsum() - out["length"]).all() and by.sum().max() <= size
    assert sorted(out["sequence_id"].unique()) == list(range(out["sequence_id"].nunique()))
    for doc_id, pieces in out.dropna(subset="doc_id").groupby("doc_id"):
        want = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        for p in pieces.itertuples():
            part = want[p.start : p.start + p.length]
            assert p.doc_tokens == len(want) and len(part) == p.length and zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        assert pieces["length"].sum() % len(want) == 0


def test_packing(spark, sf_dir, tokenizer):
    docs = table(spark, sf_dir, "documents").toPandas()
    out = packing.op5_packing(spark, sf_dir).toPandas()
    check_pieces(out, {i: t or "" for i, t in zip(docs["doc_id"], docs["text"])}, tokenizer)
    assert out["length"].sum() / out.drop_duplicates("sequence_id")["padded_length"].sum() > 0.95


def test_packing_of_odd_rows(spark, odd_docs, tokenizer):
    out = packing.pack(odd_docs, size=64).toPandas()
    check_pieces(out, {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}, tokenizer, 64)
    assert out["doc_id"].isna().sum() >= 2
    assert packing.pack(odd_docs.limit(0)).count() == 0
