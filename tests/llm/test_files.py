"""Files that are the same at every run, lookups that read little, tokenizers of other kinds, packs by the plain algorithm."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import packing, token_shards, warc
from tidewright.llm._ranges import bounds
from tidewright.llm._shared import NewFile, shared_dir
from tidewright.llm._tokens import Encoder, by_unit, default_vocabulary


def contents(manifest):
    return {os.path.basename(r["path"]): open(r["path"].removeprefix("file://"), "rb").read() for r in manifest.collect()}


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.range(40_000, numPartitions=7).select(((F.col("id") * 7919) % 40_000).alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(F.lit("page "), (F.col("id") % 30_000).cast("string")).alias("html"))
    return rows.unionAll(rows.where("page_id % 1000 = 0"))


def test_archives_are_the_same_bytes(spark, pages):
    one = contents(warc.write_warc(pages, f"{shared_dir(spark)}/a", roll_bytes=1 << 20, ranges=8))
    two = contents(warc.write_warc(pages.repartition(3), f"{shared_dir(spark)}/b", roll_bytes=1 << 20, ranges=8))
    assert len(one) >= 8 and one == two
    read = warc.read_warc(warc.write_warc(pages, f"{shared_dir(spark)}/c", ranges=5))
    assert read.count() == 40_040 and read.where("record_type = 'response'").count() == 30_000


def test_refers_to_names_the_response(spark):
    data = [(3, "u", "a"), (3, "v", "b"), (3, "w", "c"), (7, "x", "b"), (8, "y", "c"), (3, "z", "c")]
    raw = b"".join(contents(warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string"), f"{shared_dir(spark)}/r")).values())
    records = [warc.parse(m)[0] for m in warc.members(__import__("io").BytesIO(raw))]
    responses = {r["WARC-Record-ID"]: r["WARC-Payload-Digest"] for r in records if r["WARC-Type"] == "response"}
    assert len(records) == len({r["WARC-Record-ID"] for r in records}) == 6 and len(responses) == 3
    assert all(responses[r["WARC-Refers-To"]] == r["WARC-Payload-Digest"] for r in records if r["WARC-Type"] == "revisit")


def test_shards_are_the_same_bytes_and_roll(spark, pages):
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    first = token_shards.write_shards(docs, f"{shared_dir(spark)}/s", shards=6, roll_bytes=40_000)
    assert first.agg(F.max("part")).first()[0] >= 1
    assert contents(first) == contents(token_shards.write_shards(docs.repartition(3), f"{shared_dir(spark)}/t", shards=6, roll_bytes=40_000))
    whole = token_shards.read_shards(first).orderBy("start").toPandas()
    assert whole["doc_id"].is_monotonic_increasing and (whole["start"] == whole["n_tokens"].cumsum() - whole["n_tokens"]).all() and len(whole) == 40_040


def test_wanted_documents_alone_are_read(spark, pages, tmp_path):
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    manifest = token_shards.write_shards(docs, f"{shared_dir(spark)}/f", shards=3, frame_bytes=2048)
    ids = spark.createDataFrame([(0,), (1000,), (1000,), (17,), (39_999,), (50_000,), (-4,), (None,)], "doc_id long")
    key = lambda r: (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"]))
    got = sorted(map(key, token_shards.read_documents(manifest, ids).collect()))
    assert got == sorted(key(r) for r in token_shards.read_shards(manifest).where("doc_id in (0, 1000, 17, 39999)").collect()) and len(got) == 6

    class Counting:
        def __init__(self, file):
            self.file, self.n = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.n += n
            return self.file.read(n)

    row = manifest.orderBy("range").first()
    with open(row["path"].removeprefix("file://"), "rb") as file:
        counting = Counting(file)
        reader = token_shards.ShardReader(counting, row["file_bytes"])
        table = counting.n
        assert table < 0.1 * row["file_bytes"] and [d for d, _, _ in reader.find({17})] == [17]
        assert counting.n - table < 0.02 * row["file_bytes"]


def test_a_second_attempt_leaves_the_file(tmp_path):
    for k in range(2):
        out = NewFile(f"{tmp_path}/d/x")
        out.write(b"abc")
        out.commit()
    lost = NewFile(f"{tmp_path}/d/x")
    lost.write(b"ab")
    lost.abandon()
    assert (tmp_path / "d/x").read_bytes() == b"abc" and len(list((tmp_path / "d").iterdir())) == 1


def test_bounds_follow_the_keys(spark):
    rows = spark.range(20_000).selectExpr("if(id < 7000, 5, id * id) as k")
    at = bounds(rows, "k", 10)
    assert at == bounds(rows.repartition(3), "k", 10) == sorted(set(at)) and 5 <= len(at) <= 9
    assert bounds(rows.limit(0), "k", 10) == [] and bounds(rows.selectExpr("cast(null as long) as k"), "k", 4) == []


def test_other_tokenizers_are_used_for_whole_texts():
    import json

    from tokenizers import Tokenizer

    path = os.path.join(os.path.dirname(default_vocabulary()), "word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), ["Don't stop,  now!\n", "", "naïve 日本 text " * 50]
    encoder = Encoder(path, added=True)
    assert encoder.by_unit == by_unit(json.loads(library.to_str()))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert by_unit(json.load(open(default_vocabulary()))) and not by_unit({**json.load(open(default_vocabulary())), "normalizer": {"type": "NFC"}})


def plain(histogram, size):
    """Each piece, longest first, into the shortest pack that has room."""
    packs = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        k = min((k for k in range(len(packs)) if packs[k] + x <= size), key=packs.__getitem__, default=None)
        if k is None:
            packs.append(x)
        else:
            packs[k] += x
    return sorted(packs)


def test_packs_are_those_of_the_plain_algorithm():
    rng = np.random.default_rng(1)
    histograms = [{600: 1, 950: 1, 50: 3}] + [{int(x): int(rng.integers(1, 30)) for x in rng.integers(1, 1025, rng.integers(1, 12))} for _ in range(60)]
    for h in histograms:
        assert sorted(sum(inside) for n, inside in packing.shortest_pack_first(h, 1024) for _ in range(n)) == plain(h, 1024)
