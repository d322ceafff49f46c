"""Token ids in binary shards of independent zstandard frames with a trailing seek table.

A shard file is a run of frames, each an ordinary zstandard frame holding the ids of some whole documents
(little-endian unsigned 32-bit), then one skippable frame with the seek table:

    magic 0x184D2A5E, payload length (both u32)
    per document:  i64 doc_id, u64 first id in the shard, u32 ids
    per frame:     u64 file offset, u32 compressed bytes, u32 raw bytes, u32 crc32 of the raw bytes,
                   u64 first document's index in the shard, u32 documents, i64 first document's id,
                   u32 crc32 of its documents' entries
    footer:        u32 frames, u64 documents, u32 crc32 of the frames' entries, magic 0x544B5348

All integers are little-endian, so any zstandard reader still decompresses the file as a whole. A reader that wants
a few documents reads the footer and the frames' entries, finds their frames by the first ids, which ascend, and
reads those frames and their documents' entries alone.
"""

from __future__ import annotations

import posixpath
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._ranges import dealt
from ._shared import NewFile, filesystem, partitions, shared_dir, staged, table
from ._tokens import batches, default_vocabulary, encoder

END_ID, ROLL_DOCS = 2, 1 << 18
NO_ID = -(1 << 63)  # in a shard, stands for a null doc_id
SKIPPABLE, FOOTER_MAGIC = 0x184D2A5E, 0x544B5348
FRAME = np.dtype([("at", "<u8"), ("packed", "<u4"), ("raw", "<u4"), ("crc", "<u4"), ("first", "<u8"), ("docs", "<u4"), ("first_id", "<i8"), ("docs_crc", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n", "<u4")])
TAIL = struct.Struct("<IQII")


class ShardWriter:
    """Writes one shard to an open binary stream; memory holds one frame and the table."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames, self.docs, self.held, self.size, self.at, self.ids, self.first = [], [], [], 0, 0, 0, 0

    def add(self, doc_id: int, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.frame_bytes:
            self.flush()
        self.docs.append((doc_id, self.ids, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        self.ids += len(ids) // 4

    def flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        entries = self.docs[self.first :]
        self.frames.append((self.at, len(packed), len(raw), zlib.crc32(raw), self.first, len(self.held), entries[0][0], zlib.crc32(np.array(entries, DOC).tobytes())))
        self.at += len(packed)
        self.first += len(self.held)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        docs, frames = np.array(self.docs, DOC).tobytes(), np.array(self.frames, FRAME).tobytes()
        tail = TAIL.pack(len(self.frames), len(self.docs), zlib.crc32(frames), FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(docs) + len(frames) + len(tail)) + docs + frames + tail)


class ShardReader:
    """Random access to one shard through an input file with seek and read."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        n_frames, n_docs, crc, magic = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if magic != FOOTER_MAGIC:
            raise ValueError("not a token shard: bad footer")
        length = n_frames * FRAME.itemsize
        frames = self._read(size - TAIL.size - length, length)
        if zlib.crc32(frames) != crc:
            raise ValueError("token shard: seek table is damaged")
        self.frames = np.frombuffer(frames, FRAME)
        self.docs_at = size - TAIL.size - length - n_docs * DOC.itemsize

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        f = self.frames[k]
        raw = self.unpack.decompress(self._read(int(f["at"]), int(f["packed"])), max_output_size=int(f["raw"]))
        if len(raw) != f["raw"] or zlib.crc32(raw) != f["crc"]:
            raise ValueError(f"token shard: frame {k} is damaged")
        return raw

    def entries(self, k: int) -> np.ndarray:
        """The documents of frame k: doc_id, first id in the shard, number of ids."""
        f = self.frames[k]
        raw = self._read(self.docs_at + int(f["first"]) * DOC.itemsize, int(f["docs"]) * DOC.itemsize)
        if zlib.crc32(raw) != f["docs_crc"]:
            raise ValueError(f"token shard: entries of frame {k} are damaged")
        return np.frombuffer(raw, DOC)

    def read(self, k: int, wanted: set[int] | None = None):
        """(doc_id, first id in the shard, ids) of each document of frame k, or of the wanted ones: without any, the frame is not read."""
        docs = self.entries(k)
        if wanted is not None and not wanted.intersection(docs["doc_id"].tolist()):
            return
        raw, base = self.frame(k), int(docs[0]["start"]) if len(docs) else 0
        for d in docs:
            if wanted is None or int(d["doc_id"]) in wanted:
                i = (int(d["start"]) - base) * 4
                yield int(d["doc_id"]), int(d["start"]), raw[i : i + int(d["n"]) * 4]

    def find(self, wanted: set[int]):
        """(doc_id, first id in the shard, ids) of the documents with the wanted ids, from the frames that may hold them."""
        first = self.frames["first_id"]
        ids = np.array(sorted(wanted), np.int64)
        low, high = np.searchsorted(first, ids, "left") - 1, np.searchsorted(first, ids, "right")
        for k in sorted({k for i, j in zip(low.tolist(), high.tolist()) for k in range(max(i, 0), j)}):
            yield from self.read(k, wanted)


MANIFEST = "range int, part int, path string, file_bytes long, n_docs long, n_ids long, n_frames int, table_crc32 long, first_id long, last_id long"


def write_shards(docs: DataFrame, out_dir: str, vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None, frame_bytes: int = 1 << 20, roll_bytes: int = 256 << 20, roll_docs: int = ROLL_DOCS) -> DataFrame:
    """Encodes docs (doc_id, text; other columns are ignored, whatever their names), and writes shards in ascending doc_id order below out_dir.

    Ranges of ids, whose bounds depend on the ids alone, are written side by side; within one a new shard begins when
    the last has roll_bytes of ids or roll_docs documents, so the table that a task holds is bounded. A shard is written to a temporary name and renamed; the manifest, one row a shard,
    is what Spark commits, so a task that runs twice leaves one shard, of the same bytes. Null texts count as empty;
    empty texts are the end id alone; a very long text is one document of one frame. Equal doc_ids (ties) keep one
    record a row, in order of their text; rows with a null doc_id come first and read back with a null doc_id. An
    empty table gives no shard.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    end = struct.pack("<I", end_id)

    def write(parts):
        encode, done = encoder(path).encode, []
        out = writer = place = None

        def close():
            writer.close()
            out.commit()
            done.append((place, nth, name, out.size, len(writer.docs), writer.ids, len(writer.frames), zlib.crc32(np.array(writer.frames, FRAME).tobytes()), writer.docs[0][0], writer.docs[-1][0]))

        try:
            for part in parts:
                ids, places = part.column(1).to_pylist(), part.column(0).to_pylist()
                for first, texts in batches(part.column(2)):
                    for k, got in enumerate(encode(texts), first):
                        if places[k] != place or writer.ids * 4 >= roll_bytes or len(writer.docs) >= roll_docs:
                            if writer is not None:
                                close()
                            nth = nth + 1 if places[k] == place else 0
                            place = places[k]
                            name = posixpath.join(out_dir, f"tokens-{place:06d}-{nth:04d}.zst")
                            out = NewFile(name)
                            writer = ShardWriter(out, frame_bytes)
                        writer.add(ids[k], got + end)
            if writer is not None:
                close()
        except BaseException:
            if out is not None and (not done or done[-1][2] != name):
                out.abandon()
            raise
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3)
        names = "range part path file_bytes n_docs n_ids n_frames table_crc32 first_id last_id".split()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 10, kinds)], names=names)

    spread = dealt(rows, "doc_id", shards or partitions(spark)).sortWithinPartitions("range", "doc_id", "text")
    return staged(spread.select("range", "doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")


def _starts(manifest: DataFrame) -> DataFrame:
    """manifest with base, the ids of all shards before: a window over one row a shard."""
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _rows(got: list, base: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([None if x[0] == NO_ID else x[0] for x in got], pa.int64()), "start": pa.array([base + x[1] for x in got], pa.int64()),
        "n_tokens": pa.array([len(x[2]) // 4 for x in got], pa.int64()), "ids": pa.array([x[2] for x in got], pa.binary()),
    })


class _Open:
    """The shard that is being read; another path closes it."""

    def __init__(self):
        self.name, self.file, self.reader = None, None, None

    def shard(self, path: str, size: int) -> ShardReader:
        if path != self.name:
            self.close()
            fs, at = filesystem(path)
            self.file, self.name = fs.open_input_file(at), path
            self.reader = ShardReader(self.file, size)
        return self.reader

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of every document, frame by frame."""
    frames = _starts(manifest).select("path", "file_bytes", "base", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"))
    frames = frames.repartition(partitions(manifest.sparkSession), "path", F.floor(F.col("frame") / 16))

    def read(parts):
        held = _Open()
        for part in parts:
            for row in part.to_pylist():
                yield _rows(list(held.shard(row["path"], row["file_bytes"]).read(row["frame"])), row["base"])
        held.close()

    return frames.sortWithinPartitions("path", "frame").mapInArrow(read, ROWS)


def read_documents(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents with the doc_ids of ids; those without a document give no row.

    Only the frames that hold one are decompressed. One row a shard is broadcast, to find the shards of an id. Null
    ids, which have no place in the order, are not looked up; ids that repeat are looked up once.
    """
    spark = manifest.sparkSession
    shards = _starts(manifest).orderBy("range", "part").select("path", "file_bytes", "base", "first_id", "last_id").collect()  # a row for each roll_bytes of ids
    firsts, lasts = (np.array([r[c] for r in shards], np.int64) for c in ("first_id", "last_id"))
    shared = spark.sparkContext.broadcast((shards, firsts, lasts))

    def place(parts):
        _, firsts, lasts = shared.value
        for part in parts:
            x = part.column(0).to_numpy()
            low, high = np.searchsorted(lasts, x, "left"), np.searchsorted(firsts, x, "right")
            n = np.maximum(high - low, 0)
            shard = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.repeat(x, n), pa.int64())], names=["shard", "doc_id"])

    def read(parts):
        held, at, wanted = _Open(), None, set()

        def found():
            row = shared.value[0][at]
            return _rows(list(held.shard(row["path"], row["file_bytes"]).find(wanted)), row["base"])

        for part in parts:
            for shard, doc_id in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if shard != at or len(wanted) >= 1000:
                    if wanted:
                        yield found()
                    at, wanted = shard, set()
                wanted.add(doc_id)
        if wanted:
            yield found()
        held.close()

    known = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    placed = known.mapInArrow(place, "shard int, doc_id long").repartition(partitions(spark), "shard", F.floor(F.col("doc_id") / 4096))
    return placed.sortWithinPartitions("shard", "doc_id").mapInArrow(read, ROWS)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), posixpath.join(shared_dir(spark), "tokens"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_shards": op8_token_shards}
ORACLES: dict[str, str] = {}
