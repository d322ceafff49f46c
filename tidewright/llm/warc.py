"""WARC 1.1 archives written in parallel, the same bytes at every run, and read back.

Pages are range-sorted by id together with the ids of the first page of each repeated payload, in ranges whose
bounds depend on the ids alone. Each task streams its range into files that roll when their compressed size passes
a limit, one gzip member a record, with headers and digests made anew. A file is written to a temporary name and
renamed; the manifest, one row a file, is what Spark commits, so a task that runs twice leaves the same files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._ranges import bounds, range_of
from ._shared import NewFile, filesystem, partitions, shared_dir, staged, table
from ._skew import spread_join

DATE = "2000-01-01T00:00:00Z"  # no clock in the files, unless a date is given
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "range int, part int, path string, file_bytes long, n_records long, first_id long, last_id long"


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC-Payload-Digest has it after sha1:."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str, nth: int = 0) -> str:
    """A record's urn, from the page's id, its payload's digest and its number among rows of that id and payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'page:{page_id}:{sha}:{nth}')}>"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")


def record(page_id: int | None, nth: int, url: str | None, payload: bytes, refers_to: tuple[int, str] | None, date: str = DATE) -> bytes:
    """One record, compressed as a gzip member. refers_to: id and url of the response that a revisit repeats."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if refers_to is None else b""
    block = http + body
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha, nth)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)),
        *([("WARC-Page-ID", page_id)] if page_id is not None else []), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Payload-Length", len(payload)), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], sha)), ("WARC-Refers-To-Page-ID", refers_to[0]), ("WARC-Refers-To-Target-URI", _clean(refers_to[1]))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    raw = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=6, mtime=0)


def first_of_payload(pages: DataFrame, least: int) -> DataFrame:
    """page_id, sha, first_id, first_url of the rows whose payload, of least bytes at least, more than one row has."""
    rows = pages.select("page_id", "url", "sha", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = rows.groupBy("sha", "n").agg(F.count("*").alias("copies"), F.min(known).alias("first")).where("copies > 1 and first is not null")
    first = first.select("sha", "n", "copies", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return spread_join(rows, first, ["sha", "n"], "copies", ["page_id", "url"]).select("page_id", "sha", "first_id", "first_url").distinct()


def write_warc(pages: DataFrame, out_dir: str, least: int = 0, roll_bytes: int = 64 << 20, ranges: int | None = None, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) below out_dir and returns the manifest.

    The payload is the html in UTF-8, a null html an empty one, a null url about:blank; a payload of any length is
    one record. Of equal payloads of at least ``least`` bytes the row with the smallest page_id is the response and
    the others revisit it; of rows with that same page_id (ties) that with the smallest url is the response. A row
    without page_id revisits a row with one, if that has its payload, and is a response else; it reads back without
    id. Other columns are ignored, whatever their names; an empty table gives no file.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    firsts = first_of_payload(rows, least).select("page_id", F.col("first_url").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha", "first_id")
    # a page and what is known of its payload meet in a range of ids, the second right before the pages with that payload
    at = bounds(rows.select("page_id"), "page_id", ranges or partitions(spark))
    both = rows.withColumn("first_id", F.lit(None).cast("long")).unionByName(firsts).withColumn("range", range_of(F.col("page_id"), at))
    dealt = both.repartitionById(len(at) + 1, "range").sortWithinPartitions("range", "page_id", "sha", F.col("payload").isNotNull(), "url")

    def write(parts):
        files, held, nth, first = Files(out_dir, roll_bytes), None, 0, None
        try:
            for part in parts:
                for place, page_id, url, payload, sha, first_id in ((part.column(k)[i].as_py() for k in range(6)) for i in range(part.num_rows)):
                    if (page_id, sha) != held:
                        held, nth, first = (page_id, sha), 0, None
                    if payload is None:
                        first = (first_id, url)
                        continue
                    itself = first is not None and first[0] == page_id and nth == 0
                    files.add(place, page_id, record(page_id, nth, url, payload, None if itself or len(payload) < least else first, date))
                    nth += 1
            files.close()
        except BaseException:
            files.abandon()
            raise
        kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*files.done) if files.done else [[]] * 7, kinds)], names=["range", "part", "path", "file_bytes", "n_records", "first_id", "last_id"])

    return staged(dealt.select("range", "page_id", "url", "payload", "sha", "first_id").mapInArrow(write, MANIFEST), "warc-manifest")


class Files:
    """The files of ranges that come in order; a new one begins with a range and when the last has roll_bytes."""

    def __init__(self, out_dir: str, roll_bytes: int):
        self.out_dir, self.roll_bytes, self.out, self.done, self.place, self.part = out_dir, roll_bytes, None, [], None, 0

    def add(self, place: int, page_id: int | None, packed: bytes) -> None:
        if place != self.place:
            self.close()
            self.place, self.part = place, 0
        if self.out is None:
            self.name = posixpath.join(self.out_dir, f"pages-{place:06d}-{self.part:04d}.warc.gz")
            self.out, self.records, self.first = NewFile(self.name), 0, page_id
        self.out.write(packed)
        self.records += 1
        self.last = page_id
        if self.out.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.commit()
            self.done.append((self.place, self.part, self.name, self.out.size, self.records, self.first, self.last))
            self.out, self.part = None, self.part + 1

    def abandon(self) -> None:
        if self.out is not None:
            self.out.abandon()


def members(file, chunk: int = 1 << 20):
    """The gzip members of an open file, decompressed one at a time."""
    data = b""
    while True:
        if not data:
            data = file.read(chunk)
            if not data:
                return
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data:
                data = file.read(chunk)
                if not data:
                    raise ValueError("WARC file ends inside a record")
            out.append(unpack.decompress(data))
            data = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (the HTTP body) of a record, after checking its block digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged WARC record {headers.get('WARC-Record-ID')}")
    return headers, block.partition(b"\r\n\r\n")[2]


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (empty for a revisit) of every record."""
    files = manifest.select("path").repartition(max(partitions(manifest.sparkSession), 1), "path")

    def read(parts):
        for part in parts:
            for path in part.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(at, compression=None) as file:
                    held, size = [], 0
                    for raw in members(file):
                        headers, payload = parse(raw)
                        sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and digest(payload) != sha:
                            raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
                        refers = headers.get("WARC-Refers-To-Page-ID")
                        held.append((int(headers["WARC-Page-ID"]) if "WARC-Page-ID" in headers else None, headers["WARC-Target-URI"], headers["WARC-Type"], int(headers["WARC-Payload-Length"]), sha, refers and int(refers), payload))
                        size += len(payload)
                        if size > 8 << 20 or len(held) >= 2000:
                            yield batch(held)
                            held, size = [], 0
                    if held:
                        yield batch(held)

    def batch(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return files.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), posixpath.join(shared_dir(spark), "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
ORACLES: dict[str, str] = {}
