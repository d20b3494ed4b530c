"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle is its
frames followed by a skippable frame with the seek table (sizes of every frame) and
the seekable format's footer. Next to each bundle stand the identifiers of its records
with frame number and offset within the frame, so that one record costs one frame.

Bundles are binary cells of a table: Spark writes and reads them in any store, and a
lost executor's bundles are written anew by the task that replaces its task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Work

# Fixed values of the Zstandard seekable format and of WARC 1.1
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 1 << 20
#: Smaller payloads are always stored, as a revisit would hardly be shorter.
REVISIT_BYTES = 1000
#: Repeated payloads up to which Spark alone chooses their join with the pages; beyond, a Bloom filter keeps other pages out of it.
PICK = 1_000_000
ARCHIVE = "bundle string, data binary, ids array<string>, frames array<int>, offsets array<long>, lengths array<long>"
RECORDS = "record_id string, page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_ARCHIVE = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("ids", pa.list_(pa.string())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_RECORDS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def record_uri(page_id: int | None) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}"


def page_of(uri: str) -> int | None:
    last = uri.strip("<>").rpartition(":")[2]
    return None if last == "null" else int(last)


def make_record(page_id, url, payload: bytes | None, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One WARC record. A revisit has the response's headers, but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"") if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_uri(page_id)}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{record_uri(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Fields, block and end of the record that starts at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(fields["Content-Length"])
    return fields, data[end + 4 : stop], stop + 4


class Bundle:
    """Collects records into frames and frames into one seekable bundle."""

    def __init__(self, level: int = 3):
        self._packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.done: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.bytes = 0
        self._open = bytearray()
        self.ids, self.frames, self.offsets, self.lengths = [], [], [], []

    def add(self, name: str, record: bytes) -> None:
        for column, x in ((self.ids, name), (self.frames, len(self.done)), (self.offsets, len(self._open)), (self.lengths, len(record))):
            column.append(x)
        self._open += record
        if len(self._open) >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._open:
            packed = self._packer.compress(bytes(self._open))
            self.done.append(packed)
            self.sizes.append((len(packed), len(self._open)))
            self.bytes += len(packed)
            self._open = bytearray()

    def close(self) -> bytes:
        self._close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        body = entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.done) + struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, raw) of every frame, read from the bundle's end."""
    count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out, start = len(data) - 9 - count * width, [], 0
    if struct.unpack_from("<II", data, at - 8) != (SKIPPABLE_MAGIC, count * width + 9):
        raise ValueError("seek table's frame is damaged")
    for k in range(count):
        packed, raw = struct.unpack_from("<II", data, at + k * width)
        out.append((start, packed, raw))
        start += packed
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, raw = frame
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=raw)


def read_one(data: bytes, frame: int, offset: int) -> tuple[dict, bytes]:
    """The record at an offset of a frame; no other frame is touched."""
    fields, block, _ = parse_record(read_frame(data, seek_table(data)[frame]), offset)
    return fields, block


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    bundle = Bundle()

    def flush() -> pa.RecordBatch:
        data = bundle.close()
        return pa.RecordBatch.from_pylist([{"bundle": f"{part:06d}-{n:06d}", "data": data, "ids": bundle.ids, "frames": bundle.frames, "offsets": bundle.offsets, "lengths": bundle.lengths}], schema=_ARCHIVE)

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to")]
        for values in zip(*columns, strict=True):
            page_id, url, html, digest, size, kind, refers_to = (v.as_py() for v in values)
            payload = None if html is None else html.encode()
            bundle.add(record_uri(page_id), make_record(page_id, url, payload, digest, size, kind, refers_to))
            if bundle.bytes >= BUNDLE_BYTES:
                yield flush()
                bundle, n = Bundle(), n + 1
    if bundle.ids:
        yield flush()


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            data = batch.column(batch.schema.get_field_index("data"))[k].as_py()
            index = list(zip(*(batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("ids", "frames", "offsets")), strict=True))
            rows, seen = [], 0
            for f, frame in enumerate(seek_table(data)):
                raw, at = read_frame(data, frame), 0
                while at < len(raw):
                    if index[seen] != (parse_record(raw, at)[0]["WARC-Record-ID"].strip("<>"), f, at):
                        raise ValueError(f"the index disagrees with record {seen} of the bundle")
                    fields, block, at = parse_record(raw, at)
                    rows.append(_row(fields, block, payloads))
                    seen += 1
            if seen != len(index):
                raise ValueError("the index has more records than the bundle")
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)


def _row(fields: dict, block: bytes, payloads: bool) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, back = fields["WARC-Type"], None
    if kind == "response":
        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload read back differs")
    else:
        back = page_of(fields["WARC-Refers-To"])
    name = fields["WARC-Record-ID"].strip("<>")
    return {"record_id": name, "page_id": page_of(name), "target_uri": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": back, "payload": payload if payloads and kind == "response" else None}


def write_archive(pages: DataFrame, work: Work, least: int = REVISIT_BYTES) -> DataFrame:
    """The archive (ARCHIVE's columns) of ``pages`` (page_id, url, html), written to the shared folder.

    Of records with equal payloads of at least ``least`` bytes, the one with the largest
    page_id is a response, the others are revisits without payload. A null html is an
    empty payload; a null page_id sorts below all others. Rows that repeat the largest
    page_id are responses all. No rows give no bundles; other columns, whatever their names,
    don't matter. A very long payload is one record in a frame of its own, in memory whole in
    the tasks that write and read it. Pages are shuffled only where their payload repeats and
    Spark finds the table of repeated payloads too large to broadcast.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    rows = pages.select("page_id", "url", "html", size.alias("payload_bytes"), F.sha1(F.coalesce("html", F.lit(""))).alias("payload_digest"))
    # one row per payload that repeats; partial sums leave little of a hot payload to shuffle
    copies = rows.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    copies = work.keep(copies.filter("n > 1 and first_id is not null").drop("n"), "copies")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    columns = [
        "page_id", "url", "payload_bytes", "payload_digest",
        F.when(again, F.lit(None)).otherwise(F.col("html")).alias("html"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    ]
    alone = None
    if (n := copies.count()) > PICK:
        bits = bloom.sent(copies.select(F.unhex("digest").alias("digest")), "digest", n)
        told = bloom.with_hits(rows.withColumn("raw", F.unhex("payload_digest")), "raw", bits)
        rows, alone = told.filter("hit"), told.filter("not hit").withColumn("first_id", F.lit(None).cast("long")).select(columns)
    judged = rows.join(copies, F.col("payload_digest") == F.col("digest"), "left").select(columns)
    judged = judged if alone is None else judged.unionByName(alone)
    bundles = judged.mapInArrow(_write, ARCHIVE)
    path = f"{work.root}/archive"
    bundles.write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(path)
    return work.spark.read.schema(bundles.schema).parquet(path)


def read_archive(archive: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the bundles (RECORDS' columns), checked against index and digest."""
    return archive.mapInArrow(lambda batches: _read(batches, payloads), RECORDS)


def index_of(archive: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset, length: where each record lies."""
    entry = F.explode(F.arrays_zip("ids", "frames", "offsets", "lengths")).alias("e")
    return archive.select("bundle", entry).select(F.col("e.ids").alias("record_id"), "bundle", F.col("e.frames").alias("frame"), F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("length"))


ORACLE = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""
