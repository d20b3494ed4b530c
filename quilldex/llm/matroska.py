"""Matroska as a media column: bytes as 8-bit audio samples, muxed, parsed and described.

The muxer lays frames into laced blocks (fixed-size or EBML lacing), blocks into
clusters, and adds cues with the clusters' positions. The parser reads any nesting of
EBML elements with variable-length identifiers and sizes, unknown sizes, simple and
grouped blocks and all three lacings, and gives a table of packets with track,
timestamp and byte range, so that a packet can be cut from the file without parsing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work

# Fixed values of EBML and Matroska: identifiers of elements
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
CONTAINERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, BLOCK_GROUP, TRACK_ENTRY, AUDIO, CUE_POINT, CUE_TRACK_POSITIONS}
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}
XIPH, FIXED, EBML_LACING = 1, 2, 3

#: 8 samples a millisecond; frames in a block; blocks in a cluster (its timestamps are 16 bits).
SAMPLE_RATE, FRAME_BYTES, LACED, CLUSTER_BLOCKS = 8000, 1024, 8, 16
UNIT = 64
SLICE_ROWS = 500
PACKETS = "doc_id long, track int, timestamp_ms long, start long, size long, keyframe boolean"
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def put_size(n: int) -> bytes:
    """A size in as few bytes as hold it; all ones are kept for unknown sizes."""
    width = max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes | int | str | float) -> bytes:
    if isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + put_size(len(body)) + body


def get_number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, bytes used, all ones) of a variable-length integer."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    low = raw & ((1 << 7 * width) - 1)
    return (raw if keep_marker else low), width, low == (1 << 7 * width) - 1


def lacing_sizes(sizes: list[int], kind: int) -> bytes:
    """The head of a laced block's body; the last size follows from the block's."""
    if kind == FIXED:
        return bytes([len(sizes) - 1])
    out = bytes([len(sizes) - 1])
    if kind == XIPH:
        return out + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    out += put_size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
        out += (b - a + (1 << (7 * width - 1)) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return out


def block(track: int, offset: int, frames: list[bytes], lacing: int | None = None) -> bytes:
    """A simple block's body. Lacing: none for one frame, fixed for equal ones, EBML else."""
    sizes = [len(f) for f in frames]
    if lacing is None:
        lacing = 0 if len(frames) == 1 else FIXED if len(set(sizes)) == 1 else EBML_LACING
    head = put_size(track) + struct.pack(">hB", offset, 0x80 | lacing << 1)
    return head + (lacing_sizes(sizes, lacing) if lacing else b"") + b"".join(frames)


_HEAD = element(EBML, element(DOC_TYPE, "matroska") + element(DOC_TYPE_VERSION, 4) + element(DOC_TYPE_READ_VERSION, 2))
_INFO = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, "quilldex") + element(WRITING_APP, "quilldex"))
_TRACKS = element(
    TRACKS,
    element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, "A_PCM/INT/LIT") + element(AUDIO, element(RATE, float(SAMPLE_RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))),
)


def mux(payload: bytes) -> bytes:
    """A file with one mono track whose samples are the payload's bytes."""
    frames = [payload[k : k + FRAME_BYTES] for k in range(0, len(payload), FRAME_BYTES)]
    ms = FRAME_BYTES * 1000 // SAMPLE_RATE
    parts, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    per_cluster = LACED * CLUSTER_BLOCKS
    for c in range(0, len(frames), per_cluster):
        body = [element(TIMESTAMP, c * ms)]
        for b in range(c, min(c + per_cluster, len(frames)), LACED):
            body.append(element(SIMPLE_BLOCK, block(1, (b - c) * ms, frames[b : min(b + LACED, c + per_cluster)])))
        cues.append(element(CUE_POINT, element(CUE_TIME, c * ms) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


def parse_block(data: bytes, at: int, stop: int, cluster: int, ms: float, keyframe: bool | None) -> list[tuple]:
    """(track, timestamp, start, size, keyframe) of every frame of a block's body."""
    track, used, _ = get_number(data, at)
    offset, flags = struct.unpack_from(">hB", data, at + used)
    at += used + 3
    lacing, key = flags >> 1 & 3, bool(flags & 0x80) if keyframe is None else keyframe
    sizes = [stop - at]
    if lacing:
        n = data[at] + 1
        at += 1
        if lacing == FIXED:
            if (stop - at) % n:
                raise ValueError("frames of unequal size in a block with fixed lacing")
            sizes = [(stop - at) // n] * n
        else:
            sizes = []
            for k in range(n - 1):
                if lacing == XIPH:
                    size = 0
                    while True:
                        x = data[at]
                        at, size = at + 1, size + x
                        if x < 255:
                            break
                else:
                    size, used, _ = get_number(data, at)
                    at += used
                    if k:
                        size = sizes[-1] + size - ((1 << (7 * used - 1)) - 1)
                sizes.append(size)
            sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a laced block is too short for its frames")
    out = []
    for k, size in enumerate(sizes):
        out.append((track, cluster + offset + round(k * ms), at, size, key))
        at += size
    return out


def parse(data: bytes, frame_ms: float = FRAME_BYTES * 1000 / SAMPLE_RATE) -> tuple[list[tuple], list[tuple[int, int]]]:
    """(packets, cues) of a file: packets as parse_block gives them, cues as (time, cluster's position in the file)."""
    packets: list[tuple] = []
    cues: list[tuple[int, int]] = []
    state = {"cluster": 0, "segment": 0, "time": 0}

    def walk(at: int, stop: int, parent: int) -> int:
        while at < stop:
            kind, used, _ = get_number(data, at, True)
            if parent == CLUSTER and kind in TOP:
                return at  # a cluster of unknown size ends where the next top element starts
            size, more, unknown = get_number(data, at + used)
            body = at + used + more
            end = stop if unknown else body + size
            if end > stop:
                raise ValueError(f"the element at {at} reaches beyond its parent")
            number = int.from_bytes(data[body:end], "big") if size <= 8 and not unknown else 0
            if kind == SEGMENT:
                state["segment"] = body
            if kind == TIMESTAMP:
                state["cluster"] = number
            elif kind == SIMPLE_BLOCK:
                packets.extend(parse_block(data, body, end, state["cluster"], frame_ms, None))
            elif kind == BLOCK:
                packets.extend(parse_block(data, body, end, state["cluster"], frame_ms, False))
            elif kind == CUE_TIME:
                state["time"] = number
            elif kind == CUE_CLUSTER:
                cues.append((state["time"], state["segment"] + number))
            elif kind in CONTAINERS:
                reached = walk(body, end, kind)
                end = reached if unknown else end
            at = end
        return at

    walk(0, len(data), 0)
    for _, at in cues:
        if get_number(data, at, True)[0] != CLUSTER:
            raise ValueError(f"a cue points to {at}, where no cluster starts")
    return packets, cues


def feature_of(payload: bytes, packets: list[tuple], cues: list) -> str:
    """Numbers of the samples read back, and of their packets, as text; a function of the payload alone."""
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    levels = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(levels @ values) / n
    var = float(levels @ (values * values)) / n - mean * mean
    share = levels[levels > 0] / n
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"packets={len(packets)};clusters={len(cues)};ms={n * 1000 // SAMPLE_RATE};mean={mean:.4f};std={max(0.0, var) ** 0.5:.4f};entropy={-float(share @ np.log2(share)) + 0.0:.4f};crossings={crossings}"


def pad(data: bytes) -> bytes:
    return data + bytes(UNIT - len(data) if not data else -len(data) % UNIT)


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], schema=_MEDIA)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            rows = []
            for doc_id, n, media in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                packets, cues = parse(media)
                payload = b"".join([media[start : start + size] for _, _, start, size, _ in packets])
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, packets, cues)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)] if rows else [pa.array([], f.type) for f in _READ], schema=_READ)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("track", pa.int32()), ("timestamp_ms", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_())])
    for batch in batches:
        for doc_id, media in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "media")), strict=True):
            found = parse(media)[0]
            columns = [[doc_id] * len(found), *([p[k] for p in found] for k in range(5))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a Matroska file) for each row of ``docs`` (doc_id, text).

    The samples are the text's UTF-8 and zeros up to a positive multiple of 64; a null or
    empty text is 64 zeros. Equal texts give equal files, rows that repeat a doc_id a file
    each, no rows no files. A very long text is one file, in memory whole in the tasks that
    write and read it. Other columns, whatever their names, don't matter.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mux, "doc_id long, n_bytes long, media binary")


def store(media: DataFrame, work: Work) -> DataFrame:
    """Writes a media column to the shared folder and reads it again. Row groups stay small, as cells are large."""
    path = f"{work.root}/media"
    media.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return work.spark.read.schema(media.schema).parquet(path)


def packet_table(media: DataFrame) -> DataFrame:
    """A row (PACKETS' columns) for each packet of the media column, in file order within a file."""
    return media.select("doc_id", "media").mapInArrow(_packets, PACKETS)


def describe(media: DataFrame) -> DataFrame:
    """What each stored file holds (FEATURES' columns), parsed from its bytes."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_describe, FEATURES)
