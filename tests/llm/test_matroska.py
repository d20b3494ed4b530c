import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quilldex.llm import matroska as M
from quilldex.llm.common import Work


def test_round_trip_of_files():
    r = random.Random(1)
    for n in (0, 1, 63, 64, 65, 1024, 1025, 8192, 8193, 200_000):
        data = M.pad(r.randbytes(n))
        media = M.mux(data)
        packets, cues = M.parse(media)
        assert b"".join(media[s : s + z] for _, _, s, z, _ in packets) == data
        assert len(data) % 64 == 0 and len(data) >= max(64, n)
        assert [p[1] for p in packets] == [k * 128 for k in range(len(packets))]
        assert [t for t, _ in cues] == [k * 128 * 128 for k in range(len(cues))]


def test_lacings_and_numbers():
    frames = [bytes([k]) * z for k, z in enumerate([5, 300, 255, 0, 70_000, 1])]
    for lacing, parts in ((M.XIPH, frames), (M.EBML_LACING, frames), (M.FIXED, [b"ab", b"cd", b"ef"]), (0, [b"xyz"])):
        b = M.block(300, -5, parts, lacing)
        got = M.parse_block(b, 0, len(b), 100, 1, None)
        assert [b[s : s + z] for _, _, s, z, _ in got] == parts and got[0][:2] == (300, 95)
    for n in (0, 126, 127, 128, 16382, 16383, 2**28, 2**49):
        assert M.get_number(M.put_size(n), 0) == (n, len(M.put_size(n)), False)


def test_unknown_sizes_and_block_groups():
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.block(1, 7, [b"hello"])))
    cluster = bytes.fromhex("1F43B675") + b"\xff" + M.element(M.TIMESTAMP, 1000) + group
    data = M._HEAD + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + cluster + cluster + M.element(M.CUES, b"")
    packets, _ = M.parse(data)
    assert [(p[1], p[4]) for p in packets] == [(1007, False)] * 2 and data[packets[1][2] :][:5] == b"hello"
    with pytest.raises(ValueError):
        M.parse(M.mux(bytes(64))[:-70] + b"\x00" * 3)


def test_documents(spark, docs, docs_rows, no_docs):
    media = M.store(M.to_media(docs.withColumn("media", F.lit("clash"))), Work(spark, "t"))
    got = M.describe(media).collect()
    want = sorted(str((r[0], len(b := (r[1] or "").encode()), len(p := M.pad(b)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))) for r in docs_rows)
    assert sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == want
    assert len({(r.payload_sha256, r.n_bytes) for r in got}) == len({(r.payload_sha256, r.n_bytes, r.media_sha256, r.feature) for r in got})
    table = M.packet_table(media).filter("doc_id = 905").collect()
    assert sum(p.size for p in table) == 25_024 and table[1].timestamp_ms == 128
    assert M.describe(M.to_media(no_docs)).count() == 0
