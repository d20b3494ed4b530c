import hashlib

from pyspark.sql import functions as F

from quilldex.llm import warc
from quilldex.llm.common import Work

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    best = {}
    for p, _, h in rows:
        if len(b := (h or "").encode()) >= 1000 and p is not None:
            best[b] = max(best.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = best.get(b)
        again = first is not None and p != first
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


ROWS = [
    *[(k, f"http://h/{k}\r\nX: y", "é" * (400 + k % 3 * 100)) for k in range(40)], (50, None, None), (51, "u", ""), (None, "u", "é" * 500), (None, "u", "z" * 2000),
    (60, "u", "z" * 2000), (60, "u", "z" * 2000), (61, "u", "y" * 999), (62, "u", "y" * 999), (63, "u", "y" * 999), (63, "u", "y" * 999), (70, "u", "long\r\n\r\nWARC/1.1\r\n" * 30_000),
]


def read(archive):
    return sorted(str(tuple(r)) for r in warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_round_trip_and_revisits(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumns({"digest": F.lit(1), "payload_bytes": F.lit("x"), "n": F.lit(0)})
    archive = warc.write_archive(pages, Work(spark, "t"))
    assert read(archive) == expected(ROWS)
    payloads = {r.page_id: r.payload for r in warc.read_archive(archive, payloads=True).filter("record_type = 'response'").collect()}
    assert bytes(payloads[70]) == ROWS[-1][2].encode()


def test_many_repeated_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "PICK", 1)
    assert read(warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), Work(spark, "t"))) == expected(ROWS)


def test_empty_table(spark):
    assert warc.read_archive(warc.write_archive(spark.createDataFrame([], SCHEMA), Work(spark, "t"))).count() == 0


def test_one_record_costs_one_frame(spark, monkeypatch):
    archive = warc.write_archive(spark.createDataFrame([(k, "u", f"{k} " * 60_000) for k in range(30)], SCHEMA), Work(spark, "t"))
    spot = warc.index_of(archive).filter(F.col("record_id") == warc.record_uri(17)).first()
    data = bytes(archive.filter(F.col("bundle") == spot.bundle).first().data)
    assert len(warc.seek_table(data)) > 1
    fields, block = warc.read_one(data, spot.frame, spot.offset)
    assert fields["WARC-Record-ID"] == "<urn:x-page:17>" and block.endswith(b"17 " * 10)
    # a plain decoder reads the whole bundle: the seek table is a skippable frame
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(warc.index_of(archive).filter(F.col("bundle") == spot.bundle).collect())
