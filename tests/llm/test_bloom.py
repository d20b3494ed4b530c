import hashlib

from quilldex.llm import bloom

digest = lambda k: hashlib.md5(str(k).encode()).digest()


def test_none_is_lost_and_few_pass(spark, monkeypatch):
    frame = spark.createDataFrame([(k, digest(k)) for k in range(3000)] + [(5, digest(5)), (-1, None)], "k long, d binary").repartition(5)
    other = spark.createDataFrame([(k, digest(k)) for k in range(2000, 12_000)] + [(-1, None)], "k long, d binary")
    for most, wrong in ((bloom.MOST_BITS, 100), (bloom.LEAST_BITS, 9000)):
        monkeypatch.setattr(bloom, "MOST_BITS", most)
        got = {r.k for r in bloom.with_hits(other, "d", bloom.sent(frame.filter("d is not null"), "d", 3000)).filter("hit").collect()}
        assert set(range(2000, 3000)) <= got and len(got) <= 1000 + wrong and -1 not in got
    assert bloom.with_hits(other, "d", bloom.sent(frame.limit(0), "d", 0)).filter("hit").count() == 0
    assert bloom.with_hits(other.limit(0), "d", bloom.sent(frame.filter("d is not null"), "d", 3000)).count() == 0
