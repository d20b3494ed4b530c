import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quilldex.functions import quantize as Q
from quilldex.functions import scalars as S
from quilldex.functions import vectors as V
from quilldex.operators import search

A, B = [3.0, -4.0, 0.5], [1.0, 2.0, -1.0]


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, A, B), (2, [0.0, 0.0, 0.0], B)], "id long, a array<double>, b array<double>")


def value(pair, column, row=1):
    return pair.filter(F.col("id") == row).select(column.alias("x")).first().x


def test_distances_of_columns_and_of_known_vectors_agree(pair):
    a, b = np.array(A), np.array(B)
    want = {
        "cosine": abs(1 - a @ b / np.sqrt(a @ a * (b @ b))), "euclidean": np.sqrt(((a - b) ** 2).sum()), "squared_l2": ((a - b) ** 2).sum(),
        "manhattan": np.abs(a - b).sum(), "dot": -(a @ b), "one_minus_dot": 1 - a @ b,
    }
    for name, d in want.items():
        f = V.METRICS[name]
        assert value(pair, f(F.col("a"), F.col("b"))) == pytest.approx(d, abs=1e-12)
        assert value(pair, f(F.col("a"), B)) == pytest.approx(d, abs=1e-12)
        assert search.distances(a[None], b[None], name)[0, 0] == pytest.approx(d, abs=1e-12)
    assert V.metric_by_name("none") is V.euclidean


def test_zero_vectors(pair):
    assert value(pair, V.cosine(F.col("a"), F.col("b")), 2) is None and value(pair, V.cosine(F.col("a"), B), 2) is None
    assert value(pair, V.normalize(F.col("a")), 2) == [0.0, 0.0, 0.0]
    assert np.allclose(value(pair, V.normalize(F.col("a"))), np.array(A) / np.linalg.norm(A))


def test_scores():
    assert [round((2 - d) / 2 * 100, 6) for d in (0, 1, 2)] == [100, 50, 0]


def test_codecs_against_numpy(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([[0.0, -0.0, 65504, 65519, 65520, -70000, 2**-24, 2**-25, 1e-8, 0.99999994, 1.0, 2.0, 61439, 61440, np.inf, -np.inf, 3.3e38, 3.4e38, 1e-45], r.standard_normal(3000), r.standard_normal(2000) * 1e-6])
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "id long, x double")
    got = np.array([[*r] for r in rows.select(*[Q.round_to(F.col("x"), k).alias(k) for k in Q.FORMATS]).collect()], float)
    with np.errstate(over="ignore"):
        assert np.array_equal(got[:, 0], x.astype(np.float16).astype(float))
    for k, kind in enumerate(Q.FORMATS):
        assert [Q.round_value(float(v), kind) for v in x] == got[:, k].tolist()
    bits = x.astype(np.float32).view(np.uint32)
    fits = (x == x.astype(np.float32)) & np.isfinite(x) & (np.abs(x) < 3.39e38)
    rounded = ((bits + 0x7FFF + (bits >> 16 & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    assert np.array_equal(got[fits, 1], rounded[fits].astype(float))
    assert math.isnan(rows.select(Q.round_to(F.lit(float("nan")), "f8").alias("x")).first().x)


def test_textual_identifiers(spark):
    for n in (0, 1, 57, 58, 1288834974657, 2**62 + 12345, 2**63 - 1):
        for alphabet in (S.BASE32, S.BASE36, S.BASE58):
            text = spark.range(1).select(S.to_base(F.lit(n).cast("long"), alphabet).alias("t")).first().t
            want, k = "", n
            while k or not want:
                want, k = alphabet[k % len(alphabet)] + want, k // len(alphabet)
            assert text == want
            assert spark.range(1).select(S.from_base(F.lit(text), alphabet).alias("n")).first().n == n
    row = spark.range(1).select(S.make_id(F.lit(1700000000000), F.lit(5).cast("long"), F.lit(77).cast("long")).alias("i")).select(S.id_time_ms(F.col("i")), S.id_node(F.col("i")), S.id_step(F.col("i"))).first()
    assert [*row] == [1700000000000, 5, 77]


def test_shards_are_even(spark):
    counts = [r["count"] for r in spark.range(10_000).groupBy(S.shard_of(F.col("id"))).count().collect()]
    assert len(counts) == 16 and max(counts) < 1.25 * min(counts)


def test_identifiers_and_hashes(spark):
    from quilldex.functions import scalars as S

    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h

    texts = ["", "a", "foobar", "é日🙂", "x" * 300, *(str(k) for k in range(999))]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", S.fnv1a(F.col("t")).alias("h"), S.fnv_shard(F.col("t"), 3).alias("s"))
    got = {r.t: (r.h, r.s) for r in frame.collect()}
    assert got.pop(None) == (None, None)
    assert all((h % (1 << 64), s) == (plain(t), plain(t) % 3) for t, (h, s) in got.items())
    shares = [sum(s == k for t, (_, s) in got.items() if t.isdigit()) for k in range(3)]
    assert min(shares) > 250
    one = spark.range(1).select(S.distinct_ints(50, 20, 3).alias("x")).first().x
    assert len(set(one)) == 20 and set(one) <= set(range(50))


def test_links_are_chosen_as_configured():
    import numpy as np

    from quilldex.operators.ann import SmallWorld

    r = np.random.default_rng(4)
    x = r.standard_normal((300, 8))
    recall = {}
    for algorithm in ("heuristic", "simple"):
        g = SmallWorld("euclidean", m=6, ef_construction=40, search_algorithm=algorithm, m_max0=8, m_max=5)
        for k, v in enumerate(x):
            g.insert(k, v)
        assert max(len(v) for v in g.links[0].values()) <= 8 and all(len(v) <= 6 for level in g.links[1:] for v in level.values())
        assert g.get(7).tolist() == x[7].tolist() and g.get(1000) is None
        exact = [np.argsort(((x - q) ** 2).sum(1))[:5].tolist() for q in x[:50]]
        recall[algorithm] = np.mean([len({i for _, i in g.search(q, 5, 60)} & set(e)) / 5 for q, e in zip(x[:50], exact)])
    assert recall["heuristic"] >= 0.9
    # candidates in one direction: the heuristic keeps one of them and the one on the other side
    g = SmallWorld("euclidean", m=2)
    g.vectors = {k: np.array([v, 0.0]) for k, v in enumerate((1.0, 1.1, 1.2, -2.0))}
    found = [(1.0, 0), (1.1, 1), (1.2, 2), (2.0, 3)]
    assert [i for _, i in g.select(found, 2)] == [0, 3]
    g.heuristic = False
    assert [i for _, i in g.select(found, 2)] == [0, 1]
