import numpy as np
import pytest
from pyspark.sql import functions as F

from quilldex.operators import ann, search


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    data = [(k, [float(x) for x in r.standard_normal(16)], k % 5, k % 2 == 0) for k in range(400)]
    data += [(1000, data[3][1], 3, False), (1001, [0.0] * 16, 1, True)]
    return spark.createDataFrame(data, "id long, embedding array<float>, kind int, even boolean").repartition(4).cache()


@pytest.fixture(scope="module")
def matrix(rows):
    got = sorted(rows.select("id", "embedding").collect())
    return np.array([r.id for r in got]), np.array([r.embedding for r in got], float)


def exact(matrix, q, k, metric="cosine"):
    ids, x = matrix
    d = search.distances(x, np.array(q, float)[None], metric)[0]
    d = np.where(np.isnan(d), np.inf, d)
    return ids[np.lexsort((ids, d))][:k].tolist()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "dot"])
def test_nearest(rows, matrix, metric):
    q = search.vector_of(rows, "id", 3, "embedding")
    assert [r.id for r in search.nearest(rows, q, 10, id_column="id", metric=metric).collect()] == exact(matrix, q, 10, metric)


def test_ties_offset_zero_vectors(rows, matrix):
    q = search.vector_of(rows, "id", 3, "embedding")
    everything = [r.id for r in search.nearest(rows, q, 500, id_column="id").collect()]
    assert everything[:2] == [3, 1000] and everything[-1] == 1001
    assert [r.id for r in search.nearest(rows, q, 5, id_column="id", offset=5).collect()] == everything[5:10]
    far = [r.id for r in search.nearest(rows, q, 5, id_column="id", farthest=True).collect()]
    assert far == [i for i in everything if i != 1001][::-1][:5]


def test_hybrid_filters(rows):
    q = search.vector_of(rows, "id", 3, "embedding")
    pre = search.hybrid(rows, q, 10, {"even": "true", "kind": "3"}, id_column="id").collect()
    assert len(pre) == 10 and all(r.even and r.kind == 3 for r in pre)
    post = search.hybrid(rows, q, 10, {"even": "true"}, id_column="id", mode="post").collect()
    assert all(r.even for r in post) and len(post) <= 10
    assert search.filter_only(rows, {"kind": "2"}, limit=3, id_column="id").collect()[0].score == 100


def test_multi_vector_ratios(rows):
    halves = rows.select("id", F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 9, 8).alias("b"))
    q = halves.filter("id = 3").first()
    part = lambda n, v, r, i=True: {"name": n, "vector": v, "ratio": r, "include": i}
    assert search.multi_vector(halves, [part("a", q.a, 30), part("b", q.b, 70)], 1, id_column="id").first().score == pytest.approx(100)
    for wrong in ([part("a", q.a, 30), part("b", q.b, 60)], [part("a", q.a, 100), part("c", q.b, 1, False)]):
        with pytest.raises(ValueError):
            search.multi_vector(halves, wrong, 1, id_column="id")


def test_many_queries_in_blocks(rows, matrix, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    queries = rows.filter("id < 20").select(F.col("id").alias("qid"), "embedding")
    got = search.nearest_many(rows, queries, 5, id_column="id", metric="euclidean").collect()
    vectors = {r.qid: r.embedding for r in queries.collect()}
    for q, v in vectors.items():
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == exact(matrix, v, 5, "euclidean")


def test_dimension_check():
    with pytest.raises(ValueError):
        search.check_dimension([1.0], 2)


def test_cells_and_hashes_find_most(rows, matrix, spark, tmp_path):
    index = ann.CellIndex(rows, 8)
    q = search.vector_of(rows, "id", 7, "embedding")
    want = set(exact(matrix, q, 10))
    assert len(want & {r.id for r in index.search(q, 10, 5, id_column="id").collect()}) >= 7
    index.write(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    found = index.search(q, 10, 2, id_column="id", rows=stored)
    assert "PartitionFilters: [cell" in found._jdf.queryExecution().executedPlan().toString().replace("isnotnull(cell), ", "")
    assert len(want & {r.id for r in ann.SignHashIndex(rows, 16, tables=12, bits=4).search(q, 10, id_column="id").collect()}) >= 7


def test_product_codes(rows, matrix):
    index = ann.ProductIndex(rows, 16, parts=4, centroids=32)
    hits = 0
    for k in range(4):
        q = search.vector_of(rows, "id", k, "embedding")
        hits += len(set(exact(matrix, q, 10)) & {r.id for r in index.search(q, 10, id_column="id", refine=60).collect()})
    assert hits >= 36
    with pytest.raises(ValueError):
        ann.ProductIndex(rows, 16, parts=3)


def test_graphs(rows, matrix):
    graphs = ann.build_graphs(rows.filter("id <> 1001"), id_column="id", shard_rows=200, m=8, ef_construction=48).cache()
    hits = 0
    for k in range(5):
        q = search.vector_of(rows, "id", k, "embedding")
        hits += len(set(exact(matrix, q, 10)) & {r.id for r in ann.search_graphs(graphs, q, 10, ef=64).collect()})
    assert hits >= 45


def test_graph_insert_remove_snapshot(matrix):
    ids, x = matrix
    g = ann.SmallWorld("euclidean", m=8, ef_construction=48)
    for i, v in zip(ids[:300].tolist(), x[:300]):
        g.insert(i, v)
    for i in range(0, 300, 5):
        assert g.remove(i)
    assert not g.remove(0) and len(g.vectors) == 240
    again = ann.SmallWorld.from_table(g.table(), "euclidean", m=8)
    left = [i for i in range(300) if i % 5]
    hits = 0
    for k in (1, 2, 3, 4):
        found = [i for _, i in g.search(x[k], 10, 64)]
        assert found == [i for _, i in again.search(x[k], 10, 64)] and found[0] == k
        d = search.distances(x[left], x[k][None], "euclidean")[0]
        hits += len({left[j] for j in np.argsort(d)[:10]} & set(found))
    assert hits >= 36
    empty = ann.SmallWorld()
    assert empty.search([1.0], 3) == []
