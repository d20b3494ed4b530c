"""Recall of the registered approximate searches, over all their queries."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quilldex.operators import ann, search

SF = "/root/testdata/sf0.01"


def mean_recall(spark, name):
    got = [r.recall for r in entry.queries()[f"{name}_recall"](spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    return sum(got) / len(got)


@pytest.mark.parametrize("name", ["ann_sign_hash", "ann_product", "ann_cells", "ann_graph"])
def test_recall(spark, name):
    assert mean_recall(spark, name) >= 0.9


@pytest.mark.parametrize("name", ["ann_cells", "ann_graph"])
def test_every_hundredth_is_searched(spark, name):
    got = entry.queries()[name](spark, SF).collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").collect()]
    assert sorted((r.qid, r["rank"]) for r in got) == sorted((i, k) for i in ids for k in range(1, 11))


def test_cells_many_as_one(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = ann.CellIndex(rows, 16)
    many = index.search_many(rows.filter("vec_id in (0, 100)").selectExpr("vec_id AS qid", "embedding"), 10, 3, id_column="vec_id").collect()
    for q in (0, 100):
        one = index.search(search.vector_of(rows, "vec_id", q, "embedding"), 10, 3, id_column="vec_id").collect()
        assert [r.vec_id for r in one] == [r.id for r in sorted(many, key=lambda r: r["rank"]) if r.qid == q]


def test_sign_hash_many_as_one(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = ann.SignHashIndex(rows, 64, tables=8, bits=6)
    many = index.search_many(rows.filter("vec_id in (0, 100)").selectExpr("vec_id AS qid", "embedding"), 10, id_column="vec_id", probes=3).collect()
    for q in (0, 100):
        one = index.search(search.vector_of(rows, "vec_id", q, "embedding"), 10, id_column="vec_id", probes=3).collect()
        assert [r.vec_id for r in one] == [r.id for r in sorted(many, key=lambda r: r["rank"]) if r.qid == q]


def test_sign_hash_fills_up(spark):
    """A query far from every row still gets k of them."""
    rows = spark.range(40).selectExpr("id", "array(1.0 + id / 1000, 1.0, 1.0, 1.0) AS embedding")
    index = ann.SignHashIndex(rows, 4, tables=2, bits=4)
    assert index.search([-1.0, -1.0, -1.0, -1.0], 10, id_column="id", probes=1).count() == 10


def test_product_refines_more_of_a_larger_table(spark):
    """On random unit vectors a fixed number of refined rows loses neighbours as the table grows."""
    r = np.random.default_rng(2)
    x = r.standard_normal((12_000, 64)).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "embedding": [v.tolist() for v in x]})).selectExpr("id", "cast(embedding AS array<float>) AS embedding").cache()
    refined = []
    for n in (2000, 12_000):
        part = rows.filter(f"id < {n}")
        index = ann.ProductIndex(part, 64, parts=8, centroids=32)
        queries = part.filter("id < 40").selectExpr("id AS qid", "embedding")
        got = search.recall(index.search_many(queries, 10, id_column="id"), search.nearest_many(part, queries, 10, id_column="id"), 10).collect()
        assert sum(g.recall for g in got) / len(got) >= 0.9
        refined.append(index.refined(10, "id"))
    assert refined[1] > 2 * refined[0]
