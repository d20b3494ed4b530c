import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quilldex.operators import dml, kv
from quilldex.sources.catalog import Catalog
from quilldex.streaming import feed
from quilldex.types import CollectionError, CollectionSpec, IndexSpec

SPEC = CollectionSpec("things", 2, (IndexSpec("name", "string", primary_key=True), IndexSpec("size", "integer", enable_null=True), IndexSpec("on", "boolean", enable_null=True)), distance="cosine")
ROWS = "name string, size double, on boolean, vector array<float>"


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "c"))


def names(c):
    return sorted((r.name, r.size) for r in c.rows("things").collect())


def test_life_of_a_collection(spark, catalog):
    catalog.create(SPEC)
    with pytest.raises(CollectionError, match="exists"):
        catalog.create(SPEC)
    with pytest.raises(CollectionError, match="not loaded"):
        catalog.rows("things")
    with pytest.raises(CollectionError, match="not found"):
        catalog.load("nothing")
    assert catalog.info("things") == {"name": "things", "load": False}
    catalog.load("things")
    catalog.upsert("things", spark.createDataFrame([("a", 1.0, True, [3.0, 4.0]), ("b", None, None, [0.0, 0.0])], ROWS))
    catalog.upsert("things", spark.createDataFrame([("a", 2.0, False, [1.0, 0.0]), ("c", 3.0, True, [0.0, 2.0])], ROWS))
    assert names(catalog) == [("a", 2), ("b", None), ("c", 3)]
    assert {tuple(r.vector) for r in catalog.rows("things").collect()} == {(1.0, 0.0), (0.0, 0.0), (0.0, 1.0)}
    catalog.delete_where("things", {"size": 3.0})
    assert names(catalog) == [("a", 2), ("b", None)]
    assert catalog.size("things") == {"rows": 2, "bytes": 32, "metadata_bytes": 2 * len("namesizeon") + 2 + 8 + 1}
    before = names(catalog)
    catalog.release("things")
    catalog.release("things")
    catalog.load("things")
    # the snapshot before stays for those who still read it
    assert names(catalog) == before and len(catalog.versions("things")) == 2
    catalog.drop("things")
    catalog.drop("things")
    assert catalog.list() == []


def test_a_write_that_ends_half_way_changes_nothing(spark, catalog, monkeypatch):
    catalog.create(SPEC)
    catalog.load("things")
    row = lambda n: spark.createDataFrame([(n, 1.0, True, [3.0, 4.0])], ROWS)
    catalog.upsert("things", row("a"))
    reader = Catalog(spark, catalog.store.root).read("things")
    write = catalog.store.write

    def broken(name, text):
        write(f"{name}.new", text)  # the file beside is there, the rename is not
        raise RuntimeError("lost")

    monkeypatch.setattr(catalog.store, "write", broken)
    with pytest.raises(RuntimeError, match="lost"):
        catalog.upsert("things", row("b"))
    again = Catalog(spark, catalog.store.root)
    assert [r.name for r in again.read("things").collect()] == ["a"]
    again.load("things")
    again.upsert("things", row("c"))
    assert sorted(r.name for r in again.read("things").collect()) == ["a", "c"]
    # who began to read before can still do so
    assert [r.name for r in reader.collect()] == ["a"]


def test_keys_stay_unique(spark, catalog):
    catalog.create(SPEC)
    catalog.load("things")
    rows = [("a", 1.0, True, [3.0, 4.0]), ("b", 1.0, True, [3.0, 4.0]), ("a", 2.0, True, [3.0, 4.0])]
    catalog.upsert("things", spark.createDataFrame(rows, ROWS).coalesce(1))
    assert names(catalog) == [("a", 2), ("b", 1)]
    ties = spark.createDataFrame([("a", k, 7) for k in range(9)], "key string, value long, seq long")
    assert len({dml.latest(ties.repartition(n), "key", "seq").first().value for n in (1, 3, 5)}) == 1
    log = ties.select("key", F.col("value").cast("string").alias("value"), "seq", F.lit(0).cast("long").alias("expire"), F.lit(False).alias("deleted"))
    assert len({kv.compact(log.repartition(n)).first().value for n in (1, 3, 5)}) == 1


@pytest.mark.parametrize("kind", ["f16", "bf16", "f8"])
def test_quantized_collections_store_codes(spark, catalog, kind):
    import numpy as np

    from quilldex.functions import quantize as Q

    spec = CollectionSpec("q", 4, (IndexSpec("n", "integer"),), distance="euclidean", quantization=kind)
    catalog.create(spec)
    catalog.load("q")
    r = np.random.default_rng(2)
    x = np.concatenate([r.standard_normal((40, 4)), r.standard_normal((40, 4)) * 1e-5, [[0.0, -0.0, 65504.0, 65519.0], [70000.0, -1e30, 2.0**-24, 2.0**-25], [float("nan"), float("inf"), -float("inf"), 0.99999994]]]).astype(np.float32)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "n long, vector array<float>")
    catalog.insert("q", rows)
    stored = spark.read.parquet(f"{catalog.store.root}/q/v={catalog.current('q')}")
    assert {len(v.vector) for v in stored.collect()} == {4 * Q.WIDTHS[kind]}
    got = np.array([v.vector for v in catalog.read("q").orderBy("n").collect()])
    want = np.array([[Q.round_value(float(y), kind) for y in v] for v in x])
    assert np.array_equal(got, want.astype(np.float32), equal_nan=True)


def test_stored_graph_index(spark, catalog):
    spec = CollectionSpec("g", 3, (IndexSpec("n", "integer"),), distance="euclidean", graph={"m": 4, "ef_construction": 40, "ef": 30, "search_algorithm": "simple", "m_max0": 9})
    catalog.create(spec)
    catalog.load("g")
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 11), float(k % 13)]) for k in range(200)], "n long, vector array<float>")
    catalog.insert("g", rows)
    with pytest.raises(CollectionError, match="no index"):
        catalog.index("g")
    catalog.build_index("g", "n", shard_rows=100)
    assert catalog.index("g").agg(F.max(F.size("neighbours"))).first()[0] <= 9
    found = catalog.search_index("g", rows.filter("n % 50 = 0").select(F.col("n").alias("qid"), "vector"), 1).collect()
    assert [(r.qid, r.distance) for r in sorted(found)] == [(k, 0.0) for k in (0, 50, 100, 150)]
    catalog.insert("g", rows.limit(1))
    with pytest.raises(CollectionError, match="no index"):
        catalog.search_index("g", rows.select(F.col("n").alias("qid"), "vector"), 1)


def test_versions_stay_with_versioning(spark, catalog):
    spec = CollectionSpec("things", 2, SPEC.columns, versioning=True)
    catalog.create(spec)
    catalog.load("things")
    catalog.upsert("things", spark.createDataFrame([("a", 1.0, True, [3.0, 4.0])], ROWS))
    assert catalog.versions("things") == [1, 2] and catalog.read("things", 1).count() == 0 and catalog.spec("things") == spec


@pytest.mark.parametrize("row", [("a", 1.5, True, [1.0, 0.0]), ("a", 1.0, True, [1.0]), (None, 1.0, True, [1.0, 0.0]), ("a", 1.0, True, None)])
def test_bad_rows_fail_the_write(spark, catalog, row):
    catalog.create(SPEC)
    catalog.load("things")
    with pytest.raises(Exception):
        catalog.upsert("things", spark.createDataFrame([row], ROWS))
    assert catalog.read("things").count() == 0


def test_specs_are_checked():
    for wrong in (lambda: IndexSpec("x", "date"), lambda: IndexSpec("x", "integer", primary_key=True), lambda: CollectionSpec("x", 2, distance="dot"), lambda: CollectionSpec("x", 2, (IndexSpec("a", "string", True), IndexSpec("b", "string", True)))):
        with pytest.raises(CollectionError):
            wrong()


def test_changes_of_a_stream(spark, catalog, tmp_path):
    catalog.create(SPEC)
    catalog.load("things")
    schema = T.StructType([*SPEC.schema().fields, T.StructField("seq", T.LongType()), T.StructField(feed.OP, T.StringType())])
    row = lambda n, s, seq, op: (n, s, True, [1.0, 0.0], seq, op)
    for k, rows in enumerate(([row("a", 1, 1, "upsert"), row("b", 1, 2, "upsert"), row("a", 5, 3, "upsert")], [row("b", 1, 4, "delete"), row("c", 7, 5, "upsert")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    (tmp_path / "feed").mkdir()
    for k in (0, 1):
        for p in (tmp_path / "in" / str(k)).glob("part-*.parquet"):
            p.rename(tmp_path / "feed" / f"{k}.parquet")
        query = feed.apply_changes(catalog, "things", feed.watch(spark, str(tmp_path / "feed"), schema), str(tmp_path / "cp"), "seq")
        query.awaitTermination()
    assert names(catalog) == [("a", 5), ("c", 7)] and len(catalog.versions("things")) == 2
    # late changes, and some that come again, change nothing; b stays deleted
    before = catalog.current("things")
    catalog.apply("things", spark.createDataFrame([row("a", 1, 1, "upsert"), row("b", 1, 2, "upsert"), row("c", 7, 5, "upsert")], schema), feed.OP, "seq")
    assert catalog.current("things") == before
    catalog.upsert("things", spark.createDataFrame([("d", 9.0, True, [1.0, 0.0])], ROWS))
    catalog.apply("things", spark.createDataFrame([row("b", 3, 3, "upsert"), row("c", 8, 6, "upsert"), row("d", 1, 1, "delete")], schema), feed.OP, "seq")
    assert names(catalog) == [("a", 5), ("c", 8)]


def test_key_value_log(spark):
    log = spark.createDataFrame([("a", "1", 1, 0, False), ("a", "2", 2, 0, False), ("b", "x", 3, 100, False), ("c", "y", 4, 0, False), ("c", None, 5, 0, True), ("d", "z", 6, None, None)], "key string, value string, seq long, expire long, deleted boolean")
    live = kv.compact(log, now=50)
    keys = lambda d: [r.key for r in d.collect()]
    assert keys(kv.ascend(live)) == ["a", "b", "d"] and keys(kv.descend(live)) == ["d", "b", "a"]
    assert keys(kv.ascend(kv.compact(log, now=100))) == ["a", "d"]
    assert kv.get(live, "a").first().value == "2" and not kv.exists(live, "c")
    assert keys(kv.ascend_range(live, "a", "b")) == ["a", "b"] and keys(kv.descend_range(live, "d", "b")) == ["d", "b"]
    assert keys(kv.ascend_from(live, "b")) == ["b", "d"] and keys(kv.descend_to(live, "b")) == ["b", "a"]
    assert keys(kv.ascend_matching(live, "[ad]")) == ["a", "d"] and keys(kv.descend_matching(live, "[ad]")) == ["d", "a"]
    more = kv.batch(log, spark.createDataFrame([("a", None, 9, 0, True)], log.schema))
    assert keys(kv.ascend(kv.compact(more))) == ["b", "d"]


def test_batches_of_a_log(spark):
    log = spark.createDataFrame([("a", "1", 1, 0, False), ("b", "2", 2, 0, False)], "key string, value string, seq long, expire long, deleted boolean")
    b = kv.Batch(log)
    b.put("c", "3")
    b.delete("a")
    b.put("b", "4")
    assert (b.get("c"), b.get("a"), b.get("b"), b.get("z")) == ("3", None, "4", None)
    assert b.exists("b") and not b.exists("a") and not b.exists("z")
    assert {r.key: r.value for r in kv.compact(b.commit()).collect()} == {"b": "4", "c": "3"}
    b.put("x", "1")
    b.rollback()
    assert b.commit().count() == 2


def test_deletes_ignore_missing_values(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id long, size long")
    assert sorted(r.id for r in dml.delete_where(rows, {"size": 5}).collect()) == [1, 3]
    assert dml.delete_keys(rows, rows.select((F.col("id") + 100).alias("id")), "id").count() == 3
