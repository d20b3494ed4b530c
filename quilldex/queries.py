"""The engine's operators as queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilldex.functions import quantize as Q
from quilldex.functions import scalars as S
from quilldex.functions import vectors as V
from quilldex.operators import ann, dml, kv, postings, search
from quilldex.plans.filters import compile_filter, text_filter
from quilldex.session import shared_dir, ship
from quilldex.sources.catalog import Catalog
from quilldex.streaming import feed
from quilldex.types import CollectionSpec, IndexSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None, name: str | None = None):
    def take(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return take


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with metadata, as a collection has them."""
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", "label", F.col("label").cast("long").alias("type"), (F.col("vec_id") % 10).alias("size"),
        ((F.col("vec_id") % 100) / 100).alias("volume"), (F.col("vec_id") % 2 == 0).alias("expand"),
    )


COLLECTION = """SELECT vec_id, embedding::DOUBLE[] AS v, label, label::BIGINT AS type, vec_id % 10 AS size, (vec_id % 100) / 100 AS volume, vec_id % 2 = 0 AS expand FROM embeddings"""
QVEC = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
DISTANCE = {
    "cosine": "abs(1 - list_cosine_similarity(v, {q}))",
    "euclidean": "list_distance(v, {q})",
    "squared_l2": "power(list_distance(v, {q}), 2)",
    "manhattan": "list_sum(list_transform(list_zip(v, {q}), lambda p: abs(p[1] - p[2])))",
    "dot": "-list_inner_product(v, {q})",
    "one_minus_dot": "1 - list_inner_product(v, {q})",
}
SCORE = {True: "(2 - d) / 2 * 100", False: "greatest(0, 100 - d)"}


def knn_sql(metric: str, k: int, where: str = "true", offset: int = 0, order: str = "ASC", having: str = "true") -> str:
    d = DISTANCE[metric].format(q=QVEC)
    return f"""WITH c AS ({COLLECTION}), s AS (SELECT *, {d} AS d FROM c WHERE {where}), r AS (SELECT *, {SCORE[metric == "cosine"]} AS sc FROM s)
SELECT vec_id, label, round(d, {PLACES}) + 0 AS distance, round(sc, {PLACES}) + 0 AS score FROM r WHERE {having} ORDER BY d {order} NULLS LAST, vec_id LIMIT {k} OFFSET {offset}"""


def shown(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "label", (F.round("distance", PLACES) + 0.0).alias("distance"), (F.round("score", PLACES) + 0.0).alias("score"))  # no negative zero


def knn(metric: str = "cosine", k: int = 10, **how) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = collection(spark, sf_dir)
        q = search.vector_of(rows, "vec_id", 0, "embedding")
        return shown(search.nearest(rows, q, k, id_column="vec_id", metric=metric, **how))

    return run


for _metric in DISTANCE:
    query(knn_sql(_metric, 10), "knn_l2" if _metric == "euclidean" else f"knn_{_metric}")(knn(_metric))
query(knn_sql("cosine", 10, order="DESC"), "knn_farthest")(knn(farthest=True))
query(knn_sql("cosine", 5, offset=5), "knn_limit_offset")(knn(k=5, offset=5))
query(knn_sql("cosine", 500, having="sc >= 60"), "min_score_threshold")(knn(k=500, least_score=60.0))

_one = lambda c, op, v: {"column": c, "op": op, "value": v}
FILTERS: dict[str, tuple[dict, str]] = {
    "eq": (_one("type", "EQ", 5), "type = 5"),
    "neq": (_one("type", "NEQ", 5), "type <> 5"),
    "gt": (_one("size", "GT", 6), "size > 6"),
    "gte": (_one("type", "GTE", 5), "type >= 5"),
    "lt": (_one("volume", "LT", 0.5), "volume < 0.5"),
    "lte": (_one("size", "LTE", 3), "size <= 3"),
    "bool": (_one("expand", "EQ", True), "expand"),
    "range": ({"and": [_one("size", "GTE", 2), _one("size", "LT", 7)]}, "size >= 2 AND size < 7"),
    "and": ({"and": [_one("type", "GT", 5), _one("size", "LT", 4)]}, "type > 5 AND size < 4"),
    "or": ({"or": [_one("type", "EQ", 1), _one("volume", "LT", 0.2)]}, "type = 1 OR volume < 0.2"),
    "nested": ({"or": [{"and": [_one("type", "GT", 5), _one("size", "GT", 1)]}, _one("volume", "LT", 0.5)]}, "(type > 5 AND size > 1) OR volume < 0.5"),
}
for _name, (_expr, _where) in FILTERS.items():
    query(knn_sql("cosine", 10, _where), f"knn_filtered_{_name}")(knn(where=_expr))
query(knn_sql("euclidean", 10, "type >= 5"), "knn_l2_filtered")(knn("euclidean", where=_one("type", "GTE", 5)))


def hybrid(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = collection(spark, sf_dir)
        q = search.vector_of(rows, "vec_id", 0, "embedding")
        return shown(search.hybrid(rows, q, 10, {"expand": "true", "type": "3"} if mode == "pre" else {"expand": "true"}, id_column="vec_id", mode=mode))

    return run


query(knn_sql("cosine", 10, "expand AND type = 3"), "hybrid_pre")(hybrid("pre"))
query(
    f"WITH near AS ({knn_sql('cosine', 30)}) SELECT * FROM near WHERE vec_id % 2 = 0 ORDER BY distance, vec_id LIMIT 10", "hybrid_post_oversample3"
)(hybrid("post"))


def filtered(table: str, expression: dict, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, table)
        return rows.filter(compile_filter(expression, rows.schema)).select(*columns)

    return run


_L = ["l_orderkey", "l_linenumber", "l_quantity"]
TABLE_FILTERS = {
    "filter_eq": ("orders", _one("o_orderstatus", "EQ", "F"), ["o_orderkey"], "o_orderstatus = 'F'"),
    "filter_neq": ("part", _one("p_size", "NEQ", 10), ["p_partkey", "p_size"], "p_size <> 10"),
    "filter_gt": ("lineitem", _one("l_quantity", "GT", 45), _L, "l_quantity > 45"),
    "filter_gte": ("lineitem", _one("l_quantity", "GTE", "49"), _L, "l_quantity >= 49"),
    "filter_lt": ("lineitem", _one("l_discount", "LT", 0.01), _L, "l_discount < 0.01"),
    "filter_lte": ("orders", _one("o_totalprice", "LTE", 20000.0), ["o_orderkey"], "o_totalprice <= 20000"),
    "filter_and": ("lineitem", {"and": [_one("l_returnflag", "EQ", "R"), _one("l_quantity", "GT", 40.0)]}, _L, "l_returnflag = 'R' AND l_quantity > 40"),
    "filter_or": ("part", {"or": [_one("p_size", "EQ", 1), _one("p_retailprice", "GT", 1900.0)]}, ["p_partkey"], "p_size = 1 OR p_retailprice > 1900"),
    "filter_nested": (
        "lineitem", {"or": [{"and": [_one("l_quantity", "GT", 45.0), _one("l_discount", "LT", 0.02)]}, _one("l_tax", "EQ", 0.08)]}, _L,
        "(l_quantity > 45 AND l_discount < 0.02) OR l_tax = 0.08",
    ),
    "filter_string_order": ("part", _one("p_name", "GTE", "m"), ["p_partkey", "p_name"], "p_name >= 'm'"),
    "filter_eq_other_type": ("part", _one("p_size", "EQ", "10"), ["p_partkey"], "false"),
    "filter_empty_or": ("part", {"or": []}, ["p_partkey"], "false"),
}
for _name, (_table, _expr, _columns, _where) in TABLE_FILTERS.items():
    query(f"SELECT {', '.join(_columns)} FROM {_table} WHERE {_where}", _name)(filtered(_table, _expr, _columns))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id % 10 END AS size FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 10 <> 3")
def filter_null_semantics(spark, sf_dir):
    rows = collection(spark, sf_dir).withColumn("size", F.when(F.col("vec_id") % 7 != 0, F.col("size")))
    return rows.filter(compile_filter(_one("size", "NEQ", 3), rows.schema)).select("vec_id", "size")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0")
def filter_bool(spark, sf_dir):
    rows = collection(spark, sf_dir)
    return rows.filter(compile_filter(_one("expand", "GT", False), rows.schema)).select("vec_id")


@query("SELECT p_partkey, 100.0::DOUBLE AS score FROM part WHERE p_size = 12")
def filter_only_score100(spark, sf_dir):
    return search.filter_only(read(spark, sf_dir, "part"), {"p_size": "12"}).select("p_partkey", "score")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 12 AND l_returnflag = 'R'")
def core_string_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.filter(text_filter({"l_quantity": "12", "l_returnflag": "R"}, rows.schema)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, 100.0::DOUBLE AS score FROM part WHERE false")
def filter_only_empty(spark, sf_dir):
    return search.filter_only(read(spark, sf_dir, "part"), {}).select("p_partkey", "score")


@query(
    f"""WITH c AS (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS a, (embedding::DOUBLE[])[33:64] AS b FROM embeddings),
q AS (SELECT a, b FROM c WHERE vec_id = 0)
SELECT c.vec_id, round((2 - abs(1 - list_cosine_similarity(c.a, q.a))) / 2 * 100 * 0.3 + (2 - abs(1 - list_cosine_similarity(c.b, q.b))) / 2 * 100 * 0.7, {PLACES}) AS score
FROM c, q ORDER BY (2 - abs(1 - list_cosine_similarity(c.a, q.a))) / 2 * 30 + (2 - abs(1 - list_cosine_similarity(c.b, q.b))) / 2 * 70 DESC, c.vec_id LIMIT 10"""
)
def multivector_weighted(spark, sf_dir):
    rows = collection(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 32).alias("head"), F.slice("embedding", 33, 32).alias("tail"))
    q = rows.filter("vec_id = 0").select("head", "tail").first()
    parts = [{"name": "head", "vector": q[0], "ratio": 30}, {"name": "tail", "vector": q[1], "ratio": 70}]
    return search.multi_vector(rows, parts, 10, id_column="vec_id").select("vec_id", F.round("score", PLACES).alias("score"))


@query(
    f"""WITH c AS (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS a FROM embeddings), q AS (SELECT a FROM c WHERE vec_id = 1)
SELECT c.vec_id, round((2 - abs(1 - list_cosine_similarity(c.a, q.a))) / 2 * 100, {PLACES}) AS score FROM c, q
ORDER BY list_cosine_similarity(c.a, q.a) DESC, c.vec_id LIMIT 10"""
)
def multivector_excluded(spark, sf_dir):
    rows = collection(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 32).alias("head"), F.slice("embedding", 33, 32).alias("tail"))
    q = rows.filter("vec_id = 1").select("head", "tail").first()
    parts = [{"name": "head", "vector": q[0], "ratio": 100}, {"name": "tail", "vector": q[1], "ratio": 70, "include": False}]
    return search.multi_vector(rows, parts, 10, id_column="vec_id").select("vec_id", F.round("score", PLACES).alias("score"))


@query(
    f"""WITH c AS (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS a, (embedding::DOUBLE[])[33:64] AS b FROM embeddings), q AS (SELECT a AS qa, b AS qb FROM c WHERE vec_id = 0),
s AS (SELECT vec_id, 0.3 * (2 - abs(1 - list_cosine_similarity(a, qa))) / 2 * 100 + 0.7 * (2 - abs(1 - list_cosine_similarity(b, qb))) / 2 * 100 AS s FROM c, q WHERE vec_id % 10 > 5)
SELECT vec_id, round(s, {PLACES}) AS score FROM s ORDER BY s DESC, vec_id LIMIT 10"""
)
def multivector_hybrid(spark, sf_dir):
    rows = collection(spark, sf_dir).select("vec_id", "size", F.slice("embedding", 1, 32).alias("head"), F.slice("embedding", 33, 32).alias("tail"))
    q = rows.filter("vec_id = 0").select("head", "tail").first()
    parts = [{"name": "head", "vector": q[0], "ratio": 30}, {"name": "tail", "vector": q[1], "ratio": 70}]
    found = search.multi_vector(rows, parts, 10, id_column="vec_id", where={"column": "size", "op": "GT", "value": 5}, dims={"head": 32, "tail": 32})
    return found.select("vec_id", F.round("score", PLACES).alias("score"))


@query(
    f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS qid, c.vec_id AS id, abs(1 - list_cosine_similarity(c.v, q.v)) AS d FROM c, c AS q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM d)
SELECT qid, id, round(d, {PLACES}) AS distance, rank::INT AS rank FROM r WHERE rank <= 10 AND id <> qid"""
)
def batch_knn_per_query(spark, sf_dir):
    ship(spark)
    rows = read(spark, sf_dir, "embeddings")
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found = search.nearest_many(rows, queries, 10, id_column="vec_id").filter("id <> qid")
    return found.select("qid", "id", F.round("distance", PLACES).alias("distance"), "rank")


@query(
    f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS qid, c.vec_id AS id, list_distance(c.v, q.v) AS d FROM c, c AS q WHERE c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM d)
SELECT qid, id, round(d, {PLACES}) AS distance, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def knn_self_join_graph(spark, sf_dir):
    ship(spark)
    rows = read(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("qid"), "embedding")
    found = search.nearest_many(rows, queries, 5, id_column="vec_id", metric="euclidean", include_self=False)
    return found.select("qid", "id", F.round("distance", PLACES).alias("distance"), "rank")


@query(
    f"""WITH c AS ({COLLECTION}), s AS (SELECT vec_id, abs(1 - list_cosine_similarity(v, {QVEC})) AS d FROM c)
SELECT vec_id, round((2 - d) / 2 * 100, {PLACES}) AS score FROM s ORDER BY d, vec_id LIMIT 10"""
)
def merge_shard_results(spark, sf_dir):
    rows = collection(spark, sf_dir)
    q = search.vector_of(rows, "vec_id", 0, "embedding")
    shards = [search.nearest(rows.filter(F.col("vec_id") % 3 >= k), q, 10, id_column="vec_id").select("vec_id", "score") for k in range(3)]
    return search.merge_results(shards, 10, id_column="vec_id").select("vec_id", F.round("score", PLACES).alias("score"))


def halves(spark, sf_dir) -> DataFrame:
    v = V.as_vector("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 32).alias("a"), F.slice(v, 33, 32).alias("b"))


HALVES = "SELECT vec_id, (embedding::DOUBLE[])[1:32] AS a, (embedding::DOUBLE[])[33:64] AS b FROM embeddings"


def summary(c):
    """First and last element and sum of a vector: as sensitive as the whole, and small."""
    return [F.round(F.get(c, F.lit(0)), PLACES).alias("first"), F.round(F.get(c, F.size(c) - 1), PLACES).alias("last"), F.round(V.total(c), PLACES).alias("total")]


def arithmetic(expr) -> Query:
    return lambda spark, sf_dir: halves(spark, sf_dir).select("vec_id", expr().alias("r")).select("vec_id", *summary(F.col("r")))


def arithmetic_sql(expr: str) -> str:
    return f"WITH c AS ({HALVES}), r AS (SELECT vec_id, {expr} AS r FROM c) SELECT vec_id, round(r[1], {PLACES}) AS first, round(r[-1], {PLACES}) AS last, round(list_sum(r), {PLACES}) AS total FROM r"


_zip = "list_transform(list_zip(a, b), lambda p: p[1] {} p[2])"
for _name, _f, _op in (("add", V.add, "+"), ("subtract", V.subtract, "-"), ("multiply", V.multiply, "*")):
    query(arithmetic_sql(_zip.format(_op)), f"vec_{_name}")(arithmetic(lambda f=_f: f(F.col("a"), F.col("b"))))
query(arithmetic_sql("list_transform(list_zip(a, b), lambda p: p[1] / (2 + abs(p[2])))"), "vec_divide")(arithmetic(lambda: V.divide(F.col("a"), F.transform("b", lambda x: 2 + F.abs(x)))))
for _name, _f, _op in (("add", V.add_scalar, "+"), ("subtract", V.subtract_scalar, "-"), ("multiply", V.multiply_scalar, "*"), ("divide", V.divide_scalar, "/")):
    query(arithmetic_sql(f"list_transform(a, lambda x: x {_op} 3)"), f"vec_{_name}_scalar")(arithmetic(lambda f=_f: f(F.col("a"), 3.0)))
query(arithmetic_sql("list_transform(a, lambda x: x / sqrt(list_inner_product(a, a)))"), "normalize")(arithmetic(lambda: V.normalize(F.col("a"))))
query(arithmetic_sql("list_sort(a)"), "vec_sort")(arithmetic(lambda: V.sorted_vector(F.col("a"))))


@query(f"WITH c AS ({HALVES}) SELECT vec_id, round(list_inner_product(a, b), {PLACES}) AS dot, round(sqrt(list_inner_product(a, a)), {PLACES}) AS length, 0.0::DOUBLE AS zeros, 32.0::DOUBLE AS ones FROM c")
def vec_dot_length(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return halves(spark, sf_dir).select("vec_id", F.round(V.dot(a, b), PLACES).alias("dot"), F.round(V.length(a), PLACES).alias("length"), V.total(V.zeros(32)).alias("zeros"), V.total(V.ones(32)).alias("ones"))


@query(
    f"""WITH c AS ({HALVES}) SELECT vec_id, round((2 - abs(1 - list_cosine_similarity(a, b))) / 2 * 100, {PLACES}) AS score_cosine,
round(greatest(0, 100 - list_distance(a, b)), {PLACES}) AS score_l2 FROM c"""
)
def compare_dist(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return halves(spark, sf_dir).select("vec_id", *[F.round(V.compare(a, b, m), PLACES).alias(n) for m, n in (("cosine", "score_cosine"), ("euclidean", "score_l2"))])


@query(
    """WITH p AS (SELECT c_custkey, (c_custkey % 170)::DOUBLE - 85 AS lat1, (c_custkey % 359)::DOUBLE - 179 AS lon1, (c_nationkey * 3)::DOUBLE - 40 AS lat2, (c_nationkey * 7)::DOUBLE AS lon2 FROM customer),
h AS (SELECT c_custkey, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2) AS h FROM p)
SELECT c_custkey, round(2 * 6371000 * asin(least(sqrt(h), 1)), 3) AS metres FROM h"""
)
def haversine(spark, sf_dir):
    c = lambda x: F.col(x).cast("double")
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 170).alias("a"), (F.col("c_custkey") % 359).alias("b"), F.col("c_nationkey").alias("n"))
    return rows.select("c_custkey", F.round(V.haversine(c("a") - 85, c("b") - 179, c("n") * 3 - 40, c("n") * 7), 3).alias("metres"))


@query(
    """SELECT o_orderkey, (bit_count(xor(o_orderkey, o_custkey)) + bit_count(xor(o_custkey, 7::BIGINT)))::BIGINT AS hamming,
round(CASE WHEN bit_count(o_orderkey | o_custkey) + bit_count(o_custkey | 7) = 0 THEN 0
  ELSE 1 - (bit_count(o_orderkey & o_custkey) + bit_count(o_custkey & 7))::DOUBLE / (bit_count(o_orderkey | o_custkey) + bit_count(o_custkey | 7)) END, 6) AS jaccard FROM orders"""
)
def hamming_jaccard(spark, sf_dir):
    a, b = F.array("o_orderkey", "o_custkey"), F.array(F.col("o_custkey"), F.lit(7).cast("long"))
    return read(spark, sf_dir, "orders").select("o_orderkey", V.hamming(a, b).alias("hamming"), F.round(V.jaccard(a, b), PLACES).alias("jaccard"))


def rounding_sql(x: str, kind: str) -> str:
    bits, low, high = Q.FORMATS[kind]
    guess = f"floor(log2(abs({x})))"
    e = f"greatest({guess} - CASE WHEN pow(2, {guess}) > abs({x}) THEN 1 ELSE 0 END, {low})"
    return f"CASE WHEN {x} = 0 THEN 0.0 WHEN abs({x}) >= {high} THEN sign({x}) * 'inf'::DOUBLE ELSE round_even({x} / pow(2, {e} - {bits}), 0) * pow(2, {e} - {bits}) END"


def quantized(kind: str) -> Query:
    return knn(codec=kind)


for _kind in Q.FORMATS:
    _stored = f"list_transform(embedding::DOUBLE[], lambda x: {rounding_sql('x', _kind)})"
    query(
        f"""WITH c AS (SELECT vec_id, label, {_stored} AS v FROM embeddings), q AS (SELECT v AS q FROM c WHERE vec_id = 0),
s AS (SELECT vec_id, label, abs(1 - list_cosine_similarity(v, q)) AS d FROM c, q)
SELECT vec_id, label, round(d, {PLACES}) AS distance, round((2 - d) / 2 * 100, {PLACES}) AS score FROM s ORDER BY d, vec_id LIMIT 10""",
        f"quant_{_kind}_search",
    )(quantized(_kind))
    query(
        f"""WITH c AS (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings), r AS (SELECT x, {rounding_sql('x', _kind)} AS y FROM c)
SELECT count(*) AS n, round(max(abs(x - y)), 12) AS max_error, count(DISTINCT y) AS n_values FROM r""",
        f"quant_{_kind}_error",
    )(
        lambda spark, sf_dir, k=_kind: read(spark, sf_dir, "embeddings").select(F.explode(V.as_vector("embedding")).alias("x")).withColumn("y", Q.round_to(F.col("x"), k))
        .agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("x") - F.col("y"))), 12).alias("max_error"), F.count_distinct("y").alias("n_values"))
    )


@query(
    """SELECT 'p_brand' AS "column", p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY p_brand
UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*)::BIGINT FROM part GROUP BY p_size"""
)
def posting_list_build(spark, sf_dir):
    return postings.counts(postings.build(read(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_size"))


@query("SELECT count(*)::BIGINT AS n FROM part WHERE p_size IN (1, 2, 3)")
def posting_or(spark, sf_dir):
    lists = postings.build(read(spark, sf_dir, "part"), "p_partkey", "p_size").filter(F.col("value").isin("1", "2", "3"))
    return postings.union(lists).agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size > 40 AND p_brand = 'Brand#11' OR p_size = 1")
def posting_and_or(spark, sf_dir):
    ship(spark)
    lists = postings.build(read(spark, sf_dir, "part"), "p_partkey", "p_size", "p_brand")
    having = lambda where: postings.union(lists.filter(where))
    large = having("column = 'p_size' AND CASE WHEN column = 'p_size' THEN cast(value AS int) END > 40")
    both = postings.intersect(large, having("column = 'p_brand' AND value = 'Brand#11'"))
    return postings.ids_of(postings.union(both.unionByName(having("column = 'p_size' AND value = '1'"))), "p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 40 AND p_brand <> 'Brand#11'")
def posting_snapshot_rows(spark, sf_dir):
    """Postings written, read back, intersected, and the rows that they stand for."""
    ship(spark)
    part, path = read(spark, sf_dir, "part"), f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    postings.save(postings.build(part, "p_partkey", "p_size", "p_brand"), path)
    lists = postings.load(spark, path)
    large = postings.union(lists.filter("column = 'p_size'").filter(F.col("value").cast("int") > 40))
    return postings.rows_of(part, postings.intersect(large, postings.union(lists.filter("column = 'p_brand' AND value <> 'Brand#11'"))), "p_partkey").select("p_partkey", "p_name")


def changes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type", "value")


@query(
    """WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id AS "key", event_id AS seq, event_type, value FROM last WHERE k = 1"""
)
def upsert_last_write_wins(spark, sf_dir):
    return dml.latest(changes(spark, sf_dir), "key", "seq")


@query(
    """WITH ch AS (SELECT c_custkey + 10 AS c_custkey, 'changed' AS c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ch) UNION ALL SELECT c_custkey, c_mktsegment FROM ch"""
)
def update_or_insert(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return dml.upsert(rows, rows.filter("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 10).alias("c_custkey"), F.lit("changed").alias("c_mktsegment")), "c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT (p_size = 7 AND p_brand = 'Brand#12')")
def delete_where(spark, sf_dir):
    return dml.delete_where(read(spark, sf_dir, "part"), {"p_size": 7.0, "p_brand": "Brand#12"}).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def delete_by_keys(spark, sf_dir):
    """Known keys and unknown ones, which change nothing."""
    rows = read(spark, sf_dir, "customer").select("c_custkey")
    known = rows.filter("c_custkey % 3 = 0")
    return dml.delete_keys(rows, known.union(rows.select(-F.col("c_custkey") - 1)), "c_custkey")


def log(spark, sf_dir) -> DataFrame:
    """Events as a log: a user's key, the event as value; clicks expire, the last of some users deletes."""
    return read(spark, sf_dir, "events").select(
        F.format_string("user:%06d", "user_id").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 1000).otherwise(0).cast("long").alias("expire"), (F.col("event_id") % 11 == 0).alias("deleted"),
    )


LOG = """SELECT format('user:{:06d}', user_id) AS "key", props AS value, event_id AS seq, (CASE WHEN event_id % 5 = 0 THEN event_id % 1000 ELSE 0 END)::BIGINT AS expire, event_id % 11 = 0 AS deleted FROM events"""
LIVE = f"""WITH l AS ({LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY seq DESC) AS k FROM l), live AS (SELECT "key", value, seq, expire FROM r WHERE k = 1 AND NOT deleted)"""

query(f"{LIVE} SELECT * FROM live", "kv_compact_latest")(lambda spark, sf_dir: kv.compact(log(spark, sf_dir)))
query(f"{LIVE} SELECT * FROM live WHERE expire = 0 OR expire > 500", "kv_ttl")(lambda spark, sf_dir: kv.compact(log(spark, sf_dir), now=500))
query(f"""{LIVE} SELECT * FROM live WHERE "key" = 'user:000007'""", "kv_get")(lambda spark, sf_dir: kv.get(kv.compact(log(spark, sf_dir)), "user:000007"))
query(f"""{LIVE} SELECT * FROM live WHERE "key" BETWEEN 'user:000010' AND 'user:000050'""", "kv_range_scan")(lambda spark, sf_dir: kv.ascend_range(kv.compact(log(spark, sf_dir)), "user:000010", "user:000050"))
query(f"""{LIVE} SELECT * FROM live WHERE "key" >= 'user:000050'""", "kv_ascend_from")(lambda spark, sf_dir: kv.ascend_from(kv.compact(log(spark, sf_dir)), "user:000050"))
query(f"""{LIVE} SELECT * FROM live WHERE "key" <= 'user:000050'""", "kv_descend")(lambda spark, sf_dir: kv.descend_to(kv.compact(log(spark, sf_dir)), "user:000050"))
query(f"""{LIVE} SELECT * FROM live WHERE "key" BETWEEN 'user:000020' AND 'user:000080'""", "kv_descend_range")(lambda spark, sf_dir: kv.descend_range(kv.compact(log(spark, sf_dir)), "user:000080", "user:000020"))
query(f"""{LIVE} SELECT * FROM live WHERE regexp_matches("key", '[37]$')""", "kv_descend_matching")(lambda spark, sf_dir: kv.descend_matching(kv.compact(log(spark, sf_dir)), "[37]$"))
query(f"""{LIVE} SELECT * FROM live WHERE regexp_matches("key", '^user:0000[0-4]')""", "kv_prefix")(lambda spark, sf_dir: kv.ascend_matching(kv.compact(log(spark, sf_dir)), "^user:0000[0-4]"))
query(
    f"""WITH l AS ({LOG}) SELECT count(*) AS records, count(DISTINCT "key") AS n_keys, count(*) FILTER (deleted) AS deletions, sum(octet_length(encode(value)))::BIGINT AS value_bytes FROM l""", "kv_statistics"
)(lambda spark, sf_dir: kv.statistics(log(spark, sf_dir)))


@query(
    f"""{LIVE}, b AS (SELECT "key", value FROM live WHERE "key" NOT IN ('user:000001', 'user:000002') UNION ALL SELECT 'user:000002', 'two' UNION ALL SELECT 'zz', 'new')
SELECT "key", value FROM b"""
)
def kv_batch(spark, sf_dir):
    """A batch of puts and deletes, read back from the log that it commits."""
    batch = kv.Batch(log(spark, sf_dir))
    batch.put("user:000001", "one")
    batch.put("user:000002", "two")
    batch.delete("user:000001")
    batch.put("zz", "new")
    return kv.compact(batch.commit()).select("key", "value")


@query(
    """WITH t AS (SELECT event_id, json_extract_string(props, '$.k') AS raw FROM events), v AS (SELECT event_id, raw, try_cast(raw AS DOUBLE) AS x FROM t)
SELECT count(*) AS n, count(*) FILTER (x IS NOT NULL AND x = floor(x)) AS n_integer, count(*) FILTER (raw IS NULL) AS n_missing FROM v"""
)
def schema_validate_report(spark, sf_dir):
    raw = F.get_json_object("props", "$.k")
    _, good = dml.typed_from_text(raw, "integer")
    rows = read(spark, sf_dir, "events").select(raw.alias("raw"), good.alias("good"))
    return rows.agg(F.count("*").alias("n"), F.count_if("good").alias("n_integer"), F.count_if(F.col("raw").isNull()).alias("n_missing"))


@query(
    """SELECT vec_id, concat_ws('; ', CASE WHEN vec_id % 7 = 0 THEN 'size: missing' END, CASE WHEN vec_id % 5 = 0 OR len(embedding) <> 64 THEN 'vector: dimension is not 64' END) AS wrong
FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 5 = 0 OR len(embedding) <> 64"""
)
def dim_validate(spark, sf_dir):
    """What keeps rows from being written: missing values and vectors of another dimension."""
    spec = CollectionSpec("things", 64, (IndexSpec("size", "integer"), IndexSpec("on", "boolean", enable_null=True)))
    short = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("vec_id")).alias("size"), F.lit(None).cast("boolean").alias("on"), short.alias("vector"))
    return rows.select("vec_id", F.array_join(dml.problems(spec), "; ").alias("wrong")).filter("wrong <> ''")


@query("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) > 50")
def variant_metadata_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").filter(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") > 50).select("event_id")


@query(
    """WITH k AS (SELECT 'row-' || vec_id AS k FROM embeddings),
h AS (SELECT list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM k)
SELECT (h % 12)::INT AS shard, count(*) AS n FROM h GROUP BY shard"""
)
def shard_histogram(spark, sf_dir):
    """Rows of each of twelve shards by the FNV-1a hash of their keys."""
    keys = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("row-"), F.col("vec_id").cast("string")).alias("k"))
    return keys.groupBy(S.fnv_shard(F.col("k"), 12).alias("shard")).agg(F.count("*").alias("n"))


def things(spark, rows: DataFrame, *columns: IndexSpec, name: str = "things", **how) -> tuple[Catalog, str]:
    """A loaded collection that holds ``rows``, in a catalog of its own."""
    catalog = Catalog(spark, f"{shared_dir(spark)}/collections-{uuid.uuid4().hex}")
    catalog.create(CollectionSpec(name, 64, columns, **how))
    catalog.load(name)
    catalog.insert(name, rows)
    return catalog, name


@query(
    """SELECT count(*) AS n_rows, sum(8 + 2 * 64)::BIGINT AS bytes, sum(length('label') + length('note') + length('on') + 8 + octet_length(encode('é' || vec_id)) + CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS metadata_bytes FROM embeddings"""
)
def collection_size(spark, sf_dir):
    ship(spark)
    rows = read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("label"), F.concat(F.lit("é"), F.col("vec_id").cast("string")).alias("note"), F.when(F.col("vec_id") % 2 == 0, F.lit(True)).alias("on"), F.col("embedding").alias("vector")
    )
    columns = IndexSpec("label", "integer"), IndexSpec("note", "string"), IndexSpec("on", "boolean", enable_null=True)
    size = Catalog.size(*things(spark, rows, *columns, quantization="f16"))
    return spark.createDataFrame([(size["rows"], size["bytes"], size["metadata_bytes"])], "n_rows long, bytes long, metadata_bytes long")


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE vec_id END AS size, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'x' END AS note, vec_id % 2 = 0 AS on_ FROM embeddings")
def defaults_fill(spark, sf_dir):
    k = F.col("vec_id")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(k % 7 != 0, k).alias("size"), F.when(k % 3 != 0, F.lit("x")).alias("note"), F.when(k % 2 == 0, F.lit(True)).alias("on_"))
    return dml.with_defaults(rows, CollectionSpec("things", 64, (IndexSpec("size", "integer"), IndexSpec("note", "string"), IndexSpec("on_", "boolean"))))


@query(
    """WITH i AS (SELECT o_orderkey, (1700000000000 + o_orderkey * 1000 - 1288834974657) * 4194304 + (o_custkey % 1024) * 4096 + o_orderkey % 4096 AS id FROM orders)
SELECT o_orderkey, id, lower(to_base(id, 36)) AS base36, lower(to_base(id, 2)) AS base2, (id >> 22) + 1288834974657 AS time_ms, (id >> 12) & 1023 AS node, id & 4095 AS step FROM i"""
)
def snowflake_ids(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", S.make_id(k * 1000 + 1700000000000, c % 1024, k % 4096).alias("id"))
    i = F.col("id")
    return rows.select("o_orderkey", "id", S.to_base(i, S.BASE36).alias("base36"), F.bin("id").alias("base2"), S.id_time_ms(i).alias("time_ms"), S.id_node(i).alias("node"), S.id_step(i).alias("step"))


@query(
    """WITH i AS (SELECT o_orderkey, (1700000000000 + o_orderkey * 1000 - 1288834974657) * 4194304 + (o_custkey % 1024) * 4096 + o_orderkey % 4096 AS id FROM orders)
SELECT o_orderkey, translate(lower(to_base(id, 32)), '0123456789abcdefghijklmnopqrstuv', 'ybndrfg8ejkmcpqxot1uwisza345h769') AS base32, id AS from32, id AS from58, base64(encode(id::VARCHAR)) AS base64,
lower(lpad(to_base(id, 16), 16, '0')) AS bytes, id AS from_bytes, (id % 32)::BIGINT AS worker, (id % 7)::BIGINT AS count, 1700000000000 + o_orderkey * 1000 AS time_ms FROM i"""
)
def identifier_texts(spark, sf_dir):
    """Numbers in three alphabets and as bytes, and short identifiers, written and read back."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ms = k * 1000 + 1700000000000
    rows = read(spark, sf_dir, "orders").select("o_orderkey", ms.alias("ms"), S.make_id(ms, c % 1024, k % 4096).alias("id"))
    i = F.col("id")
    rows = rows.withColumns({"base32": S.to_base(i, S.BASE32), "base58": S.to_base(i, S.BASE58), "raw": S.to_bytes(i), "short": S.short_id(F.col("ms"), i % 32, i % 7)})
    time_ms, worker, count = S.short_id_parts(F.col("short"))
    return rows.select(
        "o_orderkey", "base32", S.from_base(F.col("base32"), S.BASE32).alias("from32"), S.from_base(F.col("base58"), S.BASE58).alias("from58"), F.base64(i.cast("string").cast("binary")).alias("base64"),
        F.lower(F.hex("raw")).alias("bytes"), S.from_bytes(F.col("raw")).alias("from_bytes"), worker.alias("worker"), count.alias("count"), time_ms.alias("time_ms"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(pow(l_quantity, 2), 6) AS p, round(sqrt(l_extendedprice), 6) AS s, round(ln(l_extendedprice), 6) AS l,
trunc(l_extendedprice)::BIGINT AS t, floor(l_extendedprice)::BIGINT AS f, least(l_discount, l_tax) AS lo, greatest(l_discount, l_tax) AS hi FROM lineitem"""
)
def scalar_math(spark, sf_dir):
    x, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(d - 0.05).alias("a"), F.round(F.pow("l_quantity", F.lit(2.0)), 6).alias("p"), F.round(F.sqrt(x), 6).alias("s"),
        F.round(F.log(x), 6).alias("l"), x.cast("long").alias("t"), F.floor(x).alias("f"), F.least(d, t).alias("lo"), F.greatest(d, t).alias("hi"),
    )


@query("SELECT vec_id::VARCHAR AS name, CASE WHEN label = 3 THEN 99 ELSE label END::BIGINT AS type, vec_id % 2 = 0 AS expand FROM embeddings WHERE label <> 5")
def collection_round_trip(spark, sf_dir):
    """Create, load, insert, upsert by key, delete by condition, release and load again."""
    rows = collection(spark, sf_dir).select(F.col("vec_id").cast("string").alias("name"), "type", "expand", F.col("embedding").alias("vector"))
    catalog = Catalog(spark, f"{shared_dir(spark)}/collections-{uuid.uuid4().hex}")
    columns = (IndexSpec("name", "string", primary_key=True), IndexSpec("type", "integer"), IndexSpec("expand", "boolean", enable_null=True))
    catalog.create(CollectionSpec("things", 64, columns))
    catalog.load("things")
    catalog.upsert("things", rows)
    catalog.upsert("things", rows.filter("type = 3").withColumn("type", F.lit(99.0)))
    catalog.delete_where("things", {"type": 5.0})
    catalog.release("things")
    return catalog.read("things").select("name", "type", "expand")


@query(
    """WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id::VARCHAR AS name, event_id AS size FROM last WHERE k = 1 AND event_id % 11 <> 0"""
)
def change_feed(spark, sf_dir):
    """Changes written to a folder, read as a stream and applied to a collection."""
    root = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    catalog = Catalog(spark, f"{root}/collections")
    catalog.create(CollectionSpec("users", 2, (IndexSpec("name", "string", primary_key=True), IndexSpec("size", "integer")), distance="euclidean"))
    catalog.load("users")
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("size"), F.array(F.col("value").cast("float"), F.lit(1.0).cast("float")).alias("vector"),
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("upsert").alias(feed.OP),
    )
    events.write.parquet(f"{root}/changes")
    feed.apply_changes(catalog, "users", feed.watch(spark, f"{root}/changes", events.schema), f"{root}/checkpoint", "seq").awaitTermination()
    return catalog.read("users").select("name", "size")


@query(
    """WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id::VARCHAR AS name, event_id AS size FROM last WHERE k = 1 AND event_id % 11 <> 0"""
)
def change_feed_late(spark, sf_dir):
    """The later half of the changes comes first, and once more in the end: rows and deletions are those of the order by seq."""
    root = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    catalog = Catalog(spark, f"{root}/collections")
    catalog.create(CollectionSpec("users", 2, (IndexSpec("name", "string", primary_key=True), IndexSpec("size", "integer")), distance="euclidean"))
    catalog.load("users")
    one = F.array(F.lit(1.0).cast("float"), F.lit(1.0).cast("float"))
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("size"), one.alias("vector"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("upsert").alias(feed.OP))
    middle = events.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for k, part in enumerate((events.filter(F.col("seq") > middle), events.filter(F.col("seq") <= middle), events.filter(F.col("seq") > middle))):
        part.write.parquet(f"{root}/changes{k}")
        feed.apply_changes(catalog, "users", feed.watch(spark, f"{root}/changes{k}", events.schema), f"{root}/checkpoint{k}", "seq").awaitTermination()
    return catalog.read("users").select("name", "size")


for _kind in Q.FORMATS:
    _stored = f"list_transform(embedding::DOUBLE[], lambda x: {rounding_sql('x', _kind)})"

    @query(
        f"""WITH c AS (SELECT vec_id, {_stored} AS v FROM embeddings), q AS (SELECT v AS q FROM c WHERE vec_id = 0),
s AS (SELECT vec_id, list_distance(v, q) AS d FROM c, q) SELECT vec_id, round(d, {PLACES}) AS distance FROM s ORDER BY d, vec_id LIMIT 10""",
        f"quant_{_kind}_stored",
    )
    def quantized_collection(spark, sf_dir, kind=_kind):
        """Search of a collection that is stored as codes, after it has been written and loaded again."""
        ship(spark)
        rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
        catalog, name = things(spark, rows, IndexSpec("vec_id", "integer"), distance="euclidean", quantization=kind)
        catalog.release(name)
        loaded = catalog.load(name)
        q = search.vector_of(loaded, "vec_id", 0, "vector")
        return search.nearest(loaded, q, 10, id_column="vec_id", vector="vector", metric="euclidean", codec=kind).select("vec_id", F.round("distance", PLACES).alias("distance"))


def every_hundredth(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The collection and the queries of the approximate searches."""
    ship(spark)
    rows = collection(spark, sf_dir)
    return rows, rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def ranked(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", F.round("distance", PLACES).alias("distance"), "rank")


def recall_of(search_all: Callable[[SparkSession, str], DataFrame]) -> Query:
    """Recall of the registered search itself, for each of its queries."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, queries = every_hundredth(spark, sf_dir)
        return search.recall(search_all(spark, sf_dir), search.nearest_many(rows, queries, 10, id_column="vec_id"), 10)

    return run


@query()
def ann_cells(spark, sf_dir):
    rows, queries = every_hundredth(spark, sf_dir)
    return ranked(ann.CellIndex(rows, 16).search_many(queries, 10, id_column="vec_id"))


query(name="ann_cells_recall")(recall_of(ann_cells))


@query()
def ann_sign_hash(spark, sf_dir):
    rows, queries = every_hundredth(spark, sf_dir)
    dim = len(search.vector_of(rows, "vec_id", 0, "embedding"))
    return ranked(ann.SignHashIndex(rows, dim, tables=8, bits=6).search_many(queries, 10, id_column="vec_id"))


query(name="ann_sign_hash_recall")(recall_of(ann_sign_hash))


@query()
def ann_product(spark, sf_dir):
    rows, queries = every_hundredth(spark, sf_dir)
    dim = len(search.vector_of(rows, "vec_id", 0, "embedding"))
    return ranked(ann.ProductIndex(rows, dim, parts=8, centroids=32).search_many(queries, 10, id_column="vec_id"))


query(name="ann_product_recall")(recall_of(ann_product))


@query()
def ann_graph(spark, sf_dir):
    rows, queries = every_hundredth(spark, sf_dir)
    graphs = ann.build_graphs(rows, id_column="vec_id", shard_rows=500, ef_construction=64).persist()  # blocks of queries share it
    return ranked(ann.search_graphs_many(graphs, queries, 10, ef=64))


query(name="ann_graph_recall")(recall_of(ann_graph))


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def ann_graph_saved(spark, sf_dir):
    """A graph built once, stored with its collection and searched from there; whether its mean recall is 0.9 or more."""
    rows, queries = every_hundredth(spark, sf_dir)
    graph = {"m": 16, "ef_construction": 64, "ef": 64, "search_algorithm": "heuristic"}
    catalog, name = things(spark, rows.select("vec_id", F.col("embedding").alias("vector")), IndexSpec("vec_id", "integer"), graph=graph)
    catalog.build_index(name, "vec_id", shard_rows=500)
    found = catalog.search_index(name, queries.select("qid", F.col("embedding").alias("vector")), 10)
    exact = search.nearest_many(rows, queries, 10, id_column="vec_id")
    return search.recall(found, exact, 10).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


@query(
    """WITH w AS (SELECT vec_id, [list_sum(list_transform(range(0, 62), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT,
  list_sum(list_transform(range(62, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << (i - 62) ELSE 0 END))::BIGINT] AS w FROM embeddings),
q AS (SELECT w AS q FROM w WHERE vec_id = 0), d AS (SELECT vec_id, (bit_count(xor(w[1], q[1])) + bit_count(xor(w[2], q[2])))::BIGINT AS distance FROM w, q)
SELECT vec_id, distance FROM d ORDER BY distance, vec_id LIMIT 10"""
)
def binary_search(spark, sf_dir):
    rows = collection(spark, sf_dir)
    return ann.binary_search(rows, search.vector_of(rows, "vec_id", 0, "embedding"), 10, id_column="vec_id").select("vec_id", "distance")
