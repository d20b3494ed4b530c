"""Exact search: nearest vectors, filtered, hybrid, over several vectors, and for many queries.

A single search is a filter, one expression and an ordered limit: every task keeps its
own best rows and only those are shuffled. Searches of many queries multiply matrices in
Arrow batches and keep each task's best per query before a window ranks them. Order is
always (distance, id); rows without a distance come last.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilldex.functions import quantize as Q
from quilldex.functions import vectors as V
from quilldex.plans.filters import compile_filter, text_filter


def vector_of(rows: DataFrame, id_column: str, id_value, vector: str) -> list[float]:
    """The vector of one row, as a query."""
    found = rows.filter(F.col(id_column) == id_value).select(vector).limit(1).collect()
    if not found:
        raise KeyError(f"{id_column} = {id_value!r} not found")
    return [float(x) for x in found[0][0]]


def check_dimension(query: Sequence[float], dim: int) -> None:
    if len(query) != dim:
        raise ValueError(f"the query has {len(query)} elements, the collection's vectors {dim}")


def with_distance(rows: DataFrame, query: Sequence[float], vector: str = "embedding", metric: str = "cosine", codec: str = "none") -> DataFrame:
    """Adds ``distance``. With a codec both sides are compared as stored."""
    stored = F.col(vector) if codec == "none" else Q.quantize(V.as_vector(vector), codec)
    return rows.withColumn("distance", V.metric_by_name(metric)(stored, [Q.round_value(float(x), codec) for x in query]))


def nearest(
    rows: DataFrame, query: Sequence[float], k: int, *, id_column: str, vector: str = "embedding", metric: str = "cosine", where: dict | None = None,
    offset: int = 0, farthest: bool = False, codec: str = "none", least_score: float | None = None,
) -> DataFrame:
    """The k nearest rows after ``offset``, with distance and score; ``where`` filters first. ``farthest`` turns the order."""
    if where is not None:
        rows = rows.filter(compile_filter(where, rows.schema))
    found = with_distance(rows, query, vector, metric, codec)
    found = found.withColumn("score", V.score(F.col("distance"), "cosine" if metric == "cosine" else "euclidean"))
    if least_score is not None:
        found = found.filter(F.col("score") >= least_score)
    by = F.col("distance").desc_nulls_last() if farthest else F.col("distance").asc_nulls_last()
    found = found.orderBy(by, F.col(id_column))
    return found.offset(offset).limit(k) if offset else found.limit(k)


def filter_only(rows: DataFrame, wanted: dict[str, str], limit: int | None = None, id_column: str | None = None) -> DataFrame:
    """Rows that a schemaless filter matches, all at score 100."""
    found = rows.filter(text_filter(wanted, rows.schema)).withColumn("score", F.lit(100.0))
    if limit is None:
        return found
    return (found.orderBy(id_column) if id_column else found).limit(limit)


def hybrid(rows: DataFrame, query: Sequence[float], k: int, wanted: dict[str, str], *, id_column: str, mode: str = "pre", oversample: int = 3, **how) -> DataFrame:
    """Nearest rows that a schemaless filter matches: filtered first, or among the oversampled nearest ones afterwards."""
    if mode == "pre":
        return nearest(rows.filter(text_filter(wanted, rows.schema)), query, k, id_column=id_column, **how)
    if mode != "post":
        raise ValueError(f"unknown mode {mode}")
    near = nearest(rows, query, oversample * k, id_column=id_column, **how)
    return near.filter(text_filter(wanted, rows.schema)).orderBy(F.col("distance").asc_nulls_last(), id_column).limit(k)


def multi_vector(rows: DataFrame, parts: Sequence[dict], k: int, *, id_column: str, metric: str = "cosine", where: dict | None = None, dims: dict[str, int] | None = None) -> DataFrame:
    """The k rows of highest weighted score.

    ``parts`` name, vector, include, ratio: the ratios of included vectors must sum to 100;
    excluded ones are still checked, their dimension too. A row that lacks an included vector has
    no score and comes last. ``where`` filters first: the search of several vectors is hybrid then.
    """
    if where is not None:
        rows = rows.filter(compile_filter(where, rows.schema))
    used = [p for p in parts if p.get("include", True)]
    for p in parts:
        if p["name"] not in rows.columns:
            raise ValueError(f"not a defined vector: {p['name']}")
        if dims and p["name"] in dims:
            check_dimension(p["vector"], dims[p["name"]])
    if sum(p["ratio"] for p in used) != 100:
        raise ValueError("the ratios of the included vectors must sum to 100")
    scores = [(V.compare(F.col(p["name"]), p["vector"], metric), p["ratio"]) for p in used]
    return rows.withColumn("score", V.weighted(scores)).orderBy(F.col("score").desc_nulls_last(), id_column).limit(k)


def nearest_many(rows: DataFrame, queries: DataFrame, k: int, *, id_column: str, vector: str = "embedding", metric: str = "cosine", query_id: str = "qid", include_self: bool = True, column: str | None = None, among: Callable | None = None) -> DataFrame:
    """(qid, id, distance, rank): the k nearest rows of each query (qid, vector).

    The queries go to every task in blocks of QUERY_BLOCK; the rows are read once a block.
    Each task gives its best k per query, the window ranks what is left. With an index,
    ``among`` makes of a block's queries a function that tells by ``column``, for queries x rows, what is looked at.
    """
    read = [F.col(id_column).cast("long").alias("id"), V.as_vector(vector).alias("v"), *([F.col(column)] if column else [])]
    out = None
    for ids, matrix in query_blocks(queries, query_id, vector):
        sent = rows.sparkSession.sparkContext.broadcast((ids, matrix, among(matrix) if among else None))
        part = rows.select(*read).mapInArrow(lambda b, sent=sent: _best(b, *sent.value, k, metric, include_self), "qid long, id long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "qid long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


QUERY_BLOCK, SLICE_ROWS = 1024, 2048


def query_blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select(F.col(query_id).cast("long").alias("q"), V.as_vector(vector).alias("v")).orderBy("q").toLocalIterator():
        ids.append(r.q)
        rows.append(r.v)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows)


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows (columns of the result) from queries (its rows)."""
    if metric == "manhattan":
        return np.stack([np.abs(x - one).sum(1) for one in q])
    product = q @ x.T
    if metric in ("dot", "one_minus_dot"):
        return -product if metric == "dot" else 1 - product
    if metric == "cosine":
        norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.abs(1 - product / norm)
    squared = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * product, 0)
    return squared if metric == "squared_l2" else np.sqrt(squared)


def _best(batches: Iterator[pa.RecordBatch], qids: np.ndarray, q: np.ndarray, looked_at: Callable | None, k: int, metric: str, include_self: bool) -> Iterator[pa.RecordBatch]:
    """A task's k nearest rows of each query; what it holds meanwhile is k rows a query and one slice of distances."""
    near = np.full((len(qids), 0), np.inf)
    who = np.full((len(qids), 0), 0)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            sizes = pc.list_value_length(part.column(1))
            part = part.filter(pc.fill_null(pc.equal(sizes, q.shape[1]), False))
            if not part.num_rows:
                continue
            ids = part.column(0).to_numpy(zero_copy_only=False)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            d = distances(x, q, metric)
            if not include_self:
                d = np.where(qids[:, None] == ids[None, :], np.nan, d)
            if looked_at:
                d = np.where(looked_at(part.column(2)), d, np.nan)
            near = np.concatenate([near, np.where(np.isnan(d), np.inf, d)], 1)
            who = np.concatenate([who, np.broadcast_to(ids, d.shape)], 1)
            order = np.lexsort((who, near), axis=1)[:, :k]
            near, who = np.take_along_axis(near, order, 1), np.take_along_axis(who, order, 1)
    rows, cols = np.nonzero(np.isfinite(near))
    yield pa.RecordBatch.from_arrays([pa.array(qids[rows], pa.int64()), pa.array(who[rows, cols], pa.int64()), pa.array(near[rows, cols], pa.float64())], names=["qid", "id", "distance"])


def measured(found: DataFrame) -> tuple[list, dict]:
    """The rows of a search, and their number and the milliseconds that it took."""
    began = time.perf_counter()
    rows = found.collect()
    return rows, {"size": len(rows), "latency_ms": (time.perf_counter() - began) * 1000}


def merge_results(parts: Sequence[DataFrame], k: int, *, id_column: str, by: str = "score") -> DataFrame:
    """The best k rows of several results, each id once with its best ``by``; as shards' results are merged."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    best = union.groupBy(id_column).agg(F.max_by(F.struct("*"), by).alias("row")).select("row.*")
    return best.orderBy(F.col(by).desc_nulls_last(), id_column).limit(k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of each query's exact rows (qid, id) that were found."""
    hits = exact.select("qid", "id").join(found.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return exact.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / k).alias("recall"))
