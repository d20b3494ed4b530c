"""Approximate search: cells around centroids, sign hashes, product codes, and navigable small-world graphs per shard.

Indexes are immutable tables made from a snapshot. Cells and hashes turn a search into a
filter on a column, which prunes partitions; graphs are adjacency tables that each task
walks for its own shards. What an index finds is ranked by exact distances.

How much a search reads isn't fixed: an index compares itself with exhaustive search on a
sample of its rows, and reads as much as finds AUDIT_RECALL of their neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quilldex.functions import vectors as V
from quilldex.operators.search import SLICE_ROWS, distances, nearest, nearest_many, query_blocks
from quilldex.types import GRAPH_DEFAULTS

#: Rows that centroids are fitted on at most; all rows are indexed.
FIT_ROWS = 200_000

#: Rows whose neighbours an index looks up to set how much a search reads, and the share of them that it must find.
AUDIT_QUERIES, AUDIT_RECALL = 256, 0.97


def _audit(rows: DataFrame, column: str, k: int, *, id_column: str, vector: str, metric: str) -> list[tuple[np.ndarray, list[tuple]]]:
    """For a sample of rows the vector, and (id, ``column``) of the k nearest other rows."""
    sample = rows.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_column), id_column).limit(AUDIT_QUERIES)
    queries = {r.qid: np.array(r.v, float) for r in sample.select(F.col(id_column).cast("long").alias("qid"), V.as_vector(vector).alias("v")).collect()}
    if not queries:
        return []
    asked = rows.sparkSession.createDataFrame([(i, v.tolist()) for i, v in queries.items()], f"qid long, {vector} array<double>")
    exact = nearest_many(rows, asked, k, id_column=id_column, vector=vector, metric=metric, include_self=False).select("qid", F.col("id").alias("_id"))
    near = rows.select(F.col(id_column).cast("long").alias("_id"), F.col(column).alias("_value")).join(F.broadcast(exact), "_id").collect()
    found: dict[int, list[tuple]] = {}
    for r in near:
        found.setdefault(r.qid, []).append((r._id, r._value))
    return [(queries[i], values) for i, values in sorted(found.items())]


def _enough(ranks: Sequence[int]) -> int:
    """How many first places hold AUDIT_RECALL of the neighbours at these ranks."""
    return int(np.sort(ranks)[math.ceil(AUDIT_RECALL * len(ranks)) - 1]) + 1 if len(ranks) else 1


class CellIndex:
    """Vectors dealt to cells of nearest centroids; a search reads the cells nearest to the query, as many as the audit asks for unless told."""

    def __init__(self, rows: DataFrame, cells: int, *, vector: str = "embedding", metric: str = "cosine", seed: int = 1, fit_rows: int = FIT_ROWS):
        self.vector, self.metric = vector, metric
        v = V.as_vector(vector)
        ready = rows.filter(v.isNotNull()).withColumn("_features", array_to_vector(V.normalize(v) if metric == "cosine" else v))
        n = ready.count()
        sample = ready.sample(min(1.0, fit_rows / n), seed) if n > fit_rows else ready
        self.model = KMeans(k=cells, seed=seed, featuresCol="_features", predictionCol="cell", maxIter=20).fit(sample)
        self.centroids = np.array(self.model.clusterCenters())
        self.rows = self.model.transform(ready).drop("_features")
        self._probes: dict[int, int] = {}

    def write(self, path: str) -> None:
        """One folder a cell: a search lists and reads only those it probes."""
        self.rows.repartition("cell").write.partitionBy("cell").parquet(path)

    def order(self, query: Sequence[float]) -> np.ndarray:
        """All cells, the nearest first."""
        q = np.array(query, float)
        if self.metric == "cosine" and (norm := float(np.sqrt(q @ q))):
            q = q / norm
        return np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable")

    def probed(self, query: Sequence[float], probes: int) -> list[int]:
        return [int(c) for c in self.order(query)[:probes]]

    def probes(self, k: int, id_column: str) -> int:
        """Cells that searches of k neighbours have to read."""
        if k not in self._probes:
            ranks = []
            for q, near in _audit(self.rows, "cell", k, id_column=id_column, vector=self.vector, metric=self.metric):
                rank = np.argsort(self.order(q))
                ranks += [rank[cell] for _, cell in near]
            self._probes[k] = _enough(ranks)
        return self._probes[k]

    def search(self, query: Sequence[float], k: int, probes: int | None = None, *, id_column: str, rows: DataFrame | None = None) -> DataFrame:
        near = (self.rows if rows is None else rows).filter(F.col("cell").isin(self.probed(query, probes or self.probes(k, id_column))))
        return nearest(near, query, k, id_column=id_column, vector=self.vector, metric=self.metric)

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None, *, id_column: str) -> DataFrame:
        """(qid, id, distance, rank) of many queries (qid, vector)."""
        probes = probes or self.probes(k, id_column)

        def among(q: np.ndarray):
            read = np.zeros((len(q), len(self.centroids)), bool)
            for i, one in enumerate(q):
                read[i, self.probed(one, probes)] = True
            return _CellsRead(read)

        return nearest_many(self.rows, queries, k, id_column=id_column, vector=self.vector, metric=self.metric, column="cell", among=among)


class _CellsRead:
    def __init__(self, read: np.ndarray):
        self.read = read

    def __call__(self, column: pa.Array) -> np.ndarray:
        return self.read[:, column.to_numpy(zero_copy_only=False)]


class SignHashIndex:
    """Tables of buckets by the signs of random projections; a search reads, of each table, the buckets nearest to the query.

    A bucket is the farther, the more has to be crossed: its cost is the sum of squares of the
    query's projections whose signs differ. Unless told, a search probes what the audit asks for;
    it goes on to farther buckets where those have fewer than k rows.
    """

    def __init__(self, rows: DataFrame, dim: int, *, tables: int = 8, bits: int = 8, vector: str = "embedding", seed: int = 1):
        if not 1 <= bits <= 16:
            raise ValueError("a table has 1 to 16 bits")
        self.vector = vector
        self.planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
        ready = rows.filter(F.size(vector) == dim).withColumn("_v", V.as_vector(vector))
        schema = T.StructType([*rows.schema.fields, T.StructField("buckets", T.ArrayType(T.IntegerType()))])
        self.rows = ready.mapInArrow(lambda batches, planes=self.planes: _sign_hashes(batches, planes), schema)
        self._probes: dict[int, int] = {}
        self._sizes: np.ndarray | None = None

    def sizes(self) -> np.ndarray:
        """Rows of each table's buckets."""
        if self._sizes is None:
            tables, bits, _ = self.planes.shape
            self._sizes = np.zeros((tables, 1 << bits), np.int64)
            for t, bucket, n in self.rows.select(F.posexplode("buckets")).groupBy("pos", "col").count().collect():
                self._sizes[t, bucket] = n
        return self._sizes

    def order(self, query: Sequence[float]) -> np.ndarray:
        """For each table all buckets, the nearest first."""
        m = self.planes @ np.array(query, float)
        bits = np.arange(1 << m.shape[1])[:, None] >> np.arange(m.shape[1]) & 1
        return np.stack([np.argsort(((bits != (one > 0)) * one**2).sum(1), kind="stable") for one in m])

    def probes(self, k: int, id_column: str) -> int:
        """Buckets a table that searches of k neighbours have to read."""
        if k not in self._probes:
            ranks = []
            for q, near in _audit(self.rows, "buckets", k, id_column=id_column, vector=self.vector, metric="cosine"):
                rank = np.argsort(self.order(q), 1)
                ranks += [rank[np.arange(len(rank)), buckets].min() for _, buckets in near]
            self._probes[k] = _enough(ranks)
        return self._probes[k]

    def probed(self, query: Sequence[float], k: int, probes: int) -> np.ndarray:
        """The buckets of each table that a search reads."""
        order = self.order(query)
        short = (np.take_along_axis(self.sizes(), order, 1).cumsum(1) < k).sum(1).min()
        return order[:, : max(probes, short + 1)]

    def search(self, query: Sequence[float], k: int, *, id_column: str, probes: int | None = None) -> DataFrame:
        hit = F.lit(False)
        for t, buckets in enumerate(self.probed(query, k, probes or self.probes(k, id_column))):
            hit = hit | F.get("buckets", F.lit(t)).isin(buckets.tolist())
        return nearest(self.rows.filter(hit), query, k, id_column=id_column, vector=self.vector)

    def search_many(self, queries: DataFrame, k: int, *, id_column: str, probes: int | None = None) -> DataFrame:
        """(qid, id, distance, rank) of many queries (qid, vector)."""
        probes = probes or self.probes(k, id_column)

        def among(q: np.ndarray):
            tables, bits, _ = self.planes.shape
            read = np.zeros((tables, len(q), 1 << bits), bool)
            for i, one in enumerate(q):
                np.put_along_axis(read[:, i], self.probed(one, k, probes), True, 1)
            return _BucketsRead(read)

        return nearest_many(self.rows, queries, k, id_column=id_column, vector=self.vector, column="buckets", among=among)


class _BucketsRead:
    def __init__(self, read: np.ndarray):
        self.read = read

    def __call__(self, column: pa.Array) -> np.ndarray:
        buckets = _codes(column)
        out = self.read[0][:, buckets[:, 0]]
        for t in range(1, len(self.read)):
            out |= self.read[t][:, buckets[:, t]]
        return out


def _sign_hashes(batches: Iterator[pa.RecordBatch], planes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the vectors, by their bucket in every table: one matrix product a batch."""
    tables, bits, dim = planes.shape
    for batch in batches:
        x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        signs = (x @ planes.reshape(-1, dim).T > 0).reshape(len(x), tables, bits)
        buckets = (signs << np.arange(bits)).sum(2).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, tables), pa.int32()), pa.array(buckets.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "buckets"])


class ProductIndex:
    """Product quantization: every slice of a vector becomes the number of its nearest centroid.

    Centroids are fitted on at most FIT_SAMPLE rows, all rows are encoded. A search looks
    up distances between the query's slices and the centroids and sums them for each row;
    ``refine`` ranks that many of the best by exact distance. What the estimates need of it
    to find the neighbours grows with the table, so the audit measures it on the table itself.
    """

    FIT_SAMPLE, ROUNDS, BINS = 20_000, 15, 512

    def __init__(self, rows: DataFrame, dim: int, *, parts: int = 8, centroids: int = 64, vector: str = "embedding", metric: str = "cosine", seed: int = 1):
        if dim % parts or not 1 <= centroids <= 256:
            raise ValueError("parts must divide the dimension, and there are 1 to 256 centroids")
        self.vector, self.metric = vector, metric
        ready = rows.filter(F.size(vector) == dim)
        n = ready.count()
        taken = ready if n <= self.FIT_SAMPLE else ready.sample(self.FIT_SAMPLE / n, seed)
        x = np.array([r.v for r in taken.select(V.as_vector(vector).alias("v")).limit(self.FIT_SAMPLE).collect()], float).reshape(-1, parts, dim // parts)
        self.books = np.stack([self._fit(self._scaled(x)[:, k], centroids, seed + k) for k in range(parts)])
        schema = T.StructType([*rows.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])
        books, scaled = self.books, self._scaled
        self.rows = ready.withColumn("_v", V.as_vector(vector)).mapInArrow(lambda b: _encode(b, books, scaled), schema)
        self._refined: dict[int, int] = {}

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        """Cosine ranks as the distance of vectors at length 1 does."""
        if self.metric != "cosine":
            return x
        norm = np.sqrt((x * x).sum((1, 2), keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    @classmethod
    def _fit(cls, x: np.ndarray, k: int, seed: int) -> np.ndarray:
        centre = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(cls.ROUNDS):
            near = _nearest_centroid(x, centre)
            count = np.bincount(near, minlength=len(centre))
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        return centre

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Distances between queries' slices and the centroids: (query, part, centroid)."""
        parts, _, width = self.books.shape
        return ((self.books[None] - self._scaled(q.reshape(-1, parts, width))[:, :, None, :]) ** 2).sum(3)

    def refined(self, k: int, id_column: str) -> int:
        """Rows that searches of k neighbours have to rank by exact distance."""
        if k not in self._refined:
            found = _audit(self.rows, "codes", k, id_column=id_column, vector=self.vector, metric=self.metric)
            near = [(n, i, codes) for n, (_, values) in enumerate(found) for i, codes in values]
            ranks: list[int] = []
            if near:
                tables = self.tables(np.array([q for q, _ in found]))
                at, ids, codes = (np.array(x) for x in zip(*near, strict=True))
                marks = [np.array([_estimates(tables[[n]], codes[[j]])[0, 0] for j, n in enumerate(at)]), ids, at]
                ahead = self.rows.select(F.col(id_column).cast("long").alias("id"), "codes").mapInArrow(lambda b: _count_ahead(b, tables, *marks), "mark int, n long")
                ranks = [r.n for r in ahead.groupBy("mark").agg(F.sum("n").alias("n")).collect()]
            self._refined[k] = max(k, _enough(ranks))
        return self._refined[k]

    def search(self, query: Sequence[float], k: int, *, id_column: str, refine: int | None = 0) -> DataFrame:
        """By estimates alone, or with ``refine`` rows ranked by exact distance; as many as the audit asks for if that is None."""
        tables = self.tables(np.array(query, float))[0]
        terms = [F.get(F.array(*[F.lit(float(d)) for d in table]), F.get("codes", F.lit(p))) for p, table in enumerate(tables)]
        found = self.rows.withColumn("estimate", sum(terms[1:], terms[0])).orderBy("estimate", id_column)
        refine = self.refined(k, id_column) if refine is None else refine
        if not refine:
            return found.limit(k)
        return nearest(found.limit(max(refine, k)), query, k, id_column=id_column, vector=self.vector, metric=self.metric)

    def search_many(self, queries: DataFrame, k: int, *, id_column: str, refine: int | None = None) -> DataFrame:
        """(qid, id, distance, rank) of many queries (qid, vector).

        Counts of estimates in BINS ranges give each query's bound, below which at least ``refine`` rows
        are; all rows below it are ranked by exact distance, so no task holds more than its best k.
        """
        refine, bins = self.refined(k, id_column) if refine is None else max(refine, k), self.BINS

        def among(q: np.ndarray):
            tables = self.tables(q)
            low, high = tables.min(2).sum(1), tables.max(2).sum(1)
            step = np.maximum((high - low) / bins, 1e-12)
            counted = self.rows.select("codes").mapInArrow(lambda b: _count_bins(b, tables, low, step, bins), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            below = F.sum("n").over(Window.partitionBy("q").orderBy("bin"))
            last = np.full(len(q), bins)
            for n, b in counted.withColumn("below", below).filter(F.col("below") >= refine).groupBy("q").agg(F.min("bin")).collect():
                last[n] = b
            return _EstimatedNear(tables, low, step, bins, last)

        return nearest_many(self.rows, queries, k, id_column=id_column, vector=self.vector, metric=self.metric, column="codes", among=among)


def _estimates(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of the tables' entries: queries x rows."""
    out = tables[:, 0][:, codes[:, 0]]
    for p in range(1, codes.shape[1]):
        out += tables[:, p][:, codes[:, p]]
    return out


def _codes(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bin(estimates: np.ndarray, low: np.ndarray, step: np.ndarray, bins: int) -> np.ndarray:
    return np.clip((estimates - low[:, None]) / step[:, None], 0, bins - 1).astype(np.int32)


def _count_bins(batches: Iterator[pa.RecordBatch], tables: np.ndarray, low: np.ndarray, step: np.ndarray, bins: int) -> Iterator[pa.RecordBatch]:
    """A task's counts of estimates by query and range."""
    counts = np.zeros(len(tables) * bins, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            found = _bin(_estimates(tables, _codes(batch.column(0).slice(at, SLICE_ROWS))), low, step, bins)
            counts += np.bincount((found + bins * np.arange(len(tables))[:, None]).ravel(), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used // bins, pa.int32()), pa.array(used % bins, pa.int32()), pa.array(counts[used], pa.int64())], names=["q", "bin", "n"])


def _count_ahead(batches: Iterator[pa.RecordBatch], tables: np.ndarray, marks: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts of rows that the order of estimates puts before each mark, a neighbour of query ``at``."""
    counts = np.zeros(len(marks), np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            own = part.column(0).to_numpy(zero_copy_only=False)
            estimates = _estimates(tables, _codes(part.column(1)))
            for j, n in enumerate(at):
                e = estimates[n]
                counts[j] += np.count_nonzero((e < marks[j]) | ((e == marks[j]) & (own < ids[j])))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(marks)), pa.int32()), pa.array(counts)], names=["mark", "n"])


class _EstimatedNear:
    def __init__(self, *how):
        self.how = how

    def __call__(self, column: pa.Array) -> np.ndarray:
        tables, low, step, bins, last = self.how
        return _bin(_estimates(tables, _codes(column)), low, step, bins) <= last[:, None]


def _nearest_centroid(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1)[None, :] - 2 * x @ centre.T).argmin(1)


def _encode(batches: Iterator[pa.RecordBatch], books: np.ndarray, scaled) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        x = scaled(batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width))
        codes = np.stack([_nearest_centroid(x[:, p], books[p]) for p in range(parts)], 1).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "codes"])


class SmallWorld:
    """A hierarchical graph in memory: insert, remove, get and search.

    A node links to at most ``m`` others when it comes and keeps ``m_max`` of them (m), on the
    ground ``m_max0`` (2 m); levels decline with ``level_scale`` (1 / ln m). ``search_algorithm``
    chooses links: ``heuristic`` takes candidates that are nearer to the node than to any link
    chosen before and fills up with the nearest, ``simple`` takes the nearest.
    """

    def __init__(self, metric: str = "cosine", m: int = GRAPH_DEFAULTS["m"], ef_construction: int = GRAPH_DEFAULTS["ef_construction"], ef: int = GRAPH_DEFAULTS["ef"], seed: int = 1, search_algorithm: str = GRAPH_DEFAULTS["search_algorithm"], m_max: int | None = None, m_max0: int | None = None, level_scale: float | None = None):
        if search_algorithm not in ("heuristic", "simple"):
            raise ValueError(f"unknown search algorithm {search_algorithm}")
        self.metric, self.m, self.ef_construction, self.ef = metric, m, ef_construction, ef
        self.heuristic = search_algorithm == "heuristic"
        self.m_max, self.m_max0, self.level_scale = m_max or m, m_max0 or 2 * m, level_scale or 1 / math.log(max(2, m))
        self.random = np.random.default_rng(seed)
        self.vectors: dict[int, np.ndarray] = {}
        self.level: dict[int, int] = {}
        self.links: list[dict[int, dict[int, float]]] = []
        self.entry: int | None = None

    def far(self, q: np.ndarray, ids: list[int]) -> list[float]:
        if not ids:
            return []
        return distances(np.array([self.vectors[i] for i in ids]), q[None, :], self.metric)[0].tolist()

    def beam(self, q: np.ndarray, start: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """Up to ``width`` nearest nodes of a level that are reached, nearest first."""
        open_nodes = list(zip(self.far(q, start), start, strict=True))
        heapq.heapify(open_nodes)
        best = [(-d, i) for d, i in open_nodes]
        heapq.heapify(best)
        seen = set(start)
        while open_nodes:
            d, i = heapq.heappop(open_nodes)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [j for j in self.links[level].get(i, ()) if j not in seen]
            seen.update(fresh)
            for e, j in zip(self.far(q, fresh), fresh, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(open_nodes, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _down(self, q: np.ndarray, to: int) -> list[int]:
        here = [self.entry]
        for level in range(len(self.links) - 1, to, -1):
            here = [self.beam(q, here, 1, level)[0][1]]
        return here

    def insert(self, node: int, vector: Sequence[float]) -> None:
        """A known node is replaced."""
        if node in self.vectors:
            self.remove(node)
        q = np.asarray(vector, float)
        top = int(-math.log(1 - self.random.random()) * self.level_scale) if self.entry is not None else 0
        self.vectors[node], self.level[node] = q, top
        while len(self.links) <= top:
            self.links.append({})
        for level in range(top + 1):
            self.links[level][node] = {}
        if self.entry is None:
            self.entry = node
            return
        start = self._down(q, min(top, self.level[self.entry]))
        for level in range(min(top, self.level[self.entry]), -1, -1):
            found = self.beam(q, start, self.ef_construction, level)
            most = self.m_max0 if level == 0 else self.m_max
            for d, other in self.select(found, self.m):
                self.links[level][node][other] = d
                back = self.links[level][other]
                back[node] = d
                if len(back) > most:
                    self.links[level][other] = {i: e for e, i in self.select(sorted((e, i) for i, e in back.items()), most)}
            start = [i for _, i in found]
        if top > self.level[self.entry]:
            self.entry = node

    def select(self, found: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
        """Links among candidates (distance, node), nearest first."""
        if not self.heuristic or len(found) <= most:
            return found[:most]
        between = distances(x := np.array([self.vectors[i] for _, i in found]), x, self.metric)
        chosen: list[int] = []
        for k, (d, _) in enumerate(found):
            if all(d < between[k, c] for c in chosen):
                chosen.append(k)
                if len(chosen) == most:
                    break
        taken = set(chosen)
        rest = [k for k in range(len(found)) if k not in taken]
        return [found[k] for k in sorted(chosen + rest[: most - len(chosen)])]

    def get(self, node: int) -> np.ndarray | None:
        """A node's vector, None if it isn't there."""
        return self.vectors.get(node)

    def remove(self, node: int) -> bool:
        """Takes a node out and joins its neighbours with one another; false if it isn't there."""
        if node not in self.vectors:
            return False
        for level in range(self.level[node] + 1):
            around = [i for i, links in self.links[level].items() if node in links]
            beside = [i for i in self.links[level].pop(node) if i in self.links[level]]
            for i in around:
                links = self.links[level][i]
                del links[node]
                near = [j for j in beside if j != i and j not in links]
                for d, j in sorted(zip(self.far(self.vectors[i], near), near, strict=True))[:2]:
                    links[j] = d
        del self.vectors[node], self.level[node]
        if self.entry == node:
            self.entry = max(self.level, key=lambda i: (self.level[i], -i), default=None)
            while self.links and not self.links[-1]:
                self.links.pop()
        return True

    def search(self, query: Sequence[float], k: int, ef: int | None = None) -> list[tuple[float, int]]:
        if self.entry is None:
            return []
        q = np.asarray(query, float)
        return self.beam(q, self._down(q, 0), max(k, ef or self.ef), 0)[:k]

    def table(self) -> pd.DataFrame:
        """Adjacency: a row for each node and level, the snapshot of the graph."""
        rows = [(i, level, [*links], [*links.values()], self.vectors[i].tolist() if level == 0 else None) for level, nodes in enumerate(self.links) for i, links in nodes.items()]
        return pd.DataFrame(rows, columns=["id", "level", "neighbours", "distances", "vector"])

    @staticmethod
    def from_table(rows: pd.DataFrame, metric: str, ef: int = GRAPH_DEFAULTS["ef"], m: int = GRAPH_DEFAULTS["m"]) -> SmallWorld:
        g = SmallWorld(metric, m=m, ef=ef)
        for r in rows.sort_values("level").itertuples():
            while len(g.links) <= r.level:
                g.links.append({})
            g.links[r.level][r.id] = dict(zip((int(x) for x in r.neighbours), (float(x) for x in r.distances), strict=True))
            g.level[r.id] = r.level
            if r.level == 0:
                g.vectors[r.id] = np.asarray(r.vector, float)
        g.entry = max(g.level, key=lambda i: (g.level[i], -i), default=None)
        return g


GRAPH_SCHEMA = "shard int, id long, level int, neighbours array<long>, distances array<double>, vector array<double>"


def build_graphs(rows: DataFrame, *, id_column: str, vector: str = "embedding", metric: str = "cosine", shard_rows: int = 20_000, **params) -> DataFrame:
    """The adjacency table of one graph for each shard; shards hold about ``shard_rows`` rows each."""
    shards = max(1, math.ceil(rows.count() / shard_rows))
    v = V.as_vector(vector)
    flat = rows.filter(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(id_column), F.lit(shards)).cast("int").alias("shard"), F.col(id_column).cast("long").alias("id"), v.alias("v"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        g = SmallWorld(metric, **params)
        for r in part.sort_values("id").itertuples():
            g.insert(r.id, r.v)
        out = g.table()
        out.insert(0, "shard", part["shard"].iloc[0])
        return out

    return flat.groupBy("shard").applyInPandas(build, GRAPH_SCHEMA)


def search_graphs(graphs: DataFrame, query: Sequence[float], k: int, *, metric: str = "cosine", ef: int = GRAPH_DEFAULTS["ef"]) -> DataFrame:
    """(id, distance): every shard's nearest, then the nearest of those."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = SmallWorld.from_table(part, metric).search(query, k, ef)
        return pd.DataFrame([(i, d) for d, i in found], columns=["id", "distance"])

    return graphs.groupBy("shard").applyInPandas(run, "id long, distance double").orderBy("distance", "id").limit(k)


def search_graphs_many(graphs: DataFrame, queries: DataFrame, k: int, *, vector: str = "embedding", metric: str = "cosine", ef: int = GRAPH_DEFAULTS["ef"]) -> DataFrame:
    """(qid, id, distance, rank) of many queries (qid, vector); every block of them walks the graphs once."""
    def walk(sent):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            g = SmallWorld.from_table(part, metric)
            rows = [(qid, i, d) for qid, q in zip(*sent.value, strict=True) for d, i in g.search(q, k, ef)]
            return pd.DataFrame(rows, columns=["qid", "id", "distance"])

        return run

    schema = "qid long, id long, distance double"
    out = graphs.sparkSession.createDataFrame([], schema)
    for ids, matrix in query_blocks(queries, "qid", vector):
        sent = graphs.sparkSession.sparkContext.broadcast((ids.tolist(), matrix))
        out = out.unionByName(graphs.groupBy("shard").applyInPandas(walk(sent), schema))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def binary_search(rows: DataFrame, query: Sequence[float], k: int, *, id_column: str, vector: str = "embedding") -> DataFrame:
    """Nearest by the bits of binary quantization: Hamming distance of the elements' signs."""
    words = [sum(1 << (i - low) for i in range(low, min(len(query), low + 62)) if query[i] > 0) for low in range(0, len(query), 62)]
    bits = V.sign_bits(V.as_vector(vector), len(query))
    found = rows.withColumn("distance", V.hamming(bits, F.array(*[F.lit(w).cast("long") for w in words])))
    return found.orderBy(F.col("distance").asc_nulls_last(), id_column).limit(k)

