"""Collections on any file system that Spark reaches: Parquet snapshots and a pointer to the current one.

<root>/<name>/spec.json       the collection's declaration
<root>/<name>/v=<n>/          a snapshot; vectors of quantized collections are stored as their codes
<root>/<name>/feed=<n>/       the last change of every key that a change feed has brought
<root>/<name>/index=<n>/      a graph index of snapshot n
<root>/<name>/CURRENT.<n>     snapshot n counts, unless there is a higher one; its text numbers the feed's table

A write makes a new snapshot and then renames one small file to CURRENT.<n>: readers see the
old rows or the new ones, and whatever ends a write half way leaves the old ones in force.
Without versioning the snapshot before stays for those who read it, older ones are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilldex.functions import quantize as Q
from quilldex.operators import ann, dml
from quilldex.types import CollectionError, CollectionSpec


class Store:
    """Small files and folders through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        p = self.path(name)
        return self._fs(p).exists(p)

    def remove(self, name: str) -> None:
        p = self.path(name)
        self._fs(p).delete(p, True)

    def names(self, name: str = "") -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self._fs(p).listStatus(p)) if self._fs(p).exists(p) else []

    def read(self, name: str) -> str:
        p = self.path(name)
        stream = self._fs(p).open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new small file, written beside and renamed, so that a reader never sees half of it."""
        p, made = self.path(name), self.path(f"{name}.new")
        fs = self._fs(p)
        stream = fs.create(made, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(p) or not fs.rename(made, p):
            raise CollectionError(f"could not write {p}")


class Catalog:
    """Creates, drops, loads, changes and writes collections."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self._loaded: dict[str, DataFrame] = {}

    def ping(self) -> bool:
        """Whether the catalog's folder can be reached."""
        self.store.names()
        return True

    def list(self) -> list[str]:
        return [n for n in self.store.names() if self.store.exists(f"{n}/spec.json")]

    def exists(self, name: str) -> bool:
        return self.store.exists(f"{name}/spec.json")

    def create(self, spec: CollectionSpec) -> None:
        """A collection without rows; if it can't be made whole, nothing of it stays."""
        if self.exists(spec.name):
            raise CollectionError(f"collection {spec.name} exists")
        try:
            self._snapshot(spec, self.spark.createDataFrame([], spec.schema()))
            self.store.write(f"{spec.name}/spec.json", spec.to_json())
        except Exception:
            self.store.remove(spec.name)
            raise

    def drop(self, name: str) -> None:
        """Removes a collection; one that isn't there is dropped already."""
        if name in self._loaded:
            self._loaded.pop(name).unpersist()
        self.store.remove(name)

    def spec(self, name: str) -> CollectionSpec:
        if not self.exists(name):
            raise CollectionError(f"collection {name} not found")
        return CollectionSpec.from_json(self.store.read(f"{name}/spec.json"))

    def info(self, name: str) -> dict:
        spec = self.spec(name)
        if name not in self._loaded:
            return {"name": name, "load": False}
        return {"name": name, "load": True, "rows": self._loaded[name].count(), "spec": spec, "versions": self.versions(name)}

    def versions(self, name: str) -> list[int]:
        return sorted(int(v[2:]) for v in self.store.names(name) if v.startswith("v="))

    def current(self, name: str) -> int:
        """The highest snapshot that has been made to count."""
        return max(self._pointers(name))

    def _pointers(self, name: str) -> list[int]:
        return [int(n.removeprefix("CURRENT.")) for n in self.store.names(name) if n.startswith("CURRENT.") and not n.endswith(".new")]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        spec = self.spec(name)
        stored = self.spark.read.parquet(f"{self.store.root}/{name}/v={self.current(name) if version is None else version}")
        return Q.decoded(stored, spec.quantization, list(spec.vector_columns()))

    def load(self, name: str) -> DataFrame:
        """Reads the current snapshot; storage spills to disk where memory ends."""
        self._loaded[name] = self.read(name).persist()
        return self._loaded[name]

    def rows(self, name: str) -> DataFrame:
        self.spec(name)
        if name not in self._loaded:
            raise CollectionError(f"collection {name} is not loaded in memory")
        return self._loaded[name]

    def release(self, name: str) -> None:
        """Writes and unloads; what is released already stays so."""
        self.spec(name)
        if name in self._loaded:
            self.flush(name)
            self._loaded.pop(name).unpersist()

    def flush(self, name: str) -> int:
        """Writes the loaded rows as a new snapshot, reads from it from now on, and returns its number."""
        self._replace(name, self.rows(name))
        return self.current(name)

    def flush_all(self) -> None:
        for name in [*self._loaded]:
            self.flush(name)

    def _snapshot(self, spec: CollectionSpec, rows: DataFrame, feed: DataFrame | None = None) -> int:
        name, pointers = spec.name, self._pointers(spec.name)
        # numbers of writes that came to nothing are not used again
        version = max([0, *pointers, *self.versions(name)]) + 1
        Q.encoded(rows, spec.quantization, list(spec.vector_columns())).write.parquet(f"{self.store.root}/{name}/v={version}")
        number = version
        if feed is not None:
            feed.write.parquet(f"{self.store.root}/{name}/feed={version}")
        else:
            number = self._feed_number(name)
        self.store.write(f"{name}/CURRENT.{version}", str(number))
        if not spec.versioning:
            keep = {version, *pointers[-1:], max(pointers, default=version)}
            for old in self.versions(name):
                if old not in keep:
                    for part in (f"CURRENT.{old}", f"index={old}", f"v={old}", *([f"feed={old}"] if old != number else [])):
                        self.store.remove(f"{name}/{part}")
        return version

    def _feed_number(self, name: str) -> int:
        pointers = self._pointers(name)
        return int(self.store.read(f"{name}/CURRENT.{max(pointers)}")) if pointers else 0

    def fed(self, name: str) -> DataFrame | None:
        """(key, seq): the last change of every key that a feed has brought, deleted ones too; None before the first."""
        number = self._feed_number(name)
        return self.spark.read.parquet(f"{self.store.root}/{name}/feed={number}") if number else None

    def apply(self, name: str, changes: DataFrame, op: str, seq: str) -> None:
        """A batch of changes as one snapshot; ``op`` is upsert or delete.

        The last change of a key by ``seq`` counts, over this batch and all before: an older
        one that comes late changes nothing, nor does a batch that comes again.
        """
        spec = self.spec(name)
        if spec.key is None:
            raise CollectionError(f"{name} has no primary key")
        last, known = dml.latest(changes, spec.key, seq), self.fed(name)
        if known is not None:
            before = known.select(F.col("key").alias("_key"), F.col("seq").alias("_seq"))
            last = last.join(before, F.col(spec.key) == F.col("_key"), "left").filter(F.col("_seq").isNull() | (F.col(seq) > F.col("_seq"))).drop("_key", "_seq")
        last = last.persist()
        try:
            if last.isEmpty():
                return
            feed = last.select(F.col(spec.key).alias("key"), F.col(seq).cast("long").alias("seq"))
            if known is not None:
                feed = known.join(feed.select("key"), "key", "left_anti").unionByName(feed)
            kept = dml.delete_keys(self.rows(name), last, spec.key)
            new = dml.checked(last.filter(F.col(op) != "delete").drop(op, seq), spec)
            self._replace(name, kept.unionByName(new, allowMissingColumns=True), feed)
        finally:
            last.unpersist()

    def _replace(self, name: str, rows: DataFrame, feed: DataFrame | None = None) -> None:
        """Makes changed rows the current snapshot and loads it, which cuts the plan that led there."""
        spec, before = self.spec(name), self.rows(name)
        self._snapshot(spec, rows, feed)
        before.unpersist()
        self.load(name)

    def build_index(self, name: str, id_column: str, vector: str = "vector", **how) -> int:
        """Writes the graph index of the current snapshot, as the collection's ``graph`` configures it; returns the snapshot's number."""
        spec, version = self.spec(name), self.current(name)
        config = {k: v for k, v in spec.graph.items() if k in ("m", "ef_construction", "search_algorithm", "m_max", "m_max0", "level_scale")}
        graphs = ann.build_graphs(self.read(name, version), id_column=id_column, vector=vector, metric=spec.distance, **config | how)
        graphs.write.parquet(f"{self.store.root}/{name}/index={version}")
        return version

    def index(self, name: str) -> DataFrame:
        """The index of the current snapshot; one of older rows doesn't count."""
        version = self.current(name)
        if not self.store.exists(f"{name}/index={version}"):
            raise CollectionError(f"collection {name} has no index of its current rows")
        return self.spark.read.schema(ann.GRAPH_SCHEMA).parquet(f"{self.store.root}/{name}/index={version}")

    def search_index(self, name: str, queries: DataFrame, k: int, *, vector: str = "vector", ef: int | None = None) -> DataFrame:
        """(qid, id, distance, rank) of many queries (qid, vector) from the stored index."""
        spec = self.spec(name)
        return ann.search_graphs_many(self.index(name), queries, k, vector=vector, metric=spec.distance, ef=ef or spec.graph["ef"])

    def insert(self, name: str, rows: DataFrame) -> None:
        self._replace(name, self.rows(name).unionByName(dml.checked(rows, self.spec(name)), allowMissingColumns=True))

    def upsert(self, name: str, changes: DataFrame, seq: str | None = None) -> None:
        """By primary key; without one every change is a new row."""
        spec = self.spec(name)
        changes = dml.checked(changes, spec)
        if spec.key is None:
            self._replace(name, self.rows(name).unionByName(changes.drop(seq) if seq else changes, allowMissingColumns=True))
        else:
            self._replace(name, dml.upsert(self.rows(name), changes, spec.key, seq))

    def delete_where(self, name: str, wanted: dict) -> None:
        self._replace(name, dml.delete_where(self.rows(name), wanted))

    def size(self, name: str) -> dict:
        """Rows, bytes of their numbers and vectors as stored, and bytes of their metadata."""
        spec = self.spec(name)
        width = Q.WIDTHS[spec.quantization]
        metadata = dml.metadata_bytes([c.name for c in spec.columns if c.type != "vector"], self.rows(name).schema)
        n, m = self.rows(name).agg(F.count("*"), F.coalesce(F.sum(metadata), F.lit(0))).first()
        return {"rows": n, "bytes": n * (8 + width * sum(spec.vector_columns().values())), "metadata_bytes": m}
