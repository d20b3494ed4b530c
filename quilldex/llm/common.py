"""What the operators share: shared folders, tables kept there, shipping of code."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilldex import session

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


class Work:
    """Tables of one run of an operator, each in a folder of its own below the shared one.

    A written table cuts the lineage: a lost executor costs only the tasks of the
    stage that runs, and no table is computed twice.
    """

    #: Runs whose tables are still there.
    open: ClassVar[list[Work]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{session.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        Work.open.append(self)

    def keep(self, df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Removes the tables, once nothing reads them any more."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        if self in Work.open:
            Work.open.remove(self)


@atexit.register
def _close_all() -> None:
    """Working tables don't outlive the program, as far as its JVM is still there."""
    for work in [*Work.open]:
        try:
            work.close()
        except Exception:  # the JVM may be gone; the folder is the cluster's to clean then
            return


#: Rows and bytes of an Arrow batch: texts are long, and batches of Spark's 10,000 take tens of MB each on both sides.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
_MODEL: dict[str, object] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors and makes Arrow batches small, unless their size was set."""
    session.ship(spark)
    for name, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def model(key: str, build):
    """What build() makes, kept in the worker for its next tasks until another model takes its place."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = build()
    return _MODEL[key]


def trimmed(f):
    """A map over Arrow batches that gives freed memory back at its end, as its worker lives on."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(n: int, rest: int):
    """True where crc32(doc_id as text) mod n is rest; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == rest, F.lit(False))
