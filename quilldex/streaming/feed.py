"""Change feed: a folder of change files, read as a stream and applied batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quilldex.sources.catalog import Catalog

OP = "_op"


def watch(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """The changes written to a folder, in the order of the files."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def apply_changes(catalog: Catalog, name: str, changes: DataFrame, checkpoint: str, seq: str, trigger: dict | None = None):
    """Starts the stream that keeps a collection up to date; ``_op`` is upsert or delete.

    Every batch is one snapshot. The last change of a key counts, over all batches: the
    collection remembers each key's ``seq``, so changes may come late and batches again.
    """
    if catalog.spec(name).key is None:
        raise ValueError(f"{name} has no primary key")

    def apply(batch: DataFrame, _: int) -> None:
        catalog.apply(name, batch, OP, seq)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
