"""Inverted index: for each value of a column the rows that have it, as bitmaps in buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(rows: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """(column, value, bucket, bits): one bitmap for each value and bucket of ids; missing values have no posting."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("p")
    flat = rows.select(F.col(id_column).cast("long").alias("id"), pairs).select("id", "p.column", "p.value").filter("value is not null")
    return flat.groupBy("column", "value", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("column", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def union(postings: DataFrame) -> DataFrame:
    """(bucket, bits) of the rows in any of the postings."""
    return postings.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect(*parts: DataFrame) -> DataFrame:
    """(bucket, bits) of the rows in all of the parts, each with one bitmap a bucket as union() gives."""
    every = parts[0].select("bucket", "bits")
    for part in parts[1:]:
        every = every.unionByName(part.select("bucket", "bits"))
    return every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).filter(F.col("n") == len(parts)).drop("n")


def ids_of(bitmaps: DataFrame, name: str = "id") -> DataFrame:
    """The ids whose bits are set."""
    return bitmaps.select(F.col("bucket").cast("long").alias("bucket"), "bits").mapInArrow(lambda b: _ids(b, name), f"`{name}` long")


def rows_of(rows: DataFrame, bitmaps: DataFrame, id_column: str) -> DataFrame:
    """The rows whose ids are set: a semi join, so columns and filters of ``rows`` still reach their scan."""
    ids = ids_of(bitmaps, "_posted")
    return rows.join(ids, F.col(id_column) == F.col("_posted"), "left_semi")


def save(postings: DataFrame, path: str) -> None:
    """A snapshot, a folder for each column, so that a search reads its own columns only."""
    postings.write.partitionBy("column").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema("value string, bucket long, bits binary, column string").parquet(path).select("column", "value", "bucket", "bits")


def _ids(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Bucket 1 begins at id 1; buckets up to 0 count down from id 0."""
    for batch in batches:
        for bucket, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = np.frombuffer(bits.as_py(), np.uint8)
            at, width = np.flatnonzero(np.unpackbits(raw, bitorder="little")), 8 * len(raw)
            ids = (bucket - 1) * width + at + 1 if bucket > 0 else bucket * width - at
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=[name])
