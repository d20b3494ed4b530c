"""Bloom filters of digests: which rows may take part in a join, told before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for a digest, probes, and the most bits of a filter (16 MB): beyond, more rows pass, none is lost.
BITS_EACH, PROBES, LEAST_BITS, MOST_BITS = 16, 4, 1 << 16, 1 << 27
CHUNK_BYTES = 1 << 13


def _places(digests: list[bytes | None], bits: int) -> np.ndarray:
    """A row of PROBES bit numbers for each digest of 16 bytes or more; digests are random already."""
    raw = np.frombuffer(b"".join([bytes(16) if d is None else d[:16] for d in digests]), "<u8").reshape(-1, 2)
    step = raw[:, 1:] | np.uint64(1)
    return ((raw[:, :1] + np.arange(PROBES, dtype=np.uint64) * step) & np.uint64(bits - 1)).astype(np.int64)


def _fill(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Chunks (number, bytes) of a task's filter in which a bit is set."""
    out = np.zeros(bits, bool)
    for batch in batches:
        out[_places(batch.column(0).to_pylist(), bits).ravel()] = True
    packed = np.packbits(out, bitorder="little").reshape(-1, CHUNK_BYTES)
    used = np.flatnonzero(packed.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([packed[k].tobytes() for k in used], pa.binary())], names=["chunk", "bits"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk, whose rows come together."""
    last, merged = None, None
    for batch in batches:
        for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and k != last:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([merged.tobytes()], pa.binary())], names=["chunk", "bits"])
                merged = None
            last = k
            merged = np.frombuffer(x, np.uint8).copy() if merged is None else merged | np.frombuffer(x, np.uint8)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([merged.tobytes()], pa.binary())], names=["chunk", "bits"])


def build(digests: DataFrame, n: int) -> np.ndarray:
    """The filter of the binary column of ``digests``, about ``n`` rows: MOST_BITS at most, whatever n is."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(1, n * BITS_EACH - 1).bit_length()))
    chunks = digests.mapInArrow(lambda b: _fill(b, bits), "chunk long, bits binary")
    whole = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge, "chunk long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in whole.toLocalIterator():
        out[r.chunk * CHUNK_BYTES : (r.chunk + 1) * CHUNK_BYTES] = np.frombuffer(r.bits, np.uint8)
    return out


def may_hold(bits: np.ndarray, digests: list[bytes | None]) -> np.ndarray:
    """False only for digests that are not in the filter; null never is."""
    if not digests:
        return np.empty(0, bool)
    at = _places(digests, 8 * len(bits))
    hit = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)
    return hit & np.fromiter((d is not None for d in digests), bool, len(digests))


def with_hits(rows: DataFrame, column: str, bits) -> DataFrame:
    """Adds ``hit``: whether the filter (broadcast) may hold a row's digest; only the digests go to Python, nothing is shuffled."""

    @F.pandas_udf("boolean")
    def held(digests: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, digests.tolist()), dtype=bool)

    return rows.withColumn("hit", held(column))


def sent(digests: DataFrame, column: str, n: int):
    """The filter of a column, broadcast: 16 MB at most."""
    return digests.sparkSession.sparkContext.broadcast(build(digests.select(F.col(column)), n))
