"""A key-value log: rows (key, value, seq, expire, deleted), of which the last of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compact(log: DataFrame, now: int | None = None) -> DataFrame:
    """(key, value, seq, expire) of live keys: the last record of each, unless it deletes or has expired.

    One aggregation by key with partial results on the map side; of records with the same seq
    always the same one counts.
    """
    order = F.struct("seq", F.xxhash64("value", "expire", "deleted"))
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "expire", "deleted"), order).alias("r"), F.max("seq").alias("seq"))
    live = ~F.coalesce(F.col("r.deleted"), F.lit(False))
    if now is not None:
        live = live & ((F.coalesce(F.col("r.expire"), F.lit(0)) == 0) | (F.col("r.expire") > now))
    return last.filter(live).select("key", "r.value", "seq", "r.expire")


def batch(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with a batch of changes at its end; the batch's order is its own seq."""
    return log.unionByName(changes)


class Batch:
    """Changes that count all or not at all: read-your-writes until commit() gives the log with them, or rollback()."""

    def __init__(self, log: DataFrame):
        self._log, self._live = log, compact(log)
        self._last = log.agg(F.max("seq")).first()[0] or 0
        self._pending: dict = {}

    def put(self, key, value, expire: int = 0) -> None:
        self._pending[key] = (value, expire, False)

    def delete(self, key) -> None:
        self._pending[key] = (None, 0, True)

    def get(self, key):
        if key in self._pending:
            return self._pending[key][0]
        row = get(self._live, key).first()
        return None if row is None else row["value"]

    def exists(self, key) -> bool:
        return not self._pending[key][2] if key in self._pending else exists(self._live, key)

    def rollback(self) -> None:
        self._pending.clear()

    def commit(self) -> DataFrame:
        rows = [(key, value, self._last + 1 + n, expire, deleted) for n, (key, (value, expire, deleted)) in enumerate(self._pending.items())]
        self._pending = {}
        columns = self._log.select("key", "value", "seq", "expire", "deleted")
        return columns if not rows else columns.unionByName(self._log.sparkSession.createDataFrame(rows, columns.schema))


def get(live: DataFrame, key) -> DataFrame:
    return live.filter(F.col("key") == key)


def exists(live: DataFrame, key) -> bool:
    return not get(live, key).isEmpty()


def ascend(live: DataFrame) -> DataFrame:
    return live.orderBy("key")


def ascend_range(live: DataFrame, low, high) -> DataFrame:
    """Keys from low to high, both included."""
    return live.filter(F.col("key").between(low, high)).orderBy("key")


def ascend_from(live: DataFrame, low) -> DataFrame:
    return live.filter(F.col("key") >= low).orderBy("key")


def ascend_matching(live: DataFrame, pattern: str) -> DataFrame:
    """Keys in which a regular expression is found."""
    return live.filter(F.col("key").rlike(pattern)).orderBy("key")


def descend(live: DataFrame) -> DataFrame:
    return live.orderBy(F.desc("key"))


def descend_range(live: DataFrame, high, low) -> DataFrame:
    return live.filter(F.col("key").between(low, high)).orderBy(F.desc("key"))


def descend_to(live: DataFrame, high) -> DataFrame:
    return live.filter(F.col("key") <= high).orderBy(F.desc("key"))


def descend_matching(live: DataFrame, pattern: str) -> DataFrame:
    return live.filter(F.col("key").rlike(pattern)).orderBy(F.desc("key"))


def statistics(log: DataFrame) -> DataFrame:
    """Records, keys, deletions and bytes of values of a log."""
    return log.agg(
        F.count("*").alias("records"), F.count_distinct("key").alias("n_keys"),
        F.count_if(F.coalesce("deleted", F.lit(False))).alias("deletions"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("value_bytes"),
    )
