"""Writing: keyed upserts, deletes, and the validation of rows before they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from quilldex.functions import vectors as V
from quilldex.functions.scalars import default_of
from quilldex.plans.filters import equal_all
from quilldex.types import COLUMN_TYPES, CollectionSpec


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Of the changes of a key the last one; of several with the same ``seq`` always the same one.

    One aggregation with partial results on the map side: a hot key's changes meet as one row a task.
    """
    order = F.struct(F.col(seq), F.xxhash64(*[F.col(f"`{c}`") for c in changes.columns]))
    return changes.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")


def upsert(rows: DataFrame, changes: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Rows with changes applied: new keys are inserted, known ones replaced, the last change of a key wins.

    The last is that with the highest ``seq``, or without one the last in the order of ``changes``.
    """
    order = "_at" if seq is None else seq
    changes = latest(changes.withColumn("_at", F.monotonically_increasing_id()) if seq is None else changes, key, order).drop(order)
    kept = rows.join(changes.select(key), key, "left_anti").select(rows.columns)
    return kept.unionByName(changes, allowMissingColumns=True)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows without those keys; unknown keys change nothing."""
    return rows.join(keys.select(key), key, "left_anti").select(rows.columns)


def delete_where(rows: DataFrame, wanted: dict) -> DataFrame:
    """Rows but those that equal all of ``wanted``; a missing value equals nothing, so its row stays."""
    return rows.filter(~F.coalesce(equal_all(wanted, rows.schema), F.lit(False)))


def problems(spec: CollectionSpec) -> Column:
    """Names of what is wrong with a row of declared columns: an array, empty for a good row.

    Whole numbers are integers even when they come as doubles; missing values are wrong
    unless the column allows them; vectors must have the collection's dimension.
    """
    found = []
    for c in spec.columns:
        if c.type == "vector":
            continue
        col = F.col(f"`{c.name}`")
        if not c.enable_null or c.primary_key:
            found.append(F.when(col.isNull(), F.lit(f"{c.name}: missing")))
    for name, dim in spec.vector_columns().items():
        v = F.col(f"`{name}`")
        found.append(F.when(v.isNull() | (F.size(v) != dim), F.lit(f"{name}: dimension is not {dim}")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def metadata_bytes(columns: list[str], schema: T.StructType) -> Column:
    """Bytes of a row's metadata: each column's name and its value, text by its length, truth values 1, numbers 8, none 0."""
    total = F.lit(0).cast("long")
    for name in columns:
        col, kind = F.col(f"`{name}`"), schema[name].dataType
        size = F.octet_length(col) if isinstance(kind, T.StringType) else F.lit(1 if isinstance(kind, T.BooleanType) else 8)
        total = total + len(name.encode()) + F.when(col.isNull(), 0).otherwise(size)
    return total


def with_defaults(rows: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Missing values of declared columns replaced by their type's default."""
    return rows.withColumns({c.name: F.coalesce(F.col(f"`{c.name}`"), F.lit(default_of(c.type)).cast(COLUMN_TYPES[c.type])) for c in spec.columns if c.type != "vector"})


def typed_from_text(raw: Column, kind: str) -> tuple[Column, Column]:
    """(value, whether the text is one of that type) of a JSON scalar's text."""
    if kind == "string":
        return raw, raw.isNotNull()
    if kind == "boolean":
        return F.when(raw.isin("true", "false"), raw == "true"), raw.isin("true", "false")
    number = raw.try_cast("double")
    if kind == "integer":
        whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 9.0e18)
        return F.when(whole, number.cast("long")), whole
    return number, number.isNotNull()


def coerce(rows: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Columns in their declared types; a value that isn't of its type fails the write."""
    out = {}
    for c in spec.columns:
        if c.type == "vector" or c.name not in rows.columns:
            continue
        col, target = F.col(f"`{c.name}`"), COLUMN_TYPES[c.type]
        if rows.schema[c.name].dataType == target:
            continue
        if c.type == "integer":
            bad = col.isNotNull() & (col.cast("double") != F.floor(col.cast("double")))
            out[c.name] = F.when(bad, F.raise_error(F.lit(f"{c.name} is not a whole number")).cast("long")).otherwise(col.cast("long"))
        else:
            out[c.name] = col.cast(target)
    return rows.withColumns(out) if out else rows


def checked(rows: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Rows as they may be written, vectors of cosine collections at length 1; a bad row fails the job."""
    missing = [c.name for c in spec.columns if c.type != "vector" and c.name not in rows.columns]
    rows = coerce(rows.withColumns({m: F.lit(None).cast(COLUMN_TYPES[next(c.type for c in spec.columns if c.name == m)]) for m in missing}), spec)
    wrong = problems(spec)
    rows = rows.filter(F.when(F.size(wrong) > 0, F.raise_error(F.array_join(wrong, "; ")).cast("boolean")).otherwise(F.lit(True)))
    if spec.distance == "cosine":
        rows = rows.withColumns({n: V.normalize(V.as_vector(f"`{n}`")).cast("array<float>") for n in spec.vector_columns()})
    return rows
