"""The filter language: nested dictionaries compiled to a column, types checked before a job runs.

    {"column": "size", "op": "GT", "value": 4}
    {"and": [...]}, {"or": [...]}, nested at will

EQ is typed: a literal of another type than the column's matches nothing. The other
operators compare in the column's type and coerce the literal, or refuse it. A missing
value matches no operator, NEQ included. What is compiled are plain comparisons, so
Parquet's statistics and dictionaries see them.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = {"EQ": operator.eq, "NEQ": operator.ne, "GT": operator.gt, "GTE": operator.ge, "LT": operator.lt, "LTE": operator.le}
_INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
_FLOATS = (T.DoubleType, T.FloatType)


class FilterError(ValueError):
    """An expression that the columns can't answer."""


def kind_of(t: T.DataType) -> str:
    if isinstance(t, _INTEGERS):
        return "integer"
    if isinstance(t, _FLOATS):
        return "float"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    raise FilterError(f"columns of type {t.simpleString()} can't be filtered")


def literal_kind(value) -> str:
    for kind, python in (("boolean", bool), ("integer", int), ("float", float), ("string", str)):
        if isinstance(value, python):
            return kind
    raise FilterError(f"no literal: {value!r}")


def comparison(column: str, op: str, value, schema: T.StructType) -> Column:
    if op not in OPS:
        raise FilterError(f"unknown operator {op}")
    if column not in schema.names:
        raise FilterError(f"not a defined column: {column}")
    if value is None:
        raise FilterError(f"no value to compare {column} with")
    col, have, got = F.col(f"`{column}`"), kind_of(schema[column].dataType), literal_kind(value)
    if op == "EQ":
        return OPS[op](col, F.lit(value)) if have == got else F.lit(False)
    if have == got:
        return OPS[op](col, F.lit(value))
    if "boolean" in (have, got):
        raise FilterError(f"{column} is {have}, {value!r} is {got}")
    if have == "string":
        # numbers against texts: the rows are read as numbers, and one that isn't fails the query
        return OPS[op](col.cast("long" if got == "integer" else "double"), F.lit(value))
    if got == "string":
        try:
            return OPS[op](col, F.lit(int(value) if have == "integer" else float(value)))
        except ValueError:
            raise FilterError(f"{column} is {have}, {value!r} is no such number") from None
    return OPS[op](col.cast("double"), F.lit(float(value)))


def compile_filter(expression: dict, schema: T.StructType) -> Column:
    if not expression:
        raise FilterError("empty filter expression")
    if "and" in expression:
        if not expression["and"]:
            raise FilterError("empty conjunction")
        return reduce(operator.and_, [compile_filter(x, schema) for x in expression["and"]])
    if "or" in expression:
        return reduce(operator.or_, [compile_filter(x, schema) for x in expression["or"]], F.lit(False))
    try:
        return comparison(expression["column"], expression["op"], expression["value"], schema)
    except KeyError as missing:
        raise FilterError(f"no {missing} in {expression}") from None


def as_text(column: str, t: T.DataType) -> Column:
    """Values as the schemaless filter prints them: whole numbers without a point or exponent."""
    col = F.col(f"`{column}`")
    if kind_of(t) == "float":
        whole = (col == F.floor(col)) & (F.abs(col) < 9.0e18)
        return F.when(whole, col.cast("long").cast("string")).when(col.isNotNull() & ~whole, col.cast("string"))
    return col.cast("string")


def text_filter(wanted: dict[str, str], schema: T.StructType) -> Column:
    """Conjunction of equalities of printed values; an empty filter matches nothing."""
    if not wanted:
        return F.lit(False)
    if unknown := [c for c in wanted if c not in schema.names]:
        raise FilterError(f"not defined: {', '.join(unknown)}")
    return reduce(operator.and_, [as_text(c, schema[c].dataType) == F.lit(v) for c, v in wanted.items()])


def equal_all(wanted: dict, schema: T.StructType) -> Column:
    """Conjunction of equalities as deleting takes it: literals become the column's type where they can."""
    if not wanted:
        raise FilterError("empty condition")
    parts = []
    for c, v in wanted.items():
        if c not in schema.names:
            raise FilterError(f"not a defined column: {c}")
        have = kind_of(schema[c].dataType)
        if have == "integer" and isinstance(v, float) and v.is_integer():
            v = int(v)
        elif have == "float" and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        parts.append(comparison(c, "EQ", v, schema))
    return reduce(operator.and_, parts)
