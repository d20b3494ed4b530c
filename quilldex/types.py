"""Collections and their columns."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

#: Declared types of metadata columns.
COLUMN_TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "vector": T.ArrayType(T.FloatType())}
DISTANCES = ("cosine", "euclidean")
QUANTIZATIONS = ("none", "f16", "bf16", "f8")
# Fixed defaults of the graph index
GRAPH_DEFAULTS = {"m": 16, "ef_construction": 200, "ef": 20, "search_algorithm": "heuristic"}


class CollectionError(Exception):
    """A request that the catalog refuses."""


@dataclass(frozen=True)
class IndexSpec:
    """A declared column. A missing value is an error unless ``enable_null``; the primary key must be a string."""

    name: str
    type: str
    primary_key: bool = False
    enable_null: bool = False

    def __post_init__(self):
        if self.type not in COLUMN_TYPES:
            raise CollectionError(f"unknown column type {self.type}")
        if self.primary_key and self.type != "string":
            raise CollectionError(f"primary key {self.name} must be a string")


@dataclass(frozen=True)
class CollectionSpec:
    """A collection: declared columns, and one vector of a fixed dimension or several named ones."""

    name: str
    dim: int
    columns: tuple[IndexSpec, ...] = ()
    distance: str = "cosine"
    quantization: str = "none"
    versioning: bool = False
    vectors: dict[str, int] = field(default_factory=dict)
    graph: dict = field(default_factory=lambda: dict(GRAPH_DEFAULTS))

    def __post_init__(self):
        if self.distance not in DISTANCES:
            raise CollectionError(f"unknown distance {self.distance}")
        if self.quantization not in QUANTIZATIONS:
            raise CollectionError(f"unknown quantization {self.quantization}")
        if sum(c.primary_key for c in self.columns) > 1:
            raise CollectionError("more than one primary key")

    @property
    def key(self) -> str | None:
        return next((c.name for c in self.columns if c.primary_key), None)

    def vector_columns(self) -> dict[str, int]:
        return self.vectors or {"vector": self.dim}

    def schema(self) -> T.StructType:
        named = [T.StructField(n, T.ArrayType(T.FloatType(), False)) for n in self.vector_columns()]
        return T.StructType([*[T.StructField(c.name, COLUMN_TYPES[c.type]) for c in self.columns if c.type != "vector"], *named])

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> CollectionSpec:
        d = json.loads(text)
        return CollectionSpec(**d | {"columns": tuple(IndexSpec(**c) for c in d["columns"])})
