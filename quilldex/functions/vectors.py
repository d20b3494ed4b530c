"""Distances, scores and arithmetic of vectors as columns.

A vector is ``array<double>``; single precision is widened before anything is summed.
Functions of two vector columns use higher-order functions and fit any dimension. With
one vector known (a query), the sum is written out term by term, so that it runs inside
generated code without boxing an element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Longer vectors would make methods that the JVM refuses to compile.
WRITTEN_OUT = 256


def as_vector(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def element(a: Column, k: int) -> Column:
    """One element in double precision; no copy of the array is made for it."""
    return F.get(a, F.lit(k)).cast("double")


def _terms(terms: list[Column]) -> Column:
    """A balanced tree of additions: depth grows with the logarithm of the dimension."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def _paired(a: Column, b: Column | Sequence[float], f: Callable[[Column, Column], Column]) -> Column:
    if isinstance(b, Column):
        return total(F.zip_with(a, b, f))
    if len(b) > WRITTEN_OUT:
        return total(F.zip_with(as_vector(a), F.array(*[F.lit(float(x)) for x in b]), f))
    return _terms([f(element(a, k), F.lit(float(x))) for k, x in enumerate(b)])


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def length(a: Column, dim: int | None = None) -> Column:
    """Euclidean length; with the dimension known, written out."""
    if dim is None or dim > WRITTEN_OUT:
        return F.sqrt(total(F.transform(as_vector(a), lambda x: x * x)))
    return F.sqrt(_terms([element(a, k) * element(a, k) for k in range(dim)]))


def squared_l2(a: Column, b: Column | Sequence[float]) -> Column:
    return _paired(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column | Sequence[float]) -> Column:
    return F.sqrt(squared_l2(a, b))


def manhattan(a: Column, b: Column | Sequence[float]) -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y))


def negative_dot(a: Column, b: Column | Sequence[float]) -> Column:
    return -dot(a, b)


def one_minus_dot(a: Column, b: Column | Sequence[float]) -> Column:
    return 1 - dot(a, b)


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """abs(1 - cosine), from 0 to 2; null where a vector is zero."""
    if isinstance(b, Column):
        norm = length(a) * length(b)
    else:
        norm = length(a, len(b)) * F.lit(sum(float(x) * float(x) for x in b) ** 0.5)
    return F.abs(1 - F.try_divide(dot(a, b), norm))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places in degrees on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda acc, x: acc + x)


def jaccard(a: Column, b: Column) -> Column:
    """1 - shared bits / set bits of two arrays of 64-bit words; 0 where no bit is set."""
    count = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda acc, x: acc + x)
    both, either = count(lambda x, y: F.bit_count(x.bitwiseAND(y))), count(lambda x, y: F.bit_count(x.bitwiseOR(y)))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - F.try_divide(both.cast("double"), either.cast("double")))


def normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = length(v)
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def score(distance: Column, metric: str) -> Column:
    """0 to 100: (2 - d) / 2 * 100 for cosine, 100 - d but not below 0 for Euclidean."""
    if metric == "cosine":
        return (2 - distance) / 2 * 100
    return F.greatest(F.lit(0.0), 100 - distance)


def compare(a: Column, b: Column | Sequence[float], metric: str) -> Column:
    """The score of two vectors under a metric."""
    return score(METRICS[metric](a, b), metric)


#: Metrics that a search can rank by, ascending.
METRICS: dict[str, Callable[[Column, Column | Sequence[float]], Column]] = {
    "cosine": cosine, "euclidean": euclidean, "squared_l2": squared_l2, "manhattan": manhattan, "dot": negative_dot, "one_minus_dot": one_minus_dot,
}


def metric_by_name(name: str) -> Callable[[Column, Column | Sequence[float]], Column]:
    """Unknown names mean Euclidean."""
    return METRICS.get(name, euclidean)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.zip_with(a, b, F.try_divide)


def add_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x + s)


def subtract_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x - s)


def multiply_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x * s)


def divide_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: F.try_divide(x, F.lit(float(s))))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def sorted_vector(v: Column) -> Column:
    return F.array_sort(v)


def sign_bits(v: Column, dim: int) -> Column:
    """Binary quantization: words of up to 62 bits, one bit for each element above 0."""
    words = []
    for low in range(0, dim, 62):
        bits = [F.when(element(v, k) > 0, F.lit(1 << (k - low)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(low, min(dim, low + 62))]
        words.append(_terms(bits))
    return F.array(*words)


def weighted(parts: Sequence[tuple[Column, float]]) -> Column:
    """Sum of scores times ratio / 100."""
    return reduce(lambda a, b: a + b, [s * F.lit(r / 100.0) for s, r in parts])
