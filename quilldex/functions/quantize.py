"""Rounding of numbers to narrow floating-point formats, as columns.

x is scaled by its exponent, rounded half to even with ``rint`` and scaled back; bit-exact
for normal, subnormal and overflowing values. Zero, infinities and NaN pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (bits of the mantissa, least exponent, smallest magnitude that rounds to infinity)
FORMATS = {
    "f16": (10, -14, 65520.0),
    "bf16": (7, -126, 3.3961775292304957e38),
    "f8": (2, -14, 61440.0),
}
CODECS = ("none", *FORMATS)
#: Bytes of an element as stored.
WIDTHS = {"none": 4, "f16": 2, "bf16": 2, "f8": 1}


def round_to(x: Column, kind: str) -> Column:
    if kind == "none":
        return x
    bits, low, high = FORMATS[kind]
    size = F.abs(x)
    # log2 may round up to the next integer just below a power of two; the power decides
    guess = F.floor(F.log2(size))
    e = F.greatest(guess - F.when(F.pow(F.lit(2.0), guess) > size, 1).otherwise(0), F.lit(low))
    step = F.pow(F.lit(2.0), e - bits)
    return (
        F.when(x.isNull() | F.isnan(x) | (x == 0) | (size == float("inf")), x)
        .when(size >= high, F.signum(x) * float("inf"))
        .otherwise(F.rint(x / step) * step)
    )


def quantize(v: Column, kind: str) -> Column:
    """A vector as a codec stores it: encoded and decoded again."""
    return v if kind == "none" else F.transform(v, lambda x: round_to(x, kind))


def round_value(x: float, kind: str) -> float:
    """round_to() of a number that the driver holds, such as a query's element."""
    import math

    if kind == "none" or x == 0 or math.isnan(x) or math.isinf(x):
        return x
    bits, low, high = FORMATS[kind]
    if abs(x) >= high:
        return math.copysign(math.inf, x)
    step = 2.0 ** (max(math.frexp(x)[1] - 1, low) - bits)
    return round(x / step) * step


def precision(x: Column, kind: str) -> Column:
    """exact, inexact, underflow or overflow: what storing x in the format costs."""
    stored = round_to(x, kind)
    _, low, high = FORMATS[kind]
    return (
        F.when(F.isnan(x) | (stored == x), "exact").when(F.abs(x) >= high, "overflow").when(F.abs(x) < 2.0**low, "underflow").otherwise("inexact")
    )


def pack(x: np.ndarray, kind: str) -> bytes:
    """The codes of a vector's elements, little-endian: rounded as round_to() does."""
    x = np.asarray(x, np.float64)
    bits, low, high = FORMATS[kind]
    with np.errstate(all="ignore"):
        step = 2.0 ** (np.maximum(np.frexp(x)[1] - 1, low) - bits)
        y = np.where(np.isfinite(x) & (x != 0), np.where(np.abs(x) >= high, np.copysign(np.inf, x), np.rint(x / step) * step), x)
        if kind == "bf16":
            return (y.astype("<f4").view("<u4") >> 16).astype("<u2").tobytes()
        half = y.astype("<f2")
    return half.tobytes() if kind == "f16" else (half.view("<u2") >> 8).astype(np.uint8).tobytes()


def unpack(codes: bytes, kind: str) -> np.ndarray:
    if kind == "bf16":
        return (np.frombuffer(codes, "<u2").astype("<u4") << 16).view("<f4")
    if kind == "f16":
        return np.frombuffer(codes, "<f2").astype(np.float32)
    return (np.frombuffer(codes, np.uint8).astype("<u2") << 8).view("<f2").astype(np.float32)


def encoded(rows: DataFrame, kind: str, vectors: list[str]) -> DataFrame:
    """``rows`` with the vectors as binary codes, in batches; a missing vector stays missing."""
    if kind == "none":
        return rows

    @F.pandas_udf("binary")
    def codes(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else pack(x, kind))

    return rows.withColumns({n: codes(F.col(f"`{n}`")) for n in vectors})


def decoded(rows: DataFrame, kind: str, vectors: list[str]) -> DataFrame:
    """The vectors of encoded() as numbers again."""
    if kind == "none":
        return rows

    @F.pandas_udf("array<float>")
    def numbers(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else unpack(x, kind))

    return rows.withColumns({n: numbers(F.col(f"`{n}`")) for n in vectors})
