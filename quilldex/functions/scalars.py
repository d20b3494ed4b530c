"""Scalar functions: identifiers in several alphabets, shards, types, generated numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets of textual identifiers, the epoch of time-ordered ones (ms), their fields' bits
BASE32 = "ybndrfg8ejkmcpqxot1uwisza345h769"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
EPOCH_MS = 1288834974657
NODE_BITS, STEP_BITS = 10, 12

# 64-bit FNV-1a; symbols of short identifiers and their epoch (ms)
FNV_START, FNV_PRIME_LOW, FNV_PRIME_SHIFT = 0xCBF29CE484222325, 0x1B3, 40
SHORT_SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_"
SHORT_EPOCH_MS = 1451606400000

SHARDS = 16


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's UTF-8, as a signed number; in halves of 32 bits, so that nothing overflows."""
    raw = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text).cast("int")), lambda k: F.conv(F.substring(raw, 2 * k - 1, F.lit(2)), 16, 10).cast("long"))
    octets = F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<long>"))
    low32 = (1 << 32) - 1

    def step(h, b):
        lo = h["lo"].bitwiseXOR(b)
        product = lo * FNV_PRIME_LOW
        hi = h["hi"] * FNV_PRIME_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(lo, FNV_PRIME_SHIFT - 32)
        return F.struct(hi.bitwiseAND(low32).alias("hi"), product.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(FNV_START >> 32).cast("long").alias("hi"), F.lit(FNV_START & low32).cast("long").alias("lo"))
    whole = lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])
    return F.when(text.isNotNull(), F.aggregate(octets, start, step, whole))


def fnv_shard(text: Column, shards: int = SHARDS) -> Column:
    """The shard of a key by its FNV-1a hash, read without a sign."""
    h = fnv1a(text)
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(shards)) * 2 + h.bitwiseAND(1), F.lit(shards)).cast("int")


def short_id(time_ms: Column, worker: Column, count: Column, seed: int = 1) -> Column:
    """Eight symbols for the time, one for the worker (0 to 31), and two more for a count above 0.

    Symbols carry five bits; their sixth is a hash of the whole, so that neighbours look different.
    """
    ms = time_ms - SHORT_EPOCH_MS
    salt = F.xxhash64(F.lit(seed), ms, worker, count)
    five = [F.shiftright(ms, 5 * k).bitwiseAND(31) for k in range(7, -1, -1)] + [worker.cast("long").bitwiseAND(31)]
    letters = F.array(*[F.lit(c) for c in SHORT_SYMBOLS])
    symbol = lambda k, x: F.get(letters, (x + 32 * F.shiftright(salt, k).bitwiseAND(1)).cast("int"))
    head = F.concat(*[symbol(k, x) for k, x in enumerate(five)])
    tail = F.concat(symbol(9, F.shiftright(count.cast("long"), 5).bitwiseAND(31)), symbol(10, count.cast("long").bitwiseAND(31)))
    return F.when(count > 0, F.concat(head, tail)).otherwise(head)


def short_id_parts(text: Column) -> tuple[Column, Column, Column]:
    """(time in ms, worker, count) of a short identifier."""
    digit = lambda k: F.pmod(F.position(F.substring(text, k, F.lit(1)), F.lit(SHORT_SYMBOLS)) - 1, F.lit(32)).cast("long")
    ms = sum((F.shiftleft(digit(F.lit(k + 1)), 5 * (7 - k)) for k in range(8)), F.lit(0).cast("long"))
    return ms + SHORT_EPOCH_MS, digit(F.lit(9)), F.when(F.length(text) > 9, digit(F.lit(10)) * 32 + digit(F.lit(11))).otherwise(0)


def to_bytes(c: Column) -> Column:
    """The eight bytes of a number, highest first."""
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def from_bytes(b: Column) -> Column:
    """The number (from 0 on) that to_bytes() has written."""
    return F.conv(F.hex(b), 16, 10).cast("long")


def distinct_ints(n: int, k: int, seed: int) -> Column:
    """k different whole numbers from 0 to n - 1."""
    return F.slice(F.shuffle(F.sequence(F.lit(0), F.lit(n - 1)), seed), 1, k)


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    """The partition that a key is dealt to."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def murmur3(*columns: Column) -> Column:
    """Spark's 32-bit Murmur3."""
    return F.hash(*columns)


def id_time_ms(c: Column) -> Column:
    return F.shiftright(c, NODE_BITS + STEP_BITS) + EPOCH_MS


def id_node(c: Column) -> Column:
    return F.shiftright(c, STEP_BITS).bitwiseAND((1 << NODE_BITS) - 1)


def id_step(c: Column) -> Column:
    return c.bitwiseAND((1 << STEP_BITS) - 1)


def make_id(time_ms: Column, node: Column, step: Column) -> Column:
    return F.shiftleft(time_ms - EPOCH_MS, NODE_BITS + STEP_BITS) + F.shiftleft(node, STEP_BITS) + step


def to_base(c: Column, alphabet: str) -> Column:
    """A number from 0 on as text over an alphabet, most significant digit first."""
    base = len(alphabet)
    digits = next(n for n in range(1, 65) if base**n >= 1 << 63)
    powers = [base**k for k in range(digits) if base**k < 1 << 63][::-1]
    letters = F.array(*[F.lit(x) for x in alphabet])
    text = F.concat(*[F.get(letters, _digit(c, p, base).cast("int")) for p in powers])
    return F.when(c == 0, F.lit(alphabet[0])).otherwise(F.regexp_replace(text, f"^{alphabet[0]}+", ""))


def _digit(c: Column, power: int, base: int) -> Column:
    # whole-number division: doubles would lose digits of 63-bit identifiers
    return F.pmod(F.call_function("div", c, F.lit(power).cast("long")), F.lit(base).cast("long"))


def from_base(c: Column, alphabet: str) -> Column:
    """The number that to_base() has written."""
    digits = F.transform(F.split(c, ""), lambda x: F.position(x, F.lit(alphabet)) - 1)
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * len(alphabet) + d)


def default_of(kind: str):
    """The value that stands for a missing one of a declared type."""
    return {"string": "", "integer": 0, "float": 0.0, "boolean": False}[kind]


def exponential(seed: int, scale: float = 1.0) -> Column:
    return -F.log(1 - F.rand(seed)) * scale


def random_vector(dim: int, seed: int, normal: bool = False) -> Column:
    return F.array(*[(F.randn if normal else F.rand)(seed * 1_000_003 + k) for k in range(dim)])


def byte_size(vector: Column, bytes_per_element: int = 4) -> Column:
    """Bytes of a row's vector as stored, its number included."""
    return F.lit(8) + F.size(vector) * bytes_per_element
