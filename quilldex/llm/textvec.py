"""Hashes of words for whole batches of texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Word separators as in ``[^\x20\x09-\x0D]+``; and all ASCII but letters and digits.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = True
_PLACES = [np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_folded = np.arange(256, dtype=np.uint64)
_folded[ord("A") : ord("Z") + 1] += 32
_BYTES = mix((_folded + np.uint64(1)) * _MIX)


def _places(n: int) -> np.ndarray:
    """Odd factors of the places in a word."""
    if len(_PLACES[0]) < n:
        _PLACES[0] = mix((np.arange(max(1024, n), dtype=np.uint64) + np.uint64(1)) * _MIX) | np.uint64(1)
    return _PLACES[0]


def word_hashes(texts: list[bytes], separators: np.ndarray = BLANKS, prefix: int = 0):
    """(hash of each word with A-Z folded, number of words per text, hash of each word's prefix or None).

    The hash is a sum over bytes, each byte's random number times its place's, so one pass
    over the bytes serves all words.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~separators[data]
    ends_of_text = np.cumsum(sizes + 1)
    inside[ends_of_text - 1] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64), np.empty(0, np.uint64) if prefix else None
    lengths = ends - starts
    counts = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    parts = _BYTES[data[inside]] * _places(int(lengths.max()))[place]
    whole = mix(np.add.reduceat(parts, first) + lengths.astype(np.uint64))
    if not prefix:
        return whole, counts, None
    parts[place >= prefix] = 0
    return whole, counts, mix(np.add.reduceat(parts, first) ^ np.uint64(0x5851F42D4C957F2D))


def texts_of(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    return [b"" if x is None else x.encode() for x in column.to_pylist()]
