"""Words of many texts at once, as arrays of 64-bit hashes.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``, which in UTF-8 is the same as a run of such characters.
A word's hash is a polynomial of its bytes, each replaced by a random 64-bit number, modulo 2^64; prefix
sums give it for all words of a buffer in a few array operations. Two different words of a corpus share a
hash with a probability of about (number of words)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text turned into arrays together; a longer text is a chunk of its own.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """Random numbers per byte; A-Z have those of a-z, which lower-cases for free."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)
    values[65:91] = values[97:123]
    return values


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the offset of every text in them (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of these texts in order, and the number of words before each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = word_bounds(raw, offsets)
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(byte_values()[raw] * up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a word ends with its text
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


FACTORS = mix64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def sequence_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text, and the number of runs before each text.

    A text of fewer words, but at least one, has its whole sequence as its only run.
    """
    sizes = np.diff(counts)
    runs = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    before = np.concatenate([[0], np.cumsum(runs)])
    if not before[-1]:
        return np.zeros(0, np.uint64), before
    at = np.arange(before[-1]) + np.repeat(counts[:-1] - before[:-1], runs)
    short = np.repeat(np.where(sizes < k, sizes, k), runs)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        there = short > j
        if there.all():
            out += hashes[at + j] * FACTORS[j]
        else:
            out[there] += hashes[at[there] + j] * FACTORS[j]
    return mix64(out + short.astype(np.uint64)), before


def distinct(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and their number before each text."""
    parts = [np.unique(values[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])
