"""Minimal perfect hashing of distinct 64-bit keys, in buckets that Spark deals out.

A bucket's function is a list of bit arrays. A key takes the first array in which its place is held by it alone; its value
is the number of set bits before that place, over all arrays so far. About 3.5 bits a key, no keys; a key that was not among
those it was made for gets -1 or the value of another, which is why values are verified against the keys.
"""

from __future__ import annotations

import numpy as np

from framewise.llm.textarrays import BASE, mix64

#: Places per key that is left, in every array.
ROOM = 1.5


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64) ^ BASE) % np.uint64(buckets)).astype(np.int64)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys ^ mix64(np.uint64(level + 1) * BASE)) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> list[bytes]:
    """The bit arrays of a function over these distinct keys."""
    left, levels = keys.astype(np.uint64), []
    with np.errstate(over="ignore"):
        while len(left):
            size = 8 * -(-int(len(left) * ROOM + 1) // 8)
            places = _places(left, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(np.packbits(alone).tobytes())
            left = left[~alone[places]]
    return levels


def index(keys: np.ndarray, levels: list[bytes]) -> np.ndarray:
    """The value of every key, -1 where no array knows it."""
    keys = keys.astype(np.uint64)
    out, open_, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    with np.errstate(over="ignore"):
        for level, packed in enumerate(levels):
            bits = np.unpackbits(np.frombuffer(packed, np.uint8))
            places = _places(keys[open_], level, len(bits))
            hit = bits[places] == 1
            rank = np.cumsum(bits, dtype=np.int64)
            out[open_[hit]] = before + rank[places[hit]] - 1
            before += int(rank[-1])
            open_ = open_[~hit]
    return out
