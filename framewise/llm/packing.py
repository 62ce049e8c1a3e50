"""Hierarchical packing of tokenised documents into windows of several lengths.

Documents are tokenised once, in the task that reads them, and packed there from a buffer of bounded size, so
nothing is shuffled and the padding is bounded per buffer. The tiers are the powers of two up to the window
length.

1. Route: full windows are cut off a document; the rest goes to the smallest tier that holds it.
2. Pack: every tier is packed by best-fit decreasing, on counts of lengths.
3. Fill: gaps of windows, longest tier first, are filled from the pieces of shorter tiers, longest first; the
   last filler of a gap is cut, and what is left of it goes back to its own tier.
4. What is still open at the end of a buffer is merged into windows again; a short window is cut into exact
   powers of two, so that its padding is nothing.
5. Balance: windows are dealt to step groups of 64 by descending tier, so that groups of one optimiser step hold as many
   tokens of each tier. Windows of a buffer that fill no group, taken evenly over the tiers, go on to the next buffer of
   the task; only the last group of a task is smaller.

Defined results
    null text is the empty text; a document of no tokens is the end token alone; texts that hold the
    string of the tokenizer's special token give that token's id, as the tokenizer itself does;
    rows repeating a ``doc_id`` are packed each; an empty table gives no rows; further columns do not matter.
    Sequence ids depend on how the input is split into tasks, not on the attempt of a task.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from framewise.llm.shared import columns, ship

WINDOW = 2048
#: Tokens of a buffer; 16 MB at four bytes each.
BUFFER_TOKENS = 1 << 22
END = 1
STEP_WINDOWS = 64
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids binary"
)
#: The split of a text before merges, possessive where that cannot change the result.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SPECIAL = "<|endoftext|>"


class Tokens:
    """Ids of the byte-level vocabulary of a tokenizers file, through tiktoken's faster merges.

    The two agree id by id (tested); the special token, looked up in the file, is left to the tokenizer itself.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(vocabulary)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)


@lru_cache(maxsize=2)
def tokens(vocabulary: str) -> Tokens:
    return Tokens(vocabulary)


class _Pieces:
    """Pieces (document, start, length) by length, with the longest that fits found by bisection."""

    def __init__(self):
        self.stacks: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []

    def add(self, doc: int, start: int, length: int) -> None:
        if length not in self.stacks:
            self.stacks[length] = []
            bisect.insort(self.lengths, length)
        self.stacks[length].append((doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens."""
        at = bisect.bisect_right(self.lengths, most) - 1
        return self._pop(at) if at >= 0 else None

    def shortest(self) -> tuple[int, int, int] | None:
        return self._pop(0) if self.lengths else None

    def _pop(self, at: int) -> tuple[int, int, int]:
        length = self.lengths[at]
        doc, start = self.stacks[length].pop()
        if not self.stacks[length]:
            del self.stacks[length]
            self.lengths.pop(at)
        return doc, start, length


def plan(sizes: list[int], window: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, pieces) of every window for documents of these sizes; a piece is (document, start, length)."""
    tiers = [1 << k for k in range(window.bit_length())]
    shelves = {tier: _Pieces() for tier in tiers}
    out: list[tuple[int, list[tuple[int, int, int]]]] = []

    def route(doc: int, start: int, length: int) -> None:
        shelves[tiers[bisect.bisect_left(tiers, length)]].add(doc, start, length)

    for doc, size in enumerate(sizes):
        full = size // window
        out += [(window, [(doc, k * window, window)]) for k in range(full)]
        if size % window:
            route(doc, full * window, size % window)
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        while (first := shelves[tier].take(tier)) is not None:
            inside, gap = [first], tier - first[2]
            while gap:
                # Of this tier and the shorter ones in turn, the longest piece that fits.
                fill = next((p for t in range(k, -1, -1) if (p := shelves[tiers[t]].take(gap)) is not None), None)
                if fill is None:
                    # None fits: the shortest one of the longest shelf is cut.
                    fill = next((p for t in range(k, -1, -1) if (p := shelves[tiers[t]].shortest()) is not None), None)
                    if fill is None:
                        break
                    route(fill[0], fill[1] + gap, fill[2] - gap)
                    fill = (fill[0], fill[1], gap)
                inside.append(fill)
                gap -= fill[2]
            out += [(tier, inside)] if not gap else _powers(inside, tier - gap)
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces of a short window, cut into windows of exact powers of two."""
    out, queue = [], pieces[::-1]
    for k in range(total.bit_length() - 1, -1, -1):
        if not total >> k & 1:
            continue
        room, inside = 1 << k, []
        while room:
            doc, start, length = queue.pop()
            if length > room:
                queue.append((doc, start + room, length - room))
                length = room
            inside.append((doc, start, length))
            room -= length
        out.append((1 << k, inside))
    return out


def step_groups(tiers: list[int], size: int) -> list[int]:
    """The number of its group for every window, -1 for those left over: full groups that hold, of every tier, as many
    windows as each other, give or take one."""
    order = sorted(range(len(tiers)), key=lambda i: -tiers[i])
    groups, rest = divmod(len(tiers), size)
    # Evenly spaced over the tiers, so that what goes on has their mix too.
    left = {(2 * k + 1) * len(tiers) // (2 * rest) for k in range(rest)}
    out = [-1] * len(tiers)
    for n, i in enumerate(i for at, i in enumerate(order) if at not in left):
        out[i] = n % groups
    return out


def _pack_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int, buffer_tokens: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, task = tokens(vocabulary), TaskContext.get().partitionId()
    serial, group = 0, 0
    held: list[tuple[int | None, np.ndarray]] = []
    #: Windows that no group has yet: tier and rows without their group.
    waiting: list[tuple[int, list[tuple]]] = []
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def flush(last: bool = False) -> Iterator[pa.RecordBatch]:
        nonlocal serial, group
        for tier, pieces in plan([len(ids) for _, ids in held], window):
            offset, own = 0, []
            for doc, start, length in pieces:
                doc_id, ids = held[doc]
                part = ids[start : start + length].tobytes()
                own.append((doc_id, start, length, zlib.crc32(part), len(ids), task << 36 | serial, offset, tier, part if with_ids else None))
                offset += length
            waiting.append((tier, own))
            serial += 1
        held.clear()
        dealt = step_groups([tier for tier, _ in waiting], STEP_WINDOWS)
        full = max(dealt, default=-1) + 1
        rows = [(*row[:8], task << 36 | group + (full if g < 0 else g), row[8]) for g, (_, own) in zip(dealt, waiting, strict=True) if g >= 0 or last for row in own]
        waiting[:] = [] if last else [w for g, w in zip(dealt, waiting, strict=True) if g < 0]
        group += full
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 4096], strict=True), kinds, strict=True)], names=names)

    count = 0
    end = np.array([END], np.uint32)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.concatenate([encode(text.as_py()), end])
            held.append((doc_id, ids))
            count += len(ids)
            if count >= buffer_tokens:
                yield from flush()
                count = 0
    if held or waiting:
        yield from flush(last=True)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, buffer_tokens: int = BUFFER_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document (doc_id, text): where it lies in which window, and its ids as
    little-endian 32-bit values (null unless ``with_ids``). ``window`` is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack_batches(batches, vocabulary, window, buffer_tokens, with_ids)

    ship(docs.sparkSession)
    return columns(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)
