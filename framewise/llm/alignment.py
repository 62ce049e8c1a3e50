"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in the corpus.

Tokens of A and B that end at the same byte of a text are linked, and cut the text into groups. Corpus counts of linked id
pairs are kept without a dictionary: a minimal perfect hash numbers the distinct pairs, and counts are dense vectors.

1. First pass: chunks of about 4 MB of text are tokenised by both, once, and written as ids with the chunk's own pairs.
2. The distinct pairs are dealt to buckets by hash; each gets a minimal perfect hash and its pairs in that order.
3. Every chunk's counts become dense vectors of a bucket: one for each lane of up to 1,024 chunks, then summed in a tree,
   16 lanes at a time.
4. Second pass: chunks ask the buckets for their pairs, which are verified against the bucket's own, then align their
   documents again from the ids and read off the counts.

A chunk asks for each of its pairs once however often it holds it, and a bucket meets at most a lane of chunks at a time.
The highest count of each B id is a vector as long as that vocabulary, the only thing that goes to all tasks.

Defined results
    null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and an empty
    ``groups_sha256``; strings of special tokens are plain text; repeated rows count as often as they stand; a document of
    any length lies in one chunk; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import perfect_hash
from framewise.llm.packing import SPLIT
from framewise.llm.shared import Scratch, columns

#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 22
#: Pairs of a bucket.
BUCKET_PAIRS = 4096
#: Chunks of a lane, and lanes summed together.
LANE_CHUNKS = 1024
FAN_IN = 16
PIECE_SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """Both tokenizers, and for every id of each its bytes and their number."""

    def __init__(self, byte_level: str, pieces: str):
        import json

        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as file:
            held = json.load(file)
        letters, special = _byte_letters(), {t["id"] for t in held["added_tokens"]}
        ranks = {bytes(letters[c] for c in entry): n for entry, n in held["model"]["vocab"].items() if n not in special}
        self.a = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        bytes_a = [b""] * (max(ranks.values()) + 1)
        for entry, n in ranks.items():
            bytes_a[n] = entry
        bytes_b = [self._piece(n) for n in range(self.b.vocab_size())]
        self.tables = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        self.lengths = [np.array([len(x) for x in part], np.int64) for part in (bytes_a, bytes_b)]
        decimal = [[str(n).encode() for n in range(len(part))] for part in (bytes_a, bytes_b)]
        # Ids as decimals with what follows them: inside a group, and at the end of their side of it.
        self.spelled = pa.array([x + end for part, ends in zip(decimal, (b",|", b",;"), strict=True) for end in (ends[:1], ends[1:]) for x in part], pa.large_binary())

    def _piece(self, n: int) -> bytes:
        piece = self.b.id_to_piece(n)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(n) else piece.replace(PIECE_SPACE, " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both, nothing where one does not give the text back."""
        nothing = np.zeros(0, np.uint32)
        if not text:
            return nothing, nothing
        spaced = f" {text}"
        ids = np.frombuffer(self.a._core_bpe.encode_to_tiktoken_buffer(spaced, set()), np.uint32), np.array(self.b.encode(text), np.uint32)
        raw = spaced.encode()
        for part, table, lengths in zip(ids, self.tables, self.lengths, strict=True):
            if int(lengths[part].sum()) != len(raw) or table.take(pa.array(part)).buffers()[2].to_pybytes()[: len(raw)] != raw:
                return nothing, nothing
        return ids

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the linked tokens of both, where texts follow each other."""
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        if not len(ends_a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(ends_a, ends_b)
        linked = ends_a[np.minimum(at, len(ends_a) - 1)] == ends_b
        return at[linked], np.flatnonzero(linked)

    def spell(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """All groups as text, and where each group ends in it."""
        sizes = [len(x) for x in self.lengths]
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[in_a] = last_b[in_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], in_b + 1])[group_a]] = a.astype(np.int64) + last_a * sizes[0]
        codes[np.arange(len(b)) + (in_a + 1)[group_b]] = 2 * sizes[0] + b.astype(np.int64) + last_b * sizes[1]
        text = self.spelled.take(pa.array(codes))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(codes) + 1]
        return memoryview(text.buffers()[2]), offsets[in_a + in_b + 2]


@lru_cache(maxsize=2)
def _pair(byte_level: str, pieces: str) -> Pair:
    return Pair(SparkFiles.get(byte_level), SparkFiles.get(pieces))


def _sent(spark: SparkSession, *paths: str) -> tuple[str, ...]:
    """Gives these files of the driver to all workers; their names there."""
    for path in paths:
        spark.sparkContext.addFile(path)
    return tuple(os.path.basename(path) for path in paths)


def _zip(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * size, codec="zstd", asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


CHUNK = {
    "chunk": pa.int64(), "docs": pa.list_(pa.int64()), "sizes_a": pa.list_(pa.int64()), "sizes_b": pa.list_(pa.int64()), "a": pa.binary(), "b": pa.binary(),
    "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()),
}
CHUNK_SCHEMA = "chunk long, docs array<long>, sizes_a array<long>, sizes_b array<long>, a binary, b binary, pairs array<long>, counts array<long>"


def _links(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    return a[in_a].astype(np.int64) << 32 | b[in_b].astype(np.int64)


def chunks(docs: DataFrame, files: tuple[str, str], size: int) -> DataFrame:
    """(doc_id, text) -> one row per chunk: its documents, their ids by both tokenizers, and its distinct links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task, serial = _pair(*files), TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal serial
            a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            pairs, counts = np.unique(_links(a, b, *pair.align(a, b)), return_counts=True)
            row = (task << 32 | serial, ids, [len(p[0]) for p in parts], [len(p[1]) for p in parts], _zip(a), _zip(b), pairs, counts)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, CHUNK.values(), strict=True)], names=list(CHUNK))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id)
                parts.append(pair.encode(text))
                held += len(text or "") + 16
                if held >= size:
                    yield flush()
                    serial, ids, parts, held = serial + 1, [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, CHUNK_SCHEMA)


ASKED = "bucket long, lane long, chunk long, pairs array<long>, counts array<long>"


def requests(kept: DataFrame, buckets: int, lanes: int) -> DataFrame:
    """Per chunk and bucket that holds any of its links, these links and how often the chunk has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = batch.column(0)[row].as_py()
                pairs, counts = (batch.column(c)[row].values.to_numpy() for c in (1, 2))
                if not len(pairs):
                    continue
                bucket = perfect_hash.bucket_of(pairs, buckets)
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                offsets = pa.array(np.append(first, len(pairs)), pa.int32())
                lane = int(perfect_hash.bucket_of(np.array([chunk]), lanes)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), lane)), pa.array(np.full(len(found), chunk)),
                     *(pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (pairs, counts))],
                    names=["bucket", "lane", "chunk", "pairs", "counts"],
                )

    return kept.select("chunk", "pairs", "counts").mapInArrow(run, ASKED)


def functions(pairs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, levels, keys): the minimal perfect hash of every bucket of distinct pairs, and these in its order."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = perfect_hash.bucket_of(batch.column(0).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0)], names=["bucket", "pair"])

    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = table["pair"].to_numpy()
        levels = perfect_hash.build(keys)
        ordered = np.empty_like(keys)
        ordered[perfect_hash.index(keys, levels)] = keys
        return pa.table({"bucket": pa.array([key[0].as_py()]), "levels": pa.array([levels], pa.list_(pa.binary())), "keys": pa.array([ordered], pa.list_(pa.int64()))})

    marked = pairs.mapInArrow(mark, "bucket long, pair long")
    return marked.groupBy("bucket").applyInArrow(make, "bucket long, levels array<binary>, keys array<long>")


def _arrays(table: pa.Table, column: str) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in table[column]]


def _per_lane(table: DataFrame, lanes: int) -> DataFrame:
    return table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))


def _verified(pairs: np.ndarray, levels: list[bytes], keys: np.ndarray) -> np.ndarray:
    at = perfect_hash.index(pairs, levels)
    if not np.array_equal(keys[at], pairs):
        raise ValueError("a pair is not among those that were numbered")
    return at


def count_vectors(asked: DataFrame, hashed: DataFrame, scratch: Scratch, lanes: int) -> DataFrame:
    """(bucket, counts): how often every pair of a bucket is linked in the corpus, in the order of its hash."""

    def leaf(left: pa.Table, right: pa.Table) -> pa.Table:
        levels, keys = right["levels"][0].as_py(), _arrays(right, "keys")[0]
        counts = np.zeros(len(keys), np.int64)
        if len(left):
            pairs, more = (np.concatenate(_arrays(left, c)) for c in ("pairs", "counts"))
            np.add.at(counts, _verified(pairs, levels, keys), more)
        return pa.table({"bucket": right["bucket"], "lane": right["lane"], "counts": pa.array([counts], pa.list_(pa.int64()))})

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.sum(_arrays(table, "counts"), axis=0)
        return pa.table({"bucket": pa.array([key[0].as_py()]), "lane": pa.array([key[1].as_py()]), "counts": pa.array([total], pa.list_(pa.int64()))})

    kind = "bucket long, lane long, counts array<long>"
    both = _per_lane(hashed, lanes).groupBy("bucket", "lane")
    sums = scratch.keep(asked.groupBy("bucket", "lane").cogroup(both).applyInArrow(leaf, kind), "vectors")
    while lanes > 1:
        lanes = -(-lanes // FAN_IN)
        group = F.floor(F.col("lane") / FAN_IN).cast("long").alias("lane")
        sums = scratch.keep(sums.select("bucket", group, "counts").groupBy("bucket", "lane").applyInArrow(add, kind), f"vectors{lanes}")
    return sums.drop("lane")


def replies(asked: DataFrame, counted: DataFrame, lanes: int) -> DataFrame:
    """(chunk, pairs, counts): the corpus counts of what the chunks asked for."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"chunk": pa.array([], pa.int64()), "pairs": pa.array([], pa.list_(pa.int64())), "counts": pa.array([], pa.list_(pa.int64()))})
        levels, (keys,), (counts,) = right["levels"][0].as_py(), _arrays(right, "keys"), _arrays(right, "counts")
        pairs = _arrays(left, "pairs")
        found = counts[_verified(np.concatenate(pairs), levels, keys)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
        return pa.table({"chunk": left["chunk"], "pairs": left["pairs"], "counts": pa.ListArray.from_arrays(offsets, pa.array(found))})

    both = _per_lane(counted, lanes).groupBy("bucket", "lane")
    return asked.drop("counts").groupBy("bucket", "lane").cogroup(both).applyInArrow(look, "chunk long, pairs array<long>, counts array<long>")


ALIGNED = {
    "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_best": pa.int64(),
    "count_sum": pa.int64(), "groups_sha256": pa.string(),
}
ALIGNED_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _aligned(kept: DataFrame, replied: DataFrame, files: tuple[str, str], best: np.ndarray) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = _pair(*files)
        (sizes_a,), (sizes_b,) = _arrays(left, "sizes_a"), _arrays(left, "sizes_b")
        a, b = (_unzip(left[c][0].as_py(), int(n.sum())) for c, n in (("a", sizes_a), ("b", sizes_b)))
        in_a, in_b = pair.align(a, b)
        links = _links(a, b, in_a, in_b)
        ends = np.searchsorted(in_a, np.cumsum(sizes_a))  # groups before the end of each document
        groups = np.diff(ends, prepend=0)
        sums, tops = np.zeros(len(links) + 1, np.int64), np.zeros(len(links) + 1, np.int64)
        digests = [""] * len(groups)
        if len(links):
            pairs, counts = (np.concatenate(_arrays(right, c)) for c in ("pairs", "counts"))
            order = np.argsort(pairs)
            count = counts[order][np.searchsorted(pairs[order], links)]
            np.cumsum(count, out=sums[1:])
            np.cumsum(count == best[b[in_b]], out=tops[1:])
            text, places = pair.spell(a, b, in_a, in_b)
            first = 0
            for n, last in enumerate(ends):
                if groups[n]:
                    digests[n] = hashlib.sha256(text[first : places[last - 1] - 1]).hexdigest()
                    first = places[last - 1]
        values = (left["docs"][0].values, sizes_a, sizes_b, groups, groups, *(np.diff(x[ends], prepend=0) for x in (tops, sums)), digests)
        return pa.table([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, ALIGNED.values(), strict=True)], names=list(ALIGNED))

    return kept.drop("pairs", "counts").groupBy("chunk").cogroup(replied.groupBy("chunk")).applyInArrow(run, ALIGNED_SCHEMA)


def pair_counts(kept: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Buckets with their function, pairs and corpus counts; what the chunks ask of them; the number of lanes."""
    spark = kept.sparkSession
    pairs = scratch.keep(kept.select(F.explode("pairs").alias("pair")).distinct(), "pairs")
    # Several buckets for a task, so that tasks are even.
    buckets = max(-(-pairs.count() // BUCKET_PAIRS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    lanes = max(1, -(-kept.count() // LANE_CHUNKS))
    hashed = scratch.keep(functions(pairs, buckets), "functions")
    asked = scratch.keep(requests(kept, buckets, lanes), "requests")
    return scratch.keep(hashed.join(count_vectors(asked, hashed, scratch, lanes), "bucket"), "counts"), asked, lanes


def align(docs: DataFrame, scratch: Scratch, byte_level: str, pieces: str) -> DataFrame:
    """One row per document (doc_id, text): tokens, groups and links, and what the corpus says of its links.

    ``byte_level`` and ``pieces`` are vocabulary files that the driver can read.
    """
    files = _sent(scratch.spark, byte_level, pieces)
    # Chunks meet their replies by name; in buckets they stay where they are.
    kept = scratch.keep_bucketed(chunks(columns(docs, doc_id="long", text="string"), files, CHUNK_BYTES), "chunks", "chunk")
    counted, asked, lanes = pair_counts(kept, scratch)
    each = counted.select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    highest = each.groupBy(F.col("x.keys").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("x.counts").alias("n"))
    rows = highest.collect()  # no more than B has ids
    best = np.zeros(max((r.b for r in rows), default=0) + 1, np.int64)
    for r in rows:
        best[r.b] = r.n
    return _aligned(kept, replies(asked, counted, lanes), files, best)
