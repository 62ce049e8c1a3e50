"""Nearest neighbours by cosine along shifted space-filling curves.

1. Every vector is projected to ``DIMS`` coordinates by a random rotation of its own per curve, shifted, and placed
   on a Hilbert curve. Spark range-partitions the rows by (curve, key); within the sorted stream a query looks at its
   ``window`` neighbours on either side. The best of all curves are merged and reranked by the cosine
   of the original vectors.
2. An exact check follows. The order of the first curve is cut into blocks of near vectors, each with a centre and
   the widest angle to it. A block is searched for a query only if its nearest possible vector beats the k-th
   neighbour found so far. Where vectors cluster, this leaves a few blocks; where they do not (as for
   random vectors of many dimensions, for which no curve keeps neighbours together), it approaches all, in
   tiles of a chunk of queries by a block. Either way the result is the exact one.

Defined results
    vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part,
    nor do rows of null ``vec_id``; of rows repeating a ``vec_id`` the one with the smallest components counts;
    ties go to the smaller ``vec_id``; fewer than ``k`` other vectors: all of them; an empty table gives no rows;
    further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.shared import Scratch

DIMS, LEVELS = 8, 6
BLOCK, CHUNK = 1024, 256


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (rows) with ``bits`` bits per coordinate.

    The transposed index is built by undoing, from the highest bit down, the reflections and exchanges of the
    subcubes (Skilling, Programming the Hilbert curve, 2004); all points at once.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            upper = (x[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, seed: int) -> np.ndarray:
    random = np.random.default_rng([seed, curve])
    wide = unit.shape[1]
    turn = np.linalg.qr(random.normal(size=(wide, wide)))[0][:, : min(DIMS, wide)]
    # Coordinates of a random unit vector have a deviation of one over the root of its length.
    place = 1 / (1 + np.exp(-1.7 * (unit @ turn) * np.sqrt(wide)))
    shifted = (place + random.uniform(0, 1, place.shape[1])) / 2
    return hilbert(np.minimum((shifted * (1 << LEVELS)).astype(np.int64), (1 << LEVELS) - 1), LEVELS)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def valid_vectors(table: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, vector (doubles), is_query; one row per id."""
    vector = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("is_query", is_query)


def _curve_rows(vectors: DataFrame, wide: int, curves: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), wide)
            unit = rows / np.abs(rows).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            for curve in range(curves):
                key = pa.array(curve_keys(unit, curve, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), curve, np.int32)), key, *batch.columns], names=["curve", "key", "vec_id", "vector", "is_query"])

    return vectors.mapInArrow(run, "curve int, key long, vec_id long, vector array<double>, is_query boolean")


HITS = "query_id long, vec_id long, score double"


def _hits(query: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(other), pa.array(score)], names=["query_id", "vec_id", "score"])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _windows(ordered: DataFrame, wide: int, window: int, k: int) -> DataFrame:
    """The ``k`` best among the ``window`` neighbours on either side of a query in the stream of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve = ids = marks = rows = None

        def look(first: int, last: int) -> Iterator[pa.RecordBatch]:
            for at in first + np.flatnonzero(marks[first:last]):
                low, high = max(0, at - window), min(len(ids), at + window + 1)
                near = low + np.flatnonzero((curve[low:high] == curve[at]) & (ids[low:high] != ids[at]))
                score = cosine(rows[near], rows[at])
                top = _best(ids[near], score, k)
                yield _hits(np.full(len(top), ids[at]), ids[near][top], score[top])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False), _matrix(batch.column(3), wide)]
            # The last ``window`` rows before may still lack neighbours; those before them are neighbours only.
            done = 0 if ids is None else len(ids) - min(window, len(ids))
            if ids is not None:
                new = [np.concatenate([a, b]) for a, b in zip((curve, ids, marks, rows), new, strict=True)]
            curve, ids, marks, rows = new
            yield from look(done, len(ids) - window)
            drop = max(0, len(ids) - 2 * window)
            curve, ids, marks, rows = curve[drop:], ids[drop:], marks[drop:], rows[drop:]
        if ids is not None:
            yield from look(max(0, len(ids) - window), len(ids))

    return ordered.mapInArrow(run, HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _packs(ordered: DataFrame, wide: int, size: int, with_floor: bool) -> DataFrame:
    """Consecutive rows of a task, ``size`` at a time: pack, ids, rows, floors as arrays in binary form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, count = TaskContext.get().partitionId() << 32, [], 0

        def emit(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal serial, held, count
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            for at in range(0, n, size):
                part = [c[at : min(at + size, n)] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([serial]), *(pa.array([p.tobytes()], pa.binary()) for p in part)], names=["pack", "ids", "rows", "floors"])
                serial += 1
            held, count = [tuple(c[n:] for c in columns)], count - n

        for batch in batches:
            floors = batch.column(2).to_numpy() if with_floor else np.zeros(0)
            held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), wide), floors if with_floor else np.zeros(batch.num_rows)))
            count += batch.num_rows
            if count >= size:
                yield from emit(count // size * size)
        if count:
            yield from emit(count)

    return ordered.mapInArrow(run, "pack long, ids binary, rows binary, floors binary")


def _tiles(tiles: DataFrame, wide: int, k: int) -> DataFrame:
    """Per tile the ``k`` best of every query that the block may improve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_rows, floors, ids, rows = (batch.column(c)[i].as_buffer() for c in range(5))
                q_ids, floors, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(floors), np.frombuffer(ids, np.int64)
                q_rows, rows = np.frombuffer(q_rows).reshape(-1, wide), np.frombuffer(rows).reshape(-1, wide)
                unit = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                q_unit = q_rows / np.sqrt((q_rows * q_rows).sum(axis=1, keepdims=True))
                centre = unit.sum(axis=0)
                centre /= max(np.sqrt((centre * centre).sum()), 1e-300)
                widest = np.arccos(np.clip((unit @ centre).min(), -1, 1))
                angle = np.arccos(np.clip(q_unit @ centre, -1, 1))
                bound = np.cos(np.maximum(0, angle - widest))
                open_ = np.flatnonzero(bound >= floors - 1e-9)
                scores = q_unit[open_] @ unit.T
                for q, row in zip(open_, scores, strict=True):
                    good = np.flatnonzero((row >= floors[q] - 1e-12) & (ids != q_ids[q]))
                    if len(good) > 4 * k:
                        least = np.partition(row[good], len(good) - k)[len(good) - k]
                        good = good[row[good] >= least - 1e-12]
                    if len(good):
                        exact = cosine(rows[good], q_rows[q])
                        top = _best(ids[good], exact, k)
                        yield _hits(np.full(len(top), q_ids[q]), ids[good][top], exact[top])

    return tiles.mapInArrow(run, HITS)


def nearest(table: DataFrame, is_query: Column, scratch: Scratch, k: int = 5, curves: int = 4, window: int = 64, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query. ``is_query`` is an expression of vec_id."""
    vectors = scratch.keep(valid_vectors(table, is_query), "vectors")
    wide = vectors.groupBy(F.size("vector").alias("wide")).count().orderBy(F.col("count").desc(), "wide").limit(1).first()
    if wide is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    wide = wide[0]
    placed = scratch.keep(_curve_rows(vectors.where(F.size("vector") == wide).select("vec_id", "vector", "is_query"), wide, curves, seed), "curves")
    ordered = placed.repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    found = scratch.keep(_top(_windows(ordered, wide, window, k), k).drop("rank"), "found")

    first = placed.where("curve = 0")
    floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("floor"))
    queries = first.where("is_query").join(floors, F.col("vec_id") == F.col("query_id"), "left").select("key", "vec_id", "vector", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    along = lambda df: df.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    blocks = scratch.keep(_packs(along(first).select("vec_id", "vector"), wide, BLOCK, False), "blocks")
    chunks = _packs(along(queries).select("vec_id", "vector", "floor"), wide, CHUNK, True)
    # Every chunk of queries meets every block: rows of names only, joined with the arrays by name.
    names = blocks.agg(F.collect_list("pack")).scalar()
    chunks = scratch.keep(chunks.select(F.col("pack").alias("chunk"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), "floors"), "chunks")
    tiles = chunks.select("chunk", F.explode(names).alias("pack"))
    tiles = tiles.join(chunks, "chunk").join(blocks.select("pack", "ids", "rows"), "pack").select("q_ids", "q_rows", "floors", "ids", "rows")
    better = _tiles(tiles, wide, k)
    return _top(found.unionByName(better), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
