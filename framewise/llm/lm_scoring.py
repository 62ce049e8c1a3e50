"""Scoring texts by an n-gram model with deleted interpolation.

P(w | h) = sum over orders of lambda_order(bucket) * maximum likelihood of that order + lambda_0(bucket) / (V + 1)

``bucket`` is the logarithm of the context's frequency. The weights of a bucket are learned by
expectation-maximisation on held-out counts: a part of the training documents is left out of the counts, its
n-grams are looked up in the rest, and the weights that make it likeliest are kept. The final counts
cover all training documents.

Counting and scoring run on blocks of documents. A block is written once: the hashes of its distinct words, and
for every token the place of its word among them. A block asks for the counts of its distinct n-grams, split
by hash into partitions; a partition adds up what all blocks send it and answers each block. A
frequent n-gram is thus one entry per block, and neither tasks nor the driver hold the vocabulary.

Defined results
    null text is the empty text: its end token alone; no training text at all gives zero counts, and
    every token has the probability of an unseen one; rows repeating a ``doc_id`` are texts of their own; a null
    ``doc_id`` is held out of training only if ``held_out`` says so for null; an empty table gives no rows;
    further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm import textarrays
from framewise.llm.shared import Scratch

BLOCK_TOKENS = 1 << 19
#: Whether a query's shuffled files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Entries a counting partition is meant to hold.
PARTITION_ENTRIES = 1 << 21
#: Roles of documents: counted, held out of the counts to learn the weights, not learned from at all.
COUNTED, TUNING, HELD_OUT = 0, 1, 2
#: Of an n-gram's hash 56 bits are kept; words keep all 64.
GRAM_BITS = np.uint64((1 << 64) - (1 << 8))
END_WORD = np.uint64(0x454E44)
BUCKETS = 40
#: Steps per octave of the likelihood ratios that expectation-maximisation sees.
STEPS = 16


def _zip(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array), codec="zstd", asbytes=True)


def _unzip(blob, kind, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _zip_sorted(values: np.ndarray) -> bytes:
    """Ascending values as their steps, byte by byte, so that the high bytes, nearly all zero, cost nothing."""
    steps = np.diff(values, prepend=np.uint64(0))
    return _zip(steps.view(np.uint8).reshape(-1, 8).T)


def _unzip_sorted(blob, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, size * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


BLOCK_SCHEMA = "block long, docs array<long>, roles binary, sizes binary, n_words long, words binary, n_tokens long, tokens binary"


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, role, text) -> rows of about ``BLOCK_TOKENS`` tokens; words are sorted hashes, tokens places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        ids, roles, hashes, sizes, total = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, total
            found, places = np.unique(np.concatenate(hashes), return_inverse=True)
            row = {
                "block": task << 32 | serial, "docs": [x for part in ids for x in part.to_pylist()],
                "roles": np.concatenate(roles).astype(np.int8).tobytes(), "sizes": np.concatenate(sizes).astype(np.int64).tobytes(),
                "n_words": len(found), "words": _zip(found), "n_tokens": len(places), "tokens": _zip(places.astype(np.uint32)),
            }
            serial, total = serial + 1, 0
            for held in (ids, roles, hashes, sizes):
                held.clear()
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            raw, offsets = textarrays.text_buffer(batch.column(2))
            for first, last in textarrays.chunks(offsets):
                low, high = offsets[first], offsets[last]
                found, counts = textarrays.words(raw[low:high], offsets[first : last + 1] - low)
                found = np.insert(found, counts[1:], END_WORD)
                ids.append(batch.column(0).slice(first, last - first))
                roles.append(batch.column(1).slice(first, last - first).to_numpy())
                hashes.append(found)
                sizes.append(np.diff(counts) + 1)
                total += len(found)
                if total >= BLOCK_TOKENS:
                    yield flush()
        if hashes:
            yield flush()

    return docs.select("doc_id", "role", "text").mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """The arrays of one block row."""

    def __init__(self, row: dict):
        self.block, self.docs = row["block"], row["docs"]
        self.roles = np.frombuffer(row["roles"], np.int8)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.words = _unzip(row["words"], np.uint64, row["n_words"])
        self.tokens = _unzip(row["tokens"], np.uint32, row["n_tokens"])
        self.role = np.repeat(self.roles, self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct hashes of the order, and per token the place of the n-gram that ends there.

        At the start of a text the missing words are those of the text start.
        """
        if order == 1:
            return self.words, self.tokens
        if order not in self.found:
            self.found[order] = self._grams(order)
        return self.found[order]

    def _grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        word = self.words[self.tokens]
        value = word * textarrays.FACTORS[0]
        depth = np.arange(len(word)) - np.repeat(self.starts, self.sizes)
        for back in range(1, order):
            earlier = np.where(depth >= back, np.roll(word, back), np.uint64(0))
            value = value + earlier * textarrays.FACTORS[back]
        return np.unique(textarrays.mix64(value) & GRAM_BITS, return_inverse=True)

    def frequencies(self, order: int, counts: dict[int, np.ndarray]) -> np.ndarray:
        """Per token, how often the ``order - 1`` words before it were followed by anything.

        That is the count of the shorter n-gram that ends one token earlier; the start of a text is as frequent
        as its end.
        """
        texts = counts[1][np.searchsorted(self.words, END_WORD)]
        before = np.roll(counts[order - 1][self.grams(order - 1)[1]], 1)
        before[self.starts] = texts
        return before


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


REQUEST = "part int, block long, kind int, n long, hashes binary, counted binary, tuning binary"


def requests(kept: DataFrame, kind: int, parts: int) -> DataFrame:
    """One row per block and partition, for n-grams of one order: sorted hashes and this block's own counts of them."""
    edges = _edges(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            hashes, places = block.grams(kind)
            counted = np.bincount(places[block.role == COUNTED], minlength=len(hashes)).astype(np.uint32)
            tuning = np.bincount(places[block.role == TUNING], minlength=len(hashes)).astype(np.uint32)
            cuts = np.searchsorted(hashes, edges)
            cuts[-1] = len(hashes)
            columns = [[], [], [], [], []]
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                values = (p, b - a, _zip_sorted(hashes[a:b]), _zip(counted[a:b]), _zip(tuning[a:b]))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array([block.block] * parts), pa.array([kind] * parts, pa.int32()),
                 pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])],
                names=["part", "block", "kind", "n", "hashes", "counted", "tuning"],
            )

    return kept.mapInArrow(run, REQUEST)


def _edges(parts: int) -> np.ndarray:
    """The first hash of every partition, and the last of all."""
    return np.array([(p << 64) // parts for p in range(parts)] + [(1 << 64) - 1], np.uint64)


ANSWER = "block long, kind int, part int, n long, counted binary, tuning binary, distinct long, tokens_counted long, tokens_tuning long"


def answers(asked: DataFrame) -> DataFrame:
    """Per request the totals over all blocks, in the order of its hashes; per partition and kind one row with a null
    block that has the number of distinct n-grams of training texts and of their tokens."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kind = key[0].as_py(), key[1].as_py()
        owners, hashes, counted, tuning = [], [], [], []
        for row in _rows(batches):
            owners.append((row["block"], row["n"]))
            hashes.append(_unzip_sorted(row["hashes"], row["n"]))
            counted.append(_unzip(row["counted"], np.uint32, row["n"]))
            tuning.append(_unzip(row["tuning"], np.uint32, row["n"]))
        found, places = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        sums = [np.bincount(places, np.concatenate(c), len(found)).astype(np.int64) for c in (counted, tuning)]
        del counted, tuning
        at = 0
        yield _answer(None, kind, part, 0, b"", b"", int(((sums[0] + sums[1]) > 0).sum()), int(sums[0].sum()), int(sums[1].sum()))
        for block, n in owners:
            here = places[at : at + n]
            at += n
            yield _answer(block, kind, part, n, _zip(sums[0][here]), _zip(sums[1][here]), 0, 0, 0)

    return asked.groupBy("part", "kind").applyInArrow(run, ANSWER)


def _answer(*values) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [field.split()[0] for field in ANSWER.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _with_answers(kept: DataFrame, answered: DataFrame, run, schema: str) -> DataFrame:
    """``run`` gets each block with the counts of everything it asked for, by kind."""
    replies = answered.where("block is not null").select("block", "kind", "part", "n", "counted", "tuning")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        for row in _rows(right.to_batches()):
            got.setdefault(row["kind"], []).append(row)
        counts = {}
        for kind, rows in got.items():
            rows.sort(key=lambda r: r["part"])
            counts[kind] = tuple(np.concatenate([_unzip(r[c], np.int64, r["n"]) for r in rows]) for c in ("counted", "tuning"))
        return pa.Table.from_batches([out for row in _rows(left.to_batches()) for out in run(Block(row), counts)])

    return kept.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(one, schema)


def _bucket(frequency: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than its binary logarithm."""
    return np.minimum(np.where(frequency > 0, np.log2(np.maximum(frequency, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _likelihoods(block: Block, counts: dict[int, np.ndarray], order: int, tokens: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Maximum likelihoods per token, from order 1 up (0 where the context is unseen), the frequency of the context at
    each order, and the bucket of the longest context seen."""
    likely, contexts, bucket = [counts[1][block.tokens] / max(tokens, 1)], [np.full(len(block.tokens), tokens)], np.zeros(len(block.tokens), np.int64)
    for n in range(2, order + 1):
        seen, context = counts[n][block.grams(n)[1]], block.frequencies(n, counts)
        likely.append(np.where(context > 0, seen / np.maximum(context, 1), 0.0))
        contexts.append(context)
        bucket = np.where(context > 0, (n - 2) * BUCKETS + _bucket(context), bucket)
    return likely, contexts, bucket


def _steps(p: np.ndarray, floor: float) -> np.ndarray:
    """The likelihood relative to the uniform one, in steps of a fixed ratio; -10000 for zero."""
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300) / floor) * STEPS), -10000).astype(np.int32)


def tuning_histogram(kept: DataFrame, answered: DataFrame, order: int, tokens: int, floor: float) -> DataFrame:
    """bucket, steps (one per order), n: the held-out tokens by what each order says of them."""

    def run(block: Block, counts: dict) -> Iterator[pa.RecordBatch]:
        found, _, bucket = _likelihoods(block, {n: c[0] for n, c in counts.items()}, order, tokens)
        held = block.role == TUNING
        table = np.stack([bucket[held], *(_steps(p[held], floor) for p in found)], axis=1)
        cells, sizes = np.unique(table, axis=0, return_counts=True) if len(table) else (table, np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells[:, 0].astype(np.int32)), pa.array([row.tolist() for row in cells[:, 1:].astype(np.int32)], pa.list_(pa.int32())), pa.array(sizes)],
            names=["bucket", "steps", "n"],
        )

    rows = _with_answers(kept, answered, run, "bucket int, steps array<int>, n long")
    return rows.groupBy("bucket", "steps").agg(F.sum("n").alias("n"))


def learn_weights(histogram: DataFrame, order: int, rounds: int = 200) -> DataFrame:
    """bucket, weights: from the uniform distribution up to the highest order, one EM per bucket.

    A bucket's group holds cells, not tokens: at most one per combination of steps.
    """

    def fit(key, cells: pd.DataFrame) -> pd.DataFrame:
        steps, n = np.array(cells["steps"].to_list(), np.float64), cells["n"].to_numpy(np.float64)
        p = np.concatenate([np.ones((len(steps), 1)), np.where(steps > -10000, np.exp2(steps / STEPS), 0.0)], axis=1)
        weights = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            share = p * weights
            share /= share.sum(axis=1, keepdims=True)
            new = n @ share / n.sum()
            if np.abs(new - weights).max() < 1e-9:
                break
            weights = new
        return pd.DataFrame({"bucket": [key[0]], "weights": [weights.tolist()], "n": [n.sum()]})

    return histogram.groupBy("bucket").applyInPandas(fit, "bucket int, weights array<double>, n double")


def _score_blocks(kept: DataFrame, answered: DataFrame, order: int, totals: dict, weights: dict[int, list[float]]) -> DataFrame:
    tokens, vocabulary = totals["tokens"], totals["vocabulary"]
    floor = 1 / (vocabulary + 1)
    table = np.tile(np.array([1 / (order + 1)] * (order + 1)), (BUCKETS * max(order - 1, 1), 1))
    for bucket in range(len(table)):
        # A bucket without held-out tokens uses the nearest one that has some.
        if weights:
            table[bucket] = weights[min(weights, key=lambda b: (abs(b - bucket), b))]

    def run(block: Block, counts: dict) -> Iterator[pa.RecordBatch]:
        counts = {n: c[0] + c[1] for n, c in counts.items()}
        found, contexts, bucket = _likelihoods(block, counts, order, tokens)
        # Orders whose context was never seen give their weight to the uniform distribution.
        mixed = np.full(len(bucket), floor) * table[bucket, 0]
        for n, (p, context) in enumerate(zip(found, contexts, strict=True), 1):
            mixed += np.where(context > 0, p, floor) * table[bucket, n]
        seen = counts[1][block.tokens]
        base = np.log10((seen + 1) / (tokens + vocabulary + 1))
        sums = [np.add.reduceat(x, block.starts) for x in (base, np.log10(mixed), (seen > 0).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.docs, pa.int64()), pa.array(block.roles == HELD_OUT), pa.array(block.sizes), pa.array(sums[2]),
             pa.array(np.full(len(block.sizes), tokens, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _with_answers(
        kept, answered, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _answered(kept: DataFrame, scratch: Scratch, order: int, parts: int) -> DataFrame:
    """The answers of all orders, written one order after the other; what an order's requests moved is removed with it."""
    before = kept.sparkSession.conf.get(CLEANUP, None)
    kept.sparkSession.conf.set(CLEANUP, "true")
    try:
        tables = [scratch.keep(answers(requests(kept, kind, parts)), f"answers{kind}") for kind in range(1, order + 1)]
    finally:
        if before is None:
            kept.sparkSession.conf.unset(CLEANUP)
        else:
            kept.sparkSession.conf.set(CLEANUP, before)
    return reduce(DataFrame.unionByName, tables)


def score(docs: DataFrame, scratch: Scratch, held_out: Column, tuning: Column, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text of ``docs``.

    ``held_out`` marks documents that nothing is learned from, ``tuning`` (among the others) those whose counts
    are left out while the weights are learned.
    """
    role = F.when(F.coalesce(held_out, F.lit(False)), HELD_OUT).when(F.coalesce(tuning, F.lit(False)), TUNING).otherwise(COUNTED)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), role.cast("int").alias("role"), F.col("text").cast("string").alias("text"))
    # Blocks meet their answers twice; in buckets they stay where they are, and only the answers move.
    kept = scratch.keep_bucketed(blocks(rows), "blocks", "block")
    size = kept.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-size // PARTITION_ENTRIES))
    answered = _answered(kept, scratch, order, parts)
    ledger = answered.where("block is null and kind = 1")
    found = ledger.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "tokens_counted", "tokens_tuning"))).first()
    totals = {"vocabulary": found[0], "tokens": found[1] + found[2]}
    histogram = tuning_histogram(kept, answered, order, found[1], 1 / (totals["vocabulary"] + 1))
    # At most BUCKETS rows for each order.
    weights = {r["bucket"]: r["weights"] for r in learn_weights(histogram, order).toLocalIterator()}
    return _score_blocks(kept, answered, order, totals, weights)
