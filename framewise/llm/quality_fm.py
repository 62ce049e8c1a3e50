"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

    y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

The last term holds all pairwise interactions and is computed in time linear in the features. Features of a
text: its words, hashed to ``WORD_SLOTS`` slots with weights of norm one; statistics of its structure, cut
into bins (one feature per statistic and bin); and metadata, the stored length against that of the text.

Fitting takes at most ``sample_rows`` labelled rows, the ones with the smallest hash of their id, and one task; scoring
reads every text once, whole, and needs neither shuffle nor driver. The model is a fixed number of values.

Defined results
    null text is the empty text and gets a score like any other; null or contradictory labels count by their
    mean, rows of null quality not at all; without any labelled row every score is 0.5; rows repeating a ``doc_id``
    are scored each; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm import textarrays
from framewise.llm.shared import ship

WORD_SLOTS = 1 << 14
BINS = 16
FACTORS = 8
SAMPLE_ROWS = 20_000
STATISTICS = (
    "characters", "words", "lines", "word_length", "capitals", "digits", "marks", "bangs", "bars", "symbols", "distinct", "line_words",
    "repeated_line", "stops", "blanks", "stored_length", "echo",
)
SLOTS = WORD_SLOTS + BINS * len(STATISTICS)


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


CLASSES = {
    "capitals": _class(bytes(range(65, 91))), "digits": _class(bytes(range(48, 58))), "marks": _class(b",;:'\"()-"), "bangs": _class(b"!?"),
    "bars": _class(b"|<>{}[]=/\\"), "symbols": _class(b"#$%&*+@^_~`"), "stops": _class(b"."), "blanks": _class(b" \t"), "lines": _class(b"\n"),
}


def _share_bins(x: np.ndarray) -> np.ndarray:
    """Bins of a share: none at all, then by powers of two below one."""
    return np.where(x > 0, np.clip(BINS - 1 + np.floor(np.log2(np.maximum(x, 1e-9)) * 1.5), 1, BINS - 1), 0).astype(np.int64)


def _size_bins(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(x + 1)), BINS - 1).astype(np.int64)


def features(texts: pa.Array, stored: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of texts: first, last, and slots and values of their features with the number before each text."""
    raw, offsets = textarrays.text_buffer(texts)
    for first, last in textarrays.chunks(offsets):
        low, high = offsets[first], offsets[last]
        here, places, n = raw[low:high], offsets[first : last + 1] - low, last - first
        hashes, counts = textarrays.words(here, places)
        sizes, lengths = np.diff(counts), np.diff(places)
        owner = np.repeat(np.arange(n), sizes)
        slot = (hashes >> np.uint64(64 - 14)).astype(np.int64)
        cells, times = np.unique(owner * WORD_SLOTS + slot, return_counts=True)
        doc, slot = cells // WORD_SLOTS, cells % WORD_SLOTS
        value = np.log1p(times).astype(np.float64)
        norm = np.sqrt(np.bincount(doc, value * value, n))
        value /= norm[doc]

        sums = {k: np.diff(np.concatenate([[0], np.cumsum(table[here])])[places]) for k, table in CLASSES.items()}
        full = np.maximum(lengths, 1)
        distinct = textarrays.distinct(hashes, counts)[1]
        lines = sums["lines"] + (lengths > 0)
        stats = {
            "characters": _size_bins(lengths), "words": _size_bins(sizes), "lines": _size_bins(lines),
            "word_length": _size_bins(lengths / np.maximum(sizes, 1) * 8), "distinct": _share_bins(np.diff(distinct) / np.maximum(sizes, 1)),
            "line_words": _size_bins(sizes / np.maximum(lines, 1)), "repeated_line": _share_bins(_repeated_lines(here, places)),
            "stored_length": np.where(stored[first:last] < 0, 0, 1 + _share_bins(np.abs(stored[first:last] - lengths) / (full + np.abs(stored[first:last])))).clip(0, BINS - 1),
        }
        echo = (np.append(hashes[1:] == hashes[:-1], False)).astype(np.int64) if len(hashes) else np.zeros(0, np.int64)
        if len(echo):
            echo[counts[1:][sizes > 0] - 1] = 0  # a text's last word has no next one
        stats["echo"] = _share_bins(np.bincount(owner, echo, n) / np.maximum(sizes, 1))
        stats |= {k: _share_bins(v / full) for k, v in sums.items() if k != "lines"}
        table = np.stack([WORD_SLOTS + k * BINS + stats[name] for k, name in enumerate(STATISTICS)], axis=1)
        owners = np.concatenate([doc, np.repeat(np.arange(n), len(STATISTICS))])
        order = np.argsort(owners, kind="stable")
        slots = np.concatenate([slot, table.reshape(-1)])[order]
        values = np.concatenate([value, np.full(table.size, 0.25)])[order]
        yield first, last, slots, values, np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))])


def _repeated_lines(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The share of a text's lines that stood in it before."""
    cuts = np.union1d(np.flatnonzero(raw == 10) + 1, places)
    lines = np.add.reduceat(textarrays.byte_values()[raw] * (np.arange(len(raw)) - np.repeat(cuts[:-1], np.diff(cuts)) + 1).astype(np.uint64), cuts[:-1]) if len(raw) else np.zeros(0, np.uint64)
    before = np.searchsorted(cuts, places)
    found = np.diff(textarrays.distinct(lines, before)[1])
    many = np.diff(before)
    return (many - found) / np.maximum(many, 1)


class Machine:
    """Parameters of a factorisation machine, and its prediction for rows in compressed form."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def predict(self, slots: np.ndarray, values: np.ndarray, before: np.ndarray) -> np.ndarray:
        starts = before[:-1]
        terms = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(terms, starts)
        squares = np.add.reduceat(terms * terms, starts)
        return self.bias + np.add.reduceat(self.weights[slots] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1)

    def pack(self) -> bytes:
        return np.concatenate([[self.bias], self.weights, self.factors.reshape(-1)]).astype(np.float32).tobytes()

    @staticmethod
    def unpack(blob: bytes) -> Machine:
        flat = np.frombuffer(blob, np.float32).astype(np.float64)
        return Machine(float(flat[0]), flat[1 : SLOTS + 1], flat[SLOTS + 1 :].reshape(SLOTS, FACTORS))


def fit(slots: np.ndarray, values: np.ndarray, before: np.ndarray, labels: np.ndarray, steps: int = 1000, batch: int = 128, rate: float = 0.02, shrink: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by Adam, a fixed number of steps on batches of rows; deterministic for one order of the rows."""
    random = np.random.default_rng(seed)
    model = np.concatenate([np.zeros((SLOTS, 1)), random.normal(0, 0.01, (SLOTS, FACTORS))], axis=1)
    mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    bias = np.log(mean / (1 - mean))
    first, second = np.zeros_like(model), np.zeros_like(model)
    step = 0
    while step < steps:
        order = random.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = before[rows + 1] - before[rows]
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            places = np.arange(sizes.sum()) + np.repeat(before[rows] - starts, sizes)
            s, x = slots[places], values[places][:, None]
            used, local = np.unique(s, return_inverse=True)
            part = model[used][local]
            terms = part[:, 1:] * x
            sums = np.add.reduceat(terms, starts)
            y = bias + np.add.reduceat(part[:, :1] * x, starts)[:, 0] + 0.5 * (sums * sums - np.add.reduceat(terms * terms, starts)).sum(axis=1)
            slope = (1 / (1 + np.exp(-y)) - labels[rows]) / len(rows)
            own = np.repeat(slope, sizes)[:, None]
            wide = np.concatenate([own * x, own * x * (np.repeat(sums, sizes, axis=0) - terms)], axis=1)
            gradient = np.stack([np.bincount(local, wide[:, k], len(used)) for k in range(wide.shape[1])], axis=1) + shrink * model[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * gradient
            second[used] = 0.999 * second[used] + 0.001 * gradient * gradient
            scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            model[used] -= rate * scale * first[used] / (np.sqrt(second[used]) + 1e-8)
            bias -= rate * slope.sum()
    return Machine(float(bias), model[:, 0], model[:, 1:])


def _stored(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).fill_null(-1).to_numpy(zero_copy_only=False)


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> bytes | None:
    """The packed model of at most ``sample_rows`` labelled rows, or None if there is no label.

    Only ids and labels are ranked; the ids are few by ``sample_rows`` and thus safe to broadcast.
    """
    ship(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("label"))
    marked = marked.where(F.col("id").isNotNull() & F.col("label").isNotNull()).groupBy("id").agg(F.avg("label").alias("label"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.where(usable).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("stored"))
    rows = rows.join(F.broadcast(marked), "id").select("id", "text", "stored", "label")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, slots, values, before in features(batch.column(1), _stored(batch, 2)):
                cut = [(slots[a:b].astype(np.int32).tobytes(), values[a:b].astype(np.float32).tobytes()) for a, b in zip(before[:-1], before[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(3).slice(first, last - first),
                     pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], names=["id", "label", "slots", "values"],
                )

    encoded = rows.mapInArrow(encode, "id long, label double, slots binary, values binary")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in batch.to_pylist()]
        held.sort(key=lambda r: (r["id"], r["slots"], r["values"]))
        if held:
            sizes = np.array([len(r["slots"]) // 4 for r in held])
            slots = np.frombuffer(b"".join(r["slots"] for r in held), np.int32).astype(np.int64)
            values = np.frombuffer(b"".join(r["values"] for r in held), np.float32).astype(np.float64)
            model = fit(slots, values, np.concatenate([[0], np.cumsum(sizes)]), np.array([r["label"] for r in held]))
            yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary())], names=["model"])

    # One task sees the sample, whose size is bounded; one row of fixed size comes back.
    model = encoded.repartition(1).mapInArrow(learn, "model binary").first()
    return bytes(model[0]) if model else None


def score(docs: DataFrame, blob: bytes | None, carry: list[str] | None = None) -> DataFrame:
    """``row``, a struct of the columns in ``carry`` (default: all), and ``quality_score`` from 0 to 1."""
    ship(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    rest = [c for c in carry if c != "text"]
    packed = docs.select(
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("stored")
    )
    whole = F.struct(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in carry)).alias("row")
    if blob is None:
        return packed.select(whole, F.lit(0.5).alias("quality_score"))
    model, with_text = docs.sparkSession.sparkContext.broadcast(blob), "text" in carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.unpack(model.value)
        for batch in batches:
            for first, last, slots, values, before in features(batch.column(1), _stored(batch, 2)):
                y = machine.predict(slots, values, before)
                text = batch.column(1).slice(first, last - first) if with_text else pa.nulls(last - first, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), text, pa.array(1 / (1 + np.exp(-y)))], names=["row", "text", "quality_score"])

    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {row}, text string, quality_score double").select(whole, "quality_score")
