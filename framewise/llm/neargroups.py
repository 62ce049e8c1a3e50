"""Groups of near-equal texts: b-bit MinHash, bands, exact confirmation, components.

1. ``fingerprints``: one pass over the texts gives each its number of distinct shingles, a digest of the
   set, a key for every band of minima, and the low four bits of every minimum packed in longs.
2. Texts of one set become one node, so exact copies cost nothing further.
3. Nodes that share a band key are candidates. The members of a bucket are first compared with a few centres;
   what this leaves in other components than the bucket's largest is compared across components. A pair
   is left out only where both are in one component already, so no component is split, and no bucket is
   expanded into its pairs.
4. Candidates whose similarity, estimated from the packed bits and corrected for chance agreement, is
   hopeless are dropped, and so are those whose parities show too many members that are not common; the rest
   is confirmed on the full sets.
5. Components of the confirmed links.

At similarity 0.8 two sets share no band with a probability of (1 - 0.8^4)^32 = 5e-8, and fall below the cut of
the estimate (0.2 under the threshold, over five standard deviations) in fewer than one of 10^7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm import textarrays
from framewise.llm.components import components
from framewise.llm.shared import Scratch

@dataclass(frozen=True)
class Sketch:
    """How a set is sketched: ``hashes`` minima, bands of ``rows`` of them, and the low four bits of each.

    ``slack``: how far below the threshold the estimated similarity of a candidate may be; None leaves all
    candidates to the exact check, for sketches too short for an estimate.
    """

    hashes: int = 128
    rows: int = 4
    slack: float | None = 0.2

    @property
    def bands(self) -> int:
        return self.hashes // self.rows

    @property
    def longs(self) -> list[str]:
        """Columns of the packed bits."""
        return [f"s{i}" for i in range(self.hashes // LANES)] if self.slack is not None else []

    def minima(self, shingles: np.ndarray, before: np.ndarray) -> np.ndarray:
        """(texts, hashes) minima; every text has at least one shingle."""
        seeds = textarrays.mix64(np.arange(1, 2 * self.hashes + 1, dtype=np.uint64) * textarrays.BASE)
        seeds = (seeds >> np.uint64(32)).astype(np.uint32)
        flips, turns = seeds[: self.hashes], seeds[self.hashes :] | np.uint32(1)
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(before) - 1, self.hashes), np.uint32)
        starts = before[:-1]
        for j in range(self.hashes if len(out) else 0):
            out[:, j] = np.minimum.reduceat((low ^ flips[j]) * turns[j], starts)
        return out

    def band_keys(self, found: np.ndarray) -> np.ndarray:
        rows = found.reshape(len(found), self.bands, self.rows).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * textarrays.BASE, rows.shape[:2])
        for r in range(self.rows):
            keys = textarrays.mix64(keys ^ rows[:, :, r])
        return keys

    def packed_bits(self, found: np.ndarray) -> np.ndarray:
        low = (found & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(found), len(self.longs), LANES)
        shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
        return (low << shifts).sum(axis=2, dtype=np.uint64)

    def likely(self, a: str, b: str, percent: int):
        """Whether sizes, bits and parities of the sets with these column prefixes allow the similarity.

        Sizes and parities never exclude a pair wrongly.
        """
        fits = 100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")
        if self.slack is not None:
            fits = fits & (self.estimate(a, b) >= percent / 100 - self.slack)
        odd = F.zip_with(f"{a}parity", f"{b}parity", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        least = F.aggregate(odd, F.lit(0), lambda total, x: total + x)
        return fits & ((100 + percent) * least <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n")))

    def estimate(self, a: str, b: str):
        """The similarity two packed signatures suggest: agreement of lanes, less what chance gives."""
        differ = F.lit(0)
        for s in self.longs:
            x = F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
            differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        chance = 1 / (1 << BITS)
        return ((1 - differ / self.hashes) - chance) / (1 - chance)


BITS = 4
LANES = 64 // BITS
DOCUMENTS = Sketch()
#: The most centres of a bucket, and the members for which it gets another one.
CENTRES, MEMBERS = 32, 64


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: first, last, the distinct shingles of each text, and their number before each."""
    raw, offsets = textarrays.text_buffer(texts)
    for first, last in textarrays.chunks(offsets):
        low, high = offsets[first], offsets[last]
        hashes, counts = textarrays.words(raw[low:high], offsets[first : last + 1] - low)
        values, before = textarrays.distinct(*textarrays.sequence_hashes(hashes, counts, k))
        yield first, last, values, before


def _digests(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(textarrays.mix64(values ^ textarrays.BASE), dtype=np.uint64)])
    return textarrays.mix64(sums[before[1:]] - sums[before[:-1]] + np.diff(before).astype(np.uint64))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def fingerprints(texts: DataFrame, k: int, sketch: Sketch = DOCUMENTS) -> DataFrame:
    """(ident, text) -> ident, n, node, bands, s0..: texts without words have n 0 and no bands."""
    ident = texts.schema["ident"].dataType.simpleString()
    schema = f"ident {ident}, n long, node long, bands array<long>" + "".join(f", {s} long" for s in sketch.longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, values, before in shingle_sets(batch.column(1), k):
                sizes = np.diff(before)
                some = np.flatnonzero(sizes)
                found = sketch.minima(values, np.concatenate([before[some], before[-1:]]))
                keys, bits = sketch.band_keys(found), np.zeros((last - first, len(sketch.longs)), np.uint64)
                if sketch.longs:
                    bits[some] = sketch.packed_bits(found)
                ends = np.zeros(last - first + 1, np.int32)
                ends[1:] = np.cumsum(np.where(sizes > 0, sketch.bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sizes), _signed(_digests(values, before)),
                     pa.ListArray.from_arrays(pa.array(ends), _signed(keys.reshape(-1))), *(_signed(bits[:, i]) for i in range(len(sketch.longs)))],
                    names=["ident", "n", "node", "bands", *sketch.longs],
                )

    return texts.select("ident", "text").mapInArrow(run, schema)


def set_rows(nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    """node, members (sorted shingles), parity.

    Bit i of the parity tells whether an odd number of members falls into cell i. The parities of two sets differ
    in at most as many cells as the sets have members that are not common.
    """
    cells = [np.bincount((x >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS) & 1 for x in sets]
    bits = np.packbits(np.array(cells, np.uint8).reshape(len(sets), -1), axis=1).reshape(-1)
    longs = (1 << PARITY_BITS) // 64
    parity = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * longs), pa.array(np.ascontiguousarray(bits).view(np.int64)))
    return pa.RecordBatch.from_arrays([nodes, pa.array([x.tobytes() for x in sets], pa.binary()), parity], names=["node", "members", "parity"])


PARITY_BITS = 11
SETS = "node long, members binary, parity array<long>"


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """(node, text) -> rows of ``set_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, values, before in shingle_sets(batch.column(1), k):
                yield set_rows(batch.column(0).slice(first, last - first), [values[a:b] for a, b in zip(before[:-1], before[1:], strict=True)])

    return texts.select("node", "text").mapInArrow(run, SETS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) with 100 * intersection >= percent * union of their full sets."""
    left = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))
    rows = pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

    return rows.mapInArrow(run, "u long, v long")


def near_groups(prints: DataFrame, sets_for: Callable[[DataFrame], DataFrame], scratch: Scratch, percent: int, sketch: Sketch) -> DataFrame:
    """``prints`` (a written table of fingerprints) with ``label``: texts of one label are linked by chains of pairs
    of the given similarity; it is null for a text without words.

    ``sets_for`` turns (node, ident) into ``set_rows``; it is asked for one text of every node that shares a
    band with another.
    """
    firsts = [F.first(c).alias(c) for c in ("n", "bands", *sketch.longs)]
    nodes = scratch.keep(prints.where("n > 0").groupBy("node").agg(F.min("ident").alias("ident"), *firsts), "nodes")

    members = nodes.select("node", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = scratch.keep(members.join(sizes, "key"), "buckets")
    touched = buckets.select("node").distinct()
    sets = scratch.keep(sets_for(nodes.join(touched, "node", "left_semi").select("node", "ident")), "sets")
    marks = nodes.select("node", "n", "bands", *sketch.longs).join(sets.select("node", "parity"), "node")
    carried = ("node", "n", "bands", "parity", *sketch.longs)
    rows = scratch.keep(buckets.join(marks, "node"), "rows")

    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select("key", *(F.col(c).alias(f"{name}_{c}") for c in (*carried, *more)))

    def met(u: DataFrame, v: DataFrame, extra) -> DataFrame:
        """Pairs that meet in a bucket and may be similar, each from the first bucket they share."""
        shared = F.filter(F.zip_with("u_bands", "v_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
        pairs = u.join(v, (u["key"] == v["key"]) & extra & sketch.likely("u_", "v_", percent) & (shared[0] == u["key"]))
        return pairs.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()

    # A bucket has a centre, a large one several, but never more than CENTRES, so candidates stay in proportion to rows.
    lot = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.least(F.lit(CENTRES), F.floor(F.col("size") / MEMBERS))))
    centres = buckets.groupBy("key", lot.alias("lot")).agg(F.min("node").alias("node")).select("key", "node")
    centres = rows.join(centres, ["key", "node"], "left_semi")
    star = scratch.keep(met(side(centres, "u"), side(rows, "v"), F.col("u_node") != F.col("v_node")), "star")
    links = scratch.keep(confirmed(star, sets, percent), "links")
    labels = components(links, scratch)

    # What stands in other components than the largest of its bucket is compared with all others there.
    named = scratch.keep(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    per = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("many"))
    per = per.groupBy("key").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    named = named.join(per.where("labels > 1").select("key", "main"), "key")
    # Of two that both stand outside the largest component, one order is enough.
    once = (F.col("v_label") == F.col("v_main")) | (F.col("u_node") < F.col("v_node"))
    apart = (F.col("u_label") != F.col("v_label")) & once
    across = met(side(named.where("label <> main"), "u", "label"), side(named, "v", "label", "main"), apart)
    more = scratch.keep(confirmed(across.join(star, ["u", "v"], "left_anti"), sets, percent), "more")
    # The new links join components as a whole.
    of = lambda c, out: labels.select(F.col("node").alias(c), F.col("label").alias(out))
    more = more.join(of("u", "a"), "u", "left").join(of("v", "b"), "v", "left")
    merged = components(more.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")), scratch)
    merged = merged.select(F.col("node").alias("part"), F.col("label").alias("whole"))
    scratch.drop("nodes", "buckets", "sets", "rows", "star", "links", "named", "more")
    out = prints.drop("bands", *sketch.longs).join(labels, "node", "left")
    out = out.withColumn("part", F.coalesce("label", "node")).join(merged, "part", "left")
    return out.withColumn("label", F.when(F.col("n") > 0, F.coalesce("whole", "part"))).drop("part", "whole")
