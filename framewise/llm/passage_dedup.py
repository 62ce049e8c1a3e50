"""Passages that repeat across documents: paragraph MinHash banding, exact confirmation, components.

A document is cut into two kinds of paragraphs.

* Lines of at least ``min_words`` words. Near-equal lines are found by MinHash bands tuned for recall
  (24 minima, bands of three: a pair of similarity 0.8 is missed with (1 - 0.8^3)^8 = 0.3 %), confirmed by
  the exact Jaccard similarity of their 5-word shingles, and clustered by components.
* Windows of ``LENGTH`` words that start where the hash of three words is the smallest among ``REACH``
  neighbours. Such starts depend on the words alone, so a passage of ``REACH + LENGTH + 2`` = 50 words or more has
  at least one window of its own wherever it stands in a line. A window's set is its word sequence, so equal
  windows are one node and need no bands. An equal window is only a seed: it is extended word by word for as long as
  another document goes on equally. Neighbouring windows of a run of 50 words are at most ``REACH`` words apart, and so
  are its first and last ones from its ends; a shorter run that has one ends within ``SIDE`` words of it. ``SIDE``
  words to each side thus reach the ends of every run. A window travels as one row with the hashes of these words: the
  places of a window meet in one task, where sorting the sides puts next to each other those that go on equally. A
  window of more than ``HOT`` places is dealt out by ranges of its sorted sides instead, and what runs over the ends of a
  range is put together from all ranges.

Within a cluster the paragraph with the smallest (doc_id, place) stays; the others are removed, also those at later
places of the same document, unless they are windows that overlap the one that stays. Of the words around a window
those are removed that an earlier place of it has equally, up to there; every removed word thus has an earlier copy.
Touching paragraphs of a document with the same fate are reported as one span of words.

Defined results
    null text or too few words: no paragraph, hence no row; a paragraph that repeats within one document only is
    no finding; rows equal in ``doc_id`` and text count as one document; a null ``doc_id`` sorts before all
    others; an empty table gives no rows; further columns pass through ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm import textarrays
from framewise.llm.neargroups import SETS, Sketch, _digests, _signed, near_groups, set_rows
from framewise.llm.shared import Scratch, columns

SHINGLE = 5
MIN_WORDS = 20
GRAM, REACH, LENGTH = 3, 28, 20
#: Words to each side of a window that are compared.
SIDE = REACH + GRAM - 1
SKETCH = Sketch(hashes=24, rows=3, slack=None)
#: Windows whose sides are hashed together.
SLICE = 1 << 14
#: Bytes of the hash of a word beside a window.
CELL = 6
#: The most places of a window that meet in one task, and the sides that make a lot of others.
HOT, LOT = 1 << 12, 1 << 16
#: The most frequent windows that are joined apart, and the items tracked to find them.
FREQUENT, TRACKED = 1000, 1 << 14
SIDES = "doc_id long, key long, at long, removed boolean, node long, left binary, right binary"
ENDS = "doc_id long, key long, at long, removed boolean, node long, left int, right int, left_gone int, right_gone int"
LOTS = "part int, kind int, node long, side int, step int, prefix binary, doc_id long, key long, at long, removed boolean, last_doc long, last_key long, reach int, gone int, head int, tail int"
UNITS = "doc_id long, key long, at long, words int, n long, node long, bands array<long>"


def line_offsets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of these texts, and the number of lines before each text."""
    cuts = np.union1d(np.flatnonzero(raw == 10) + 1, offsets)
    return cuts, np.searchsorted(cuts, offsets)


def window_starts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places, in the words of all texts, where a window of ``LENGTH`` words begins."""
    grams = len(hashes) - GRAM + 1
    if grams < REACH:
        return np.zeros(0, np.int64)
    value = sum(hashes[j : j + grams] * textarrays.FACTORS[j] for j in range(GRAM))
    value = textarrays.mix64(value)
    lowest = np.arange(grams - REACH + 1) + np.lib.stride_tricks.sliding_window_view(value, REACH).argmin(axis=1)
    # Only neighbourhoods within one text count.
    text = np.searchsorted(counts, np.arange(len(lowest)), "right")
    inside = np.arange(len(lowest)) + REACH + GRAM - 1 <= counts[text]
    found = np.unique(lowest[inside])
    return found[found + LENGTH <= counts[np.searchsorted(counts, found, "right")]]


def _bodies(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at these places."""
    spot = starts[:, None] + np.arange(LENGTH)
    return textarrays.mix64((hashes[spot] * textarrays.FACTORS[:LENGTH]).sum(axis=1, dtype=np.uint64) + np.uint64(LENGTH))


def _words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, words before each line, words before each text, text of each line."""
    cuts, lines_before = line_offsets(raw, offsets)
    hashes, line_counts = textarrays.words(raw, cuts)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(lines_before))
    return hashes, line_counts, line_counts[lines_before], owner


def units(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, text) -> paragraphs; ``at`` is the first word, and windows have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textarrays.text_buffer(batch.column(2))
            for first, last in textarrays.chunks(offsets):
                low, high = offsets[first], offsets[last]
                if low == high:
                    continue
                hashes, lines, counts, owner = _words_of(raw[low:high], offsets[first : last + 1] - low)
                sizes = np.diff(lines)
                long = np.flatnonzero(sizes >= min_words)
                values, before = textarrays.distinct(*textarrays.sequence_hashes(hashes, lines, SHINGLE))
                parts = [values[before[i] : before[i + 1]] for i in long]
                mine = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                chosen = np.concatenate(parts) if parts else values[:0]
                keys = SKETCH.band_keys(SKETCH.minima(chosen, mine)).reshape(-1)
                yield _unit_rows(batch, first, owner[long], lines[long] - counts[owner[long]], sizes[long], np.diff(mine), _digests(chosen, mine), keys)

                starts = window_starts(hashes, counts)
                text = np.searchsorted(counts, starts, "right") - 1
                body = _bodies(hashes, starts)
                yield _unit_rows(batch, first, text, starts - counts[text], np.full(len(text), LENGTH), np.full(len(text), LENGTH), body, None)

    return texts.select("doc_id", "key", "text").mapInArrow(run, UNITS)


def _unit_rows(batch: pa.RecordBatch, first: int, text: np.ndarray, at: np.ndarray, words: np.ndarray, n: np.ndarray, nodes: np.ndarray, keys: np.ndarray | None) -> pa.RecordBatch:
    owner = pa.array(text + first)
    if keys is None:
        bands = pa.nulls(len(text), pa.list_(pa.int64()))
    else:
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * SKETCH.bands), _signed(keys))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at), pa.array(words.astype(np.int32)), pa.array(n.astype(np.int64)), _signed(nodes), bands],
        names=["doc_id", "key", "at", "words", "n", "node", "bands"],
    )


def _line_sets(texts: DataFrame) -> DataFrame:
    """(doc_id, key, text, wanted: the line starts and nodes) -> rows of ``set_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textarrays.text_buffer(batch.column(0))
            wanted = batch.column(1)
            for first, last in textarrays.chunks(offsets):
                low, high = offsets[first], offsets[last]
                hashes, lines, counts, owner = _words_of(raw[low:high], offsets[first : last + 1] - low)
                values, before = textarrays.distinct(*textarrays.sequence_hashes(hashes, lines, SHINGLE))
                # A line is found by its first word; of lines that start at one word, the last is not empty.
                place = {(int(t), int(a - counts[t])): i for i, (t, a) in enumerate(zip(owner, lines[:-1], strict=True))}
                nodes, sets = [], []
                for t in range(first, last):
                    for w in wanted[t].as_py():
                        i = place[t - first, w["at"]]
                        nodes.append(w["node"])
                        sets.append(values[before[i] : before[i + 1]])
                yield set_rows(pa.array(nodes, pa.int64()), sets)

    return texts.select("text", "wanted").mapInArrow(run, SETS)


def _cells(words: np.ndarray, inside: np.ndarray) -> pa.Array:
    """Per row the hashes inside, ``CELL`` bytes each; none is zero."""
    top = np.maximum(words >> np.uint64(64 - 8 * CELL), np.uint64(1))
    data = np.ascontiguousarray(top[inside].astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - CELL :]
    ends = np.zeros(len(words) + 1, np.int32)
    ends[1:] = np.cumsum(inside.sum(axis=1) * CELL)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _words_in(cells: pa.Array) -> np.ndarray:
    """(rows, ``SIDE``) hashes of ``_cells``, zero where there is no word."""
    _, places, data = cells.buffers()
    ends = np.frombuffer(places, np.int32)[cells.offset : cells.offset + len(cells) + 1]
    out = np.zeros((len(cells), SIDE), np.uint64)
    if ends[-1] > ends[0]:
        wide = np.zeros(((ends[-1] - ends[0]) // CELL, 8), np.uint8)
        wide[:, 8 - CELL :] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, CELL)
        out[np.arange(SIDE) < (np.diff(ends) // CELL)[:, None]] = wide.view(">u8").ravel()
    return out


def _sides(texts: DataFrame) -> DataFrame:
    """(doc_id, key, text, wanted: places of windows, the first word that belongs to their left, and what is carried
    along) -> one row per window with the words to its left, nearest first, and to its right."""
    steps = np.arange(1, SIDE + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textarrays.text_buffer(batch.column(2))
            for first, last in textarrays.chunks(offsets):
                low, high = offsets[first], offsets[last]
                hashes, counts = _words_of(raw[low:high], offsets[first : last + 1] - low)[::2]
                wanted = batch.column(3).slice(first, last - first)
                text = np.repeat(np.arange(last - first), wanted.value_lengths().to_numpy())
                at, floor, removed = wanted.flatten().flatten()[:3]
                for a in range(0, len(text), SLICE):
                    own, here, least = text[a : a + SLICE], at[a : a + SLICE], floor[a : a + SLICE].to_numpy()
                    starts = counts[own] + here.to_numpy()
                    left, right = starts[:, None] - steps, starts[:, None] + LENGTH - 1 + steps
                    sides = []
                    for spot, inside in ((left, left >= (counts[own] + least)[:, None]), (right, right < counts[own + 1][:, None])):
                        sides.append(_cells(hashes[np.where(inside, spot, 0)], inside))
                    owner = pa.array(own + first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(owner), batch.column(1).take(owner), here, removed[a : a + SLICE], _signed(_bodies(hashes, starts)), *sides],
                        names=["doc_id", "key", "at", "removed", "node", "left", "right"],
                    )

    return texts.select("doc_id", "key", "text", "wanted").mapInArrow(run, SIDES)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        for values in (c.fill_null(0).to_numpy(), c.is_null().to_numpy(zero_copy_only=False)):
            out[1:] |= values[1:] != values[:-1]
    return out


def _common(group: np.ndarray, rank: np.ndarray, doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order of the sorted sides of each group, the words each has in common with the one before it (-1: another
    group), and per row the most words it has in common with another document, and that such a class of places has of
    which the first, by ``rank``, is not the row's.

    The more words a class has, the fewer places are in it, so both are the number of lengths at which it is so.
    """
    n = len(group)
    sort = np.empty((n, 4 + SIDE * 8), np.uint8)
    sort[:, :4] = group.astype(">u4").view(np.uint8).reshape(n, 4)
    sort[:, 4:] = words.astype(">u8").view(np.uint8).reshape(n, SIDE * 8)
    order = np.argsort(sort.view(f"S{sort.shape[1]}").ravel(), kind="stable")
    group, rank, doc, words = group[order], rank[order], doc[order], words[order]
    equal = ((words[1:] == words[:-1]) & (words[1:] != 0)).cumprod(axis=1).sum(axis=1)
    common = np.concatenate([[-1], np.where(group[1:] == group[:-1], equal, -1)]).astype(np.int64)
    reach, gone = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for step in range(1, SIDE + 1):
        starts = np.flatnonzero(common < step)
        many = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        if not many.any():
            break
        sizes = np.diff(np.append(starts, n))
        there = np.repeat(many, sizes)
        reach[order] += there
        gone[order] += there & (np.repeat(np.minimum.reduceat(rank, starts), sizes) < rank)
    return order, common, reach, gone


def _ends(rows: DataFrame) -> DataFrame:
    """Rows of ``_sides`` of nodes of few places -> per window the words that another document has equally on its
    left and right, and how many of them an earlier place has."""

    def resolved(table: pa.Table) -> pa.RecordBatch:
        rows = table.combine_chunks().to_batches()[0]
        doc, whole = _changes(rows["node"], rows["doc_id"], rows["key"]), _changes(rows["node"], rows["doc_id"], rows["key"], rows["at"])
        # Rows equal in doc_id and text are one document.
        rows, doc = rows.filter(pa.array(whole)), np.cumsum(doc)[whole]
        group, rank = np.cumsum(_changes(rows["node"])), np.arange(rows.num_rows)
        found = [_common(group, rank, doc, _words_in(rows[c]))[2:] for c in ("left", "right")]
        return pa.RecordBatch.from_arrays(
            [rows[c] for c in ("doc_id", "key", "at", "removed", "node")] + [pa.array(found[i][j]) for j in range(2) for i in range(2)],
            names=["doc_id", "key", "at", "removed", "node", "left", "right", "left_gone", "right_gone"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last node of a batch may go on in the next one.
        rest = []
        for batch in batches:
            table = pa.Table.from_batches([*rest, batch])
            if not len(table):
                continue
            last = int(np.flatnonzero(_changes(table["node"].combine_chunks()))[-1])
            if last:
                yield resolved(table.slice(0, last))
            rest = table.slice(last).to_batches()
        if rest:
            yield resolved(pa.Table.from_batches(rest))

    return rows.repartition("node").sortWithinPartitions("node", "doc_id", "key", "at").mapInArrow(run, ENDS)


def _ends_of_hot(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``_ends``, for nodes of any number of places.

    A lot is a range of sorted sides. A class of places that begin equally is wholly in one lot, or it has the first
    or the last side of each lot where it is; so every lot gives the first and last place of the classes of these two, and
    what they are in all lots goes back to the rows that have so many words in common with them.
    """
    rows = scratch.keep(rows.dropDuplicates(["doc_id", "key", "at"]), "hot")
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("words")), F.struct(F.lit(1).alias("side"), F.col("right").alias("words"))))
    by = ["node", "side", "words", "doc_id", "key", "at"]
    sides = rows.select("node", side.alias("s"), "doc_id", "key", "at", "removed").select("node", "s.side", "s.words", "doc_id", "key", "at", "removed")
    dealt = sides.repartitionByRange(2 * rows.count() // LOT + 1, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        lot = pa.Table.from_batches(filled).combine_chunks().to_batches()[0]
        none = lot["doc_id"].is_null().to_numpy(zero_copy_only=False)
        by_ident = np.lexsort((lot["at"].to_numpy(), lot["key"].to_numpy(), lot["doc_id"].fill_null(0).to_numpy(), ~none))
        rank, doc = np.empty(len(none), np.int64), np.empty(len(none), np.int64)
        rank[by_ident] = np.arange(len(none))
        doc[by_ident] = np.cumsum(_changes(*(lot[c].take(pa.array(by_ident)) for c in ("doc_id", "key"))))
        words = _words_in(lot["words"])
        order, common, reach, gone = _common(np.cumsum(_changes(lot["node"], lot["side"])), rank, doc, words)

        def given(kind: int, spot: np.ndarray, last: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
            own, other = lot.take(pa.array(spot)), lot.take(pa.array(last))
            columns = {c: own[c] for c in ("part", "node", "side", "doc_id", "key", "at", "removed")}
            columns |= {"kind": pa.array(np.full(len(spot), kind, np.int32)), "last_doc": other["doc_id"], "last_key": other["key"]} | more
            names = [field.split()[0] for field in LOTS.split(", ")]
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(spot), pa.binary() if c == "prefix" else pa.int32())) for c in names], names=names)

        along = {}
        for kind, edge in ((1, order[0]), (2, order[-1])):
            known = int(np.count_nonzero(words[edge]))
            if kind == 1:
                path = np.minimum.accumulate(np.concatenate([[known], common[1:]]))
            else:
                path = np.minimum.accumulate(np.concatenate([[known], common[:0:-1]]))[::-1]
            along[kind] = np.empty(len(none), np.int32)
            along[kind][order] = path
            if known:
                inside = [rank[along[kind] >= step] for step in range(1, known + 1)]
                prefix = [lot["words"][int(edge)].as_py()[: CELL * step] for step in range(1, known + 1)]
                least, most = (by_ident[np.array([pick(r) for r in inside])] for pick in (np.min, np.max))
                # The node and side of a class are those of the edge.
                yield given(kind, least, most, step=pa.array(np.arange(1, known + 1, dtype=np.int32)), prefix=pa.array(prefix, pa.binary()))
        spot = np.arange(len(none))
        yield given(0, spot, spot, reach=pa.array(reach), gone=pa.array(gone), head=pa.array(along[1]), tail=pa.array(along[2]))

    found = scratch.keep(dealt.mapInArrow(run, LOTS), "lots")
    ident, last = F.struct("doc_id", "key", "at"), F.struct(F.col("last_doc").alias("doc_id"), F.col("last_key").alias("key"))
    edges = found.where("kind > 0")
    classes = edges.groupBy("node", "side", "prefix").agg(F.min(ident).alias("first"), F.max(last).alias("last")).where(_document("first") != F.col("last")).drop("last")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("step", "first")))
    known = edges.select("part", "kind", "step", "node", "side", "prefix").join(classes, ["node", "side", "prefix"]).groupBy("part").agg(of(1).alias("heads"), of(2).alias("tails"))
    longest = lambda classes, along, more: F.array_max(F.transform(F.filter(classes, lambda c: (c["step"] <= F.col(along)) & more(c)), lambda c: c["step"]))
    most = lambda own, more: F.greatest(own, longest("heads", "head", more), longest("tails", "tail", more))
    rows = found.where("kind = 0").join(known, "part", "left").withColumn("ident", ident)
    rows = rows.withColumn("reach", most("reach", lambda c: F.lit(True))).withColumn("gone", most("gone", lambda c: c["first"] < F.col("ident")))
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return rows.groupBy("doc_id", "key", "at", "removed", "node").agg(
        on(0, "reach").alias("left"), on(1, "reach").alias("right"), on(0, "gone").alias("left_gone"), on(1, "gone").alias("right_gone"),
    )


def _document(ident: str) -> Column:
    return F.struct(F.col(f"{ident}.doc_id"), F.col(f"{ident}.key"))


def _runs(texts: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, key, start, end, cluster_id, removed: windows that other documents have too, with the equal words around."""
    def shared(some: DataFrame, few: bool) -> DataFrame:
        places = some.groupBy("node").agg(F.min("ident").alias("first"), F.max("ident").alias("last"), F.count(F.lit(1)).alias("many"))
        places = places.where(_document("first") != _document("last")).select("node", "first", "many")
        return some.join(F.broadcast(places) if few else places, "node")

    # The first places of the most frequent windows, at most FREQUENT, go to every task, so that no task gets all places.
    top = windows.agg(F.expr(f"approx_top_k(node, {FREQUENT}, {TRACKED})").alias("top")).first()["top"] or []
    frequent = [row["item"] for row in top if row["count"] > HOT]
    members = shared(windows.where(~F.col("node").isin(frequent)), False).unionByName(shared(windows.where(F.col("node").isin(frequent)), True)) if frequent else shared(windows, False)
    # In the document of the first place, the sides of later ones end where its window does.
    after = (_document("ident") == _document("first")) & (F.col("ident.at") > F.col("first.at"))
    floor = F.when(after, F.col("first.at") + LENGTH).otherwise(F.lit(0).cast("long"))
    # A place that overlaps the window that stays is a part of it.
    apart = (_document("ident") != _document("first")) | (F.col("ident.at") >= F.col("first.at") + LENGTH)
    removed = (F.col("ident") != F.col("first")) & apart
    place = F.struct(F.col("ident.at").alias("at"), floor.alias("floor"), removed.alias("removed"), (F.col("many") > HOT).alias("hot"))
    per = members.groupBy(F.col("ident.doc_id").alias("d"), F.col("ident.key").alias("k")).agg(F.collect_set(place).alias("wanted"))
    per = scratch.keep(per, "wanted")

    def sides(hot: bool) -> DataFrame:
        some = per.withColumn("wanted", F.filter("wanted", lambda w: w["hot"] == hot)).where(F.size("wanted") > 0)
        rows = texts.join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "text", "wanted")
        return _sides(rows)

    found = _ends(sides(False))
    if per.where(F.exists("wanted", lambda w: w["hot"])).limit(1).count():
        found = found.unionByName(_ends_of_hot(sides(True), scratch))
    found = found.withColumn("ident", F.struct("doc_id", "key", "at"))
    at = F.col("ident.at")
    span = lambda a, b, removed: F.struct(a.alias("start"), b.alias("end"), F.lit(removed).alias("removed"))
    whole = span(at - F.col("left"), at + LENGTH + F.col("right"), False)
    gone = span(at - F.col("left_gone"), at + LENGTH + F.col("right_gone"), True)
    before, behind = span(at - F.col("left"), at - F.col("left_gone"), False), span(at + LENGTH + F.col("right_gone"), at + LENGTH + F.col("right"), False)
    spans = F.when(F.col("removed"), F.filter(F.array(gone, before, behind), lambda s: s["start"] < s["end"])).otherwise(F.array(whole))
    rows = found.select("ident", F.xxhash64(F.lit(1), "node").alias("cluster_id"), F.explode(spans).alias("span"))
    return rows.select("ident.doc_id", "ident.key", "span.start", "span.end", "cluster_id", "span.removed")


def repeats(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, percent: int = 80) -> DataFrame:
    """doc_id, key, start_word, end_word, cluster_id, removed: the spans of paragraphs that other documents have too."""
    texts = columns(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("text"))
    found = scratch.keep(units(texts, min_words), "units")
    ident = F.struct("doc_id", "key", "at").alias("ident")
    lines = found.where("bands is not null").select(ident, "words", "n", "node", "bands")

    def sets_for(wanted: DataFrame) -> DataFrame:
        per = wanted.groupBy(F.col("ident.doc_id").alias("d"), F.col("ident.key").alias("k")).agg(F.collect_list(F.struct(F.col("ident.at").alias("at"), "node")).alias("wanted"))
        rows = texts.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("text", "wanted")
        return _line_sets(rows).dropDuplicates(["node"])

    grouped = near_groups(lines, sets_for, scratch, percent, SKETCH).select("ident", "words", F.struct(F.lit(0).alias("kind"), F.col("label").alias("id")).alias("cluster"))
    owners = grouped.groupBy("cluster").agg(F.min("ident").alias("first"), F.max("ident").alias("last"))
    owners = owners.where(_document("first") != _document("last")).select("cluster", "first")
    rows = grouped.join(owners, "cluster").select(
        F.col("ident.doc_id").alias("doc_id"), F.col("ident.key").alias("key"), F.col("ident.at").alias("start"), (F.col("ident.at") + F.col("words")).alias("end"),
        F.xxhash64("cluster.kind", "cluster.id").alias("cluster_id"), (F.col("ident") != F.col("first")).alias("removed"),
    )
    rows = rows.unionByName(_runs(texts, found.where("bands is null").select(ident, "node"), scratch))
    same = Window.partitionBy("doc_id", "key", "removed").orderBy("start", "end", "cluster_id")
    reach = F.max("end").over(same.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("opens").over(same))
    spans = rows.groupBy("doc_id", "key", "removed", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("cluster_id").alias("cluster_id"))
    return spans.select("doc_id", "key", "start_word", "end_word", "cluster_id", "removed")


def without_repeats(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, percent: int = 80) -> DataFrame:
    """All columns of ``docs``, ``text`` without the spans to remove; white space around what stays is kept."""
    spans = repeats(docs, scratch, min_words, percent).where("removed")
    cuts = spans.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("cuts"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key")
    ).join(cuts, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    word = F.regexp_extract_all(F.col("text"), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    left = F.filter(word, lambda _, i: ~F.exists(F.col("cuts"), lambda c: (c["a"] <= i) & (i < c["b"])))
    clean = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(left, ""))
    return rows.select(*(clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
