"""Interval algebra on half-open integer intervals keyed by video."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks

START, END = "start_frame", "end_frame"


# Axis units per join bucket. A frame is only compared with the intervals crossing its bucket, so
# the bucket is near the length of typical intervals.
JOIN_BUCKET = 128


def interval_join(
    frames: DataFrame, intervals: DataFrame, key=KEY, order: str = ORDER, start: str = START, end: str = END,
    how: str = "inner", width: int | None = None,
) -> DataFrame:
    """Pair each frame with the intervals covering it.

    Both sides meet on ``(key, bucket of the axis)``, so the join is an equi-join spread over the
    timeline and an interval only meets frames of the buckets it crosses.
    """
    keys, width = blocks.as_list(key), width or min(JOIN_BUCKET, blocks.ROWS_PER_BLOCK)
    left = frames.withColumn(blocks.BLOCK, blocks.int_div(order, width))
    last = F.greatest(F.col(start), F.col(end) - 1)
    right = intervals.select(
        "*", F.explode(F.sequence(blocks.int_div(start, width), blocks.int_div(last, width))).alias(blocks.BLOCK)
    )
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys] + [F.col(blocks.BLOCK) == F.col(f"_r_{blocks.BLOCK}")]
    on += [F.col(f"_r_{start}") <= F.col(order), F.col(order) < F.col(f"_r_{end}")]
    extra = [c for c in intervals.columns if c not in keys]
    return left.join(right, on, how).select(*frames.columns, *[F.col(f"_r_{c}").alias(c) for c in extra])


def extract_clips(
    df: DataFrame, flag: str, fps: float = 10.0, min_seconds: float = 0.0, key=KEY, order=ORDER
) -> DataFrame:
    """Runs of ``flag == 1`` as clips in frames and seconds; the last run closes at the last frame."""
    found = blocks.runs(df.where(F.col(flag) == 1).select(*blocks.as_list(key), order, flag), key, order, flag)
    clips = found.select(
        *blocks.as_list(key),
        F.col("first_pos").alias(START),
        (F.col("last_pos") + 1).alias(END),
        (F.col("first_pos") / fps).alias("start_time"),
        ((F.col("last_pos") + 1) / fps).alias("end_time"),
    )
    if min_seconds:
        clips = clips.where((F.col(END) - F.col(START)) / fps >= min_seconds)
    return clips


def caption_runs(df: DataFrame, flag: str, text: str, time: str, key=KEY, order=ORDER) -> DataFrame:
    """Active runs back to captions.

    The text is the first non-null one up to and including the first inactive row, whose time ends
    the caption (the last row's time if the video ends first). Runs without text are dropped.
    """

    def ahead(w: WindowSpec) -> list[Column]:
        return [F.lead(time).over(w).alias("_next_time"), F.lead(text).over(w).alias("_next_text")]

    rows = blocks.neighbourhood(df, key, order, 0, 1, lambda d, w: d.select("*", *ahead(w)))
    closing = F.struct(
        F.col(order).alias("pos"),
        F.coalesce(F.col("_next_time"), F.col(time)).alias("time"),
        F.col("_next_text").alias("text"),
    )
    found = blocks.runs(
        rows.where(F.col(flag) == 1), key, order, flag,
        {"_text": ("first", F.col(text)), "start_time": ("min", F.col(time)), "_close": ("max", closing)},
    )
    return (
        found.withColumn("text", F.coalesce("_text", "_close.text"))
        .where(F.col("text").isNotNull())
        .select(*blocks.as_list(key), "text", "start_time", F.col("_close.time").alias("end_time"))
    )


def merge_gaps(
    clips: DataFrame, max_gap: int, key=KEY, start: str = START, end: str = END, specs=None
) -> DataFrame:
    """Join clips whose distance is at most ``max_gap`` frames."""
    return blocks.merge_intervals(clips, key, start, end, max_gap, specs)


def refine_clips(
    clips: DataFrame, max_gap: int, min_length: int, order: Sequence[str] = ("merge", "filter"), key=KEY,
    start: str = START, end: str = END,
) -> DataFrame:
    """Gap merging and minimum length in the given order."""
    for step in order:
        if step == "merge":
            clips = merge_gaps(clips, max_gap, key, start, end)
        else:
            clips = clips.where(F.col(end) - F.col(start) >= min_length)
    return clips


def score_clips(
    clips: DataFrame, frames: DataFrame, score: str, fps: float = 10.0, key=KEY, order=ORDER, start=START, end=END
) -> DataFrame:
    """Mean frame score inside each clip times its length in seconds."""
    keys = blocks.as_list(key)
    return (
        interval_join(frames.select(*keys, order, score), clips.select(*keys, start, end), key, order, start, end)
        .groupBy(*keys, start, end)
        .agg(F.avg(score).alias("mean_score"))
        .withColumn("clip_score", F.col("mean_score") * (F.col(end) - F.col(start)) / fps)
    )


def complement(clips: DataFrame, totals: DataFrame, total: str, key=KEY, start=START, end=END) -> DataFrame:
    """Uncovered ranges of ``[0, total)`` with each video's covered share.

    Nested clips are merged first, so a gap never overlaps a clip.
    """
    keys = blocks.as_list(key)
    covered = blocks.with_block(blocks.merge_intervals(clips, key, start, end), start)
    chained = blocks.two_phase(
        covered, key, start,
        backward={"_next": ("min", F.col(start))},
        stats={"covered": ("sum", F.col(end) - F.col(start)), "_first": ("min", F.col(start))},
        inclusive=False,
    )
    sized = blocks.join_per_key(chained, totals, key, start)
    after = F.struct(F.col(end).alias("a"), F.coalesce("_next", total).alias("b"))
    before = F.when(F.col(start) == F.col("_first"), F.struct(F.lit(0).cast("bigint").alias("a"), F.col(start).alias("b")))
    found = sized.select(*keys, F.explode(F.array_compact(F.array(after, before))).alias("g"), "covered", total).select(
        *keys, F.col("g.a").alias("gap_start"), F.col("g.b").alias("gap_end"), "covered", total
    )
    empty = blocks.join_null_safe(totals, clips.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(0).cast("bigint").alias("gap_start"), F.col(total).alias("gap_end"),
        F.lit(0).cast("bigint").alias("covered"), total,
    )
    return (
        found.unionByName(empty)
        .where(F.col("gap_start") < F.col("gap_end"))
        .withColumn("covered_ratio", F.col("covered") / F.col(total))
        .drop(total)
    )


def coverage(clips: DataFrame, totals: DataFrame, total: str, bucket: int = 10, key=KEY, start=START, end=END) -> DataFrame:
    """Covered share of every ``bucket`` frames, labelled by how full it is."""
    keys = blocks.as_list(key)
    merged = blocks.merge_intervals(clips, key, start, end)
    parts = blocks.expand(merged, blocks.int_div(start, bucket), blocks.int_div(F.col(end) - 1, bucket) + 1, "bucket")
    inside = F.least(F.col(end), (F.col("bucket") + 1) * bucket) - F.greatest(F.col(start), F.col("bucket") * bucket)
    used = parts.groupBy(*keys, "bucket").agg(F.sum(inside).alias("_used"))
    grid = blocks.expand(totals.select(*keys, total), F.lit(0), blocks.int_div(total, bucket) + 1, "bucket").select(*keys, "bucket")
    share = F.coalesce(F.col("_used"), F.lit(0)) / bucket
    return (
        blocks.join_null_safe(grid, used, [*keys, "bucket"], "left")
        .withColumn("ratio", share)
        .withColumn(
            "label",
            F.when(F.col("ratio") > 0.8, "full").when(F.col("ratio") > 0.5, "half")
            .when(F.col("ratio") > 0.2, "part").otherwise("none"),
        )
        .drop("_used")
    )


def overlaps(clips: DataFrame, key=KEY, start: str = START, end: str = END) -> DataFrame:
    """Per clip: how many other clips overlap it and by how many frames in total.

    Counted from running totals of starts and ends along the axis, so no pairs are formed and the
    work is linear however many clips share one stretch of time.
    """
    keys = blocks.as_list(key)
    real = clips.where(F.col(end) > F.col(start))
    ends = F.array(
        F.struct(F.col(start).alias("pos"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.col(end).alias("pos"), F.lit(0).alias("s"), F.lit(1).alias("e")),
    )
    points = (
        real.select(*keys, F.explode(ends).alias("p"))
        .groupBy(*keys, F.col("p.pos").alias("pos"))
        .agg(F.sum("p.s").alias("_s"), F.sum("p.e").alias("_e"))
    )
    swept = blocks.two_phase(
        blocks.with_block(points, "pos"), key, "pos",
        running={
            "_starts": ("sum", F.col("_s")), "_ends": ("sum", F.col("_e")),
            "_start_sum": ("sum", F.col("_s") * F.col("pos")), "_end_sum": ("sum", F.col("_e") * F.col("pos")),
        },
    )
    # Frames of all clips that lie before this position.
    area = F.col("pos") * (F.col("_starts") - F.col("_ends")) - F.col("_start_sum") + F.col("_end_sum")
    at = swept.select(*keys, "pos", (F.col("_starts") - F.col("_s")).alias("_open"), F.col("_ends").alias("_shut"), area.alias("_area"))
    first = at.select(*keys, F.col("pos").alias(start), F.col("_shut").alias("_shut0"), F.col("_area").alias("_area0"))
    last = at.select(*keys, F.col("pos").alias(end), F.col("_open").alias("_open1"), F.col("_area").alias("_area1"))
    # One row per position; a few salts for positions shared by many clips.
    joined = blocks.join_per_key(real, first, [*keys, start], end, salts=4)
    joined = blocks.join_per_key(joined, last, [*keys, end], start, salts=4)
    return joined.select(
        *clips.columns,
        (F.col("_open1") - F.col("_shut0") - 1).alias("partners"),
        (F.col("_area1") - F.col("_area0") - (F.col(end) - F.col(start))).alias("overlap_frames"),
    )


def overlap_totals(clips: DataFrame, key=KEY, start: str = START, end: str = END) -> DataFrame:
    """Number of overlapping pairs and their summed overlap per video."""
    return (
        overlaps(clips, key, start, end)
        .groupBy(*blocks.as_list(key))
        .agg(
            blocks.int_div(F.sum("partners"), 2).alias("pairs"),
            blocks.int_div(F.sum("overlap_frames"), 2).alias("overlap_frames"),
        )
    )


def overlap_report(
    clips: DataFrame, ident: str, top: int = 20, key=KEY, start: str = START, end: str = END
) -> DataFrame:
    """The first ``top`` overlapping pairs of each video in list order.

    Take the first ``2 * top`` clips that overlap anything. Each is in a pair whose smaller member
    is among them, and a pair covers at most two clips, so they start at least ``top`` pairs (or
    all there are). Only these few clips are paired with the rest of their video.
    """
    keys = blocks.as_list(key)
    real = clips.where(F.col(end) > F.col(start)).select(*keys, ident, start, end)

    def first(df: DataFrame, n: int, *order: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")

    touching = overlaps(real, key, start, end).where(F.col("partners") > 0)
    leading = first(touching, 2 * top, ident).select(
        *keys, F.struct(F.col(ident).alias("id"), F.col(start).alias("s"), F.col(end).alias("e")).alias("_item")
    )
    leading = leading.groupBy(*keys).agg(F.collect_list("_item").alias("_items"))
    pairs = (
        blocks.join_per_key(real, leading, key, ident)
        .select(*keys, F.col(ident).alias("clip2"), start, end, F.explode("_items").alias("h"))
        .where((F.col("h.id") < F.col("clip2")) & (F.col("h.s") < F.col(end)) & (F.col(start) < F.col("h.e")))
        .select(
            *keys, F.col("h.id").alias("clip1"), "clip2",
            F.greatest("h.s", start).alias("overlap_start"), F.least("h.e", end).alias("overlap_end"),
        )
    )
    return first(pairs, top, "clip1", "clip2")


def pack_lanes(clips: DataFrame, ident: str, key=KEY, start: str = START, end: str = END) -> DataFrame:
    """First-fit lanes: by start, each clip takes the lowest lane that is free.

    Wherever no clip is running all lanes are free, so the timeline is cut at idle points and each
    unbroken stretch is packed on its own. Sorted partitions are streamed batch by batch, holding
    only the lanes: those in use by the end of their clip, the others by number, so that a clip takes the logarithm
    of the lanes. One unbroken stretch is one task's stream, about a million clips in two seconds.
    """
    keys = blocks.as_list(key)
    stretch = blocks.merge_intervals(clips, key, start, end).select(
        *keys, F.col(start).alias("_from"), F.col(end).alias("_to")
    )
    probes = clips.select(*keys, F.col(start).alias("_p")).distinct()
    home = interval_join(probes, stretch, key, "_p", "_from", "_to").select(*keys, F.col("_p").alias(start), "_from")
    placed = blocks.join_per_key(clips, home, [*keys, start], ident, salts=4)
    names = clips.columns

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: tuple | None = None
        busy: list[tuple[int, int]] = []
        free: list[int] = []
        for batch in batches:
            lanes = []
            groups = zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in [*keys, "_from"]], strict=True)
            for g, s, e in zip(groups, batch[start], batch[end], strict=True):
                if g != group:
                    group, busy, free = g, [], []
                while busy and busy[0][0] <= s:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                # With none free all lanes are in use, and the next one is new.
                lane = heapq.heappop(free) if free else len(busy)
                heapq.heappush(busy, (e, lane))
                lanes.append(lane)
            yield batch[names].assign(lane=lanes)

    return (
        placed.repartition(*keys, "_from")
        .sortWithinPartitions(*keys, "_from", start, ident)
        .mapInPandas(pack, StructType([*clips.schema.fields, StructField("lane", LongType())]))
    )


def usage_stats(tracks: DataFrame, active: str, key=KEY, order=ORDER) -> DataFrame:
    """Used and cut frames per video, plus an overall row (null key).

    Used frames add up over tracks, as in the per-track source tables, so ``cut`` can be negative.
    """
    per_video = (
        tracks.groupBy(key)
        .agg((F.max(order) + 1).alias("frames"), F.sum((F.col(active) > 0.5).cast("bigint")).alias("used"))
    )
    return (
        per_video.rollup(key)
        .agg(F.sum("frames").alias("frames"), F.sum("used").alias("used"))
        .withColumn("cut", F.col("frames") - F.col("used"))
        .withColumn("cut_ratio", F.when(F.col("frames") > 0, F.col("cut") / F.col("frames")).otherwise(0.0))
    )


def average_chunks(scored: DataFrame, score: str, key=KEY, order=ORDER) -> DataFrame:
    """Average scores that overlapping chunks produced for the same frame."""
    return scored.groupBy(*blocks.as_list(key), order).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("chunks"))


def chunk_frames(frames: DataFrame, size: int, overlap: int = 100, order=ORDER) -> DataFrame:
    """Copy each frame into every chunk of ``size`` rows (starting every ``size - overlap``) holding it."""
    step = size - overlap
    first = F.greatest(blocks.int_div(F.col(order) - (size - 1) + (step - 1), step), F.lit(0))
    return frames.select("*", F.explode(F.sequence(first, blocks.int_div(order, step))).alias("chunk"))


def split_long(
    segments: DataFrame, text: str, start: str, end: str, max_length: float, ident: Sequence[str] = (),
) -> DataFrame:
    """Split segments longer than ``max_length`` after sentence marks, in proportion to characters."""
    # Sentence marks.
    marks = "。、！？.,!?"
    # Spaces around a piece are eaten by the match; possessive, so that no run of them is tried twice.
    piece = rf"(?U)\s*+([^{marks}]*+[{marks}]|[^{marks}]*[^{marks}\s]|)\s*+"
    pieces = F.filter(F.regexp_extract_all(text, F.lit(piece), F.lit(1)), lambda s: F.length(s) > 0)
    length = F.col(end) - F.col(start)

    def entry(piece: Column, split: bool) -> Column:
        return F.struct(piece.alias("piece"), F.lit(split).alias("split"))

    # A text is cut once, inside the generator: what stands beside a generator is computed again for every piece.
    parts = F.flatten(F.transform(
        F.array(F.when(length > max_length, pieces)),
        lambda found: F.when(F.size(found) > 1, F.transform(found, lambda s: entry(s, True))).otherwise(F.array(entry(F.col(text), False))),
    ))
    measured = segments.withColumn("_chars", F.length(text))
    opened = measured.select(*dict.fromkeys([*ident, start, end]), "_chars", F.posexplode(parts).alias("part", "_e"))
    w = Window.partitionBy(*ident).orderBy("part")
    after = F.sum(F.length("_e.piece")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rate = F.try_divide(length, F.col("_chars"))
    cut = opened.withColumn("_upto", F.least(F.col(start) + after * rate, F.col(end).cast("double"))).withColumn(
        "_from", F.coalesce(F.lag("_upto").over(w), F.col(start).cast("double"))
    )
    return cut.select(
        *ident, "part", F.col("_e.piece").alias("piece"),
        F.col("_from").alias("piece_start"),
        F.when(F.col("_e.split"), F.col("_upto")).otherwise(F.col(end).cast("double")).alias("piece_end"),
    )


def merge_short(
    segments: DataFrame, text: str, start: str, end: str, position: str, min_length, max_gap, key=KEY
) -> DataFrame:
    """Merge a short segment with its close successor, left to right, each segment used once.

    ``position`` is the dense order of segments within the key. In a chain of consecutive
    candidates every second one is consumed by its predecessor, so a row's role follows from its
    distance to the chain's start.
    """

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        nexts = {"_next_start": F.lead(start), "_next_end": F.lead(end), "_next_text": F.lead(text)}
        d = d.withColumns({name: step.over(w) for name, step in nexts.items()})
        candidate = (F.col(end) - F.col(start) < min_length) & (F.col("_next_start") - F.col(end) < max_gap)
        d = d.withColumn("_cand", F.coalesce(candidate, F.lit(False)))
        return d.withColumn("_prev", F.coalesce(F.lag("_cand").over(w), F.lit(False)))

    near = blocks.neighbourhood(segments, key, position, 1, 1, build)
    chained = blocks.two_phase(
        blocks.with_block(near, position), key, position,
        running={"_chain": ("max", F.when(~F.col("_prev"), F.col(position)))},
    )
    consumed = F.pmod(F.col(position) - F.col("_chain"), F.lit(2)) == 1
    return chained.where(~consumed).select(
        *blocks.as_list(key), position, start,
        F.when(F.col("_cand"), F.col("_next_end")).otherwise(F.col(end)).alias(end),
        F.when(F.col("_cand"), F.concat_ws(" ", text, "_next_text")).otherwise(F.col(text)).alias(text),
    )
