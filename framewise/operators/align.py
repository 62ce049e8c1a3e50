"""Time alignment: equi-joins on ticks, as-of joins, interpolation, intervals to frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import vectors as V
from framewise.operators.intervals import END, START, interval_join
from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks

def tick(time: str | Column, digits: int = 1) -> Column:
    """Time in seconds as an integer number of ``10 ** -digits`` s."""
    c = F.col(time) if isinstance(time, str) else time
    return F.round(c * 10**digits).cast("bigint")


def join_on_time(left: DataFrame, right: DataFrame, time: str = "time", digits: int = 1, key=KEY) -> DataFrame:
    """Inner join on video and rounded time; repeated times multiply, as in a relational join."""
    keys = blocks.as_list(key)
    a = left.withColumn("_tick", tick(time, digits))
    b = right.withColumn("_tick", tick(time, digits)).drop(time)
    return a.join(b, [*keys, "_tick"]).drop("_tick")


def zip_by_index(left: DataFrame, right: DataFrame, key=KEY, index: str = ORDER) -> DataFrame:
    """Pair rows of equal dense position; the longer side is cut."""
    return blocks.join_null_safe(left, right, [*blocks.as_list(key), index])


def _around(
    targets: DataFrame, sources: DataFrame, time: str, cols: Sequence[str], key, width: float, nexts: bool, tie: str | None
) -> DataFrame:
    """Targets with the neighbouring source rows as structs ``_prev``, ``_next`` and ``_first``.

    Both sides share one numeric axis, in whatever unit; at equal times sources come first, in the order of ``tie``
    (their place in a list), or of their values if it is not given. One union, blocks of ``width`` axis
    units, and carries between blocks replace a per-video sort: ``width`` times the row rate is what a task sorts.
    """
    keys = blocks.as_list(key)
    row = F.struct(F.col(time).alias("t"), *([F.col(tie).alias("tie")] if tie else []), *cols)
    s = sources.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), row.alias("_src"))
    t = targets.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*targets.columns).alias("_target"))
    both = s.unionByName(t, allowMissingColumns=True).withColumn(blocks.BLOCK, blocks.axis_block("_t", width))
    source = F.col("_src")
    done = blocks.two_phase(
        both, keys, ["_t", "_side", "_src"],
        running={"_prev": ("last", source)},
        backward={"_next": ("last", source)} if nexts else {},
        stats={"_first": ("min", source)} if not nexts else {},
    )
    found = ["_prev"] + (["_next"] if nexts else ["_first"])
    return done.where(F.col("_side") == 1).select("_target.*", *found)


def asof_ffill(
    targets: DataFrame, sources: DataFrame, cols: Sequence[str], width: float, time: str = "time", key=KEY, tie: str | None = None
) -> DataFrame:
    """Last source values at or before each target; before the first source, the first values."""
    rows = _around(targets, sources, time, cols, key, width, False, tie)
    return rows.select(*targets.columns, *[F.coalesce(f"_prev.{c}", f"_first.{c}").alias(f"{c}_asof") for c in cols])


def _ratio(time: str) -> Column:
    return (F.col(time) - F.col("_prev.t")) / (F.col("_next.t") - F.col("_prev.t"))


def _distance(time: str) -> Column:
    return F.least(F.col(time) - F.col("_prev.t"), F.col("_next.t") - F.col(time))


def interp_linear(
    targets: DataFrame, sources: DataFrame, cols: Sequence[str], tolerance, width: float, time: str = "time", key=KEY,
    tie: str | None = None,
) -> DataFrame:
    """Linear interpolation between neighbouring sources, clamped at the ends.

    ``interpolated`` marks targets with no source within ``tolerance``.
    """
    rows = _around(targets, sources, time, cols, key, width, True, tie)

    def value(c: str) -> Column:
        a, b = F.col(f"_prev.{c}").cast("double"), F.col(f"_next.{c}").cast("double")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * _ratio(time))

    return rows.select(
        *targets.columns, *[value(c).alias(f"{c}_interp") for c in cols], (_distance(time) > tolerance).alias("interpolated")
    )


def interp_vector(
    targets: DataFrame, sources: DataFrame, vec: str, width: float, time: str = "time", key=KEY, renorm: bool = True,
    tie: str | None = None,
) -> DataFrame:
    """Vector interpolation, by default scaled back to unit length (zero vectors stay)."""
    src = sources.withColumn(vec, V.as_double(F.col(vec)))
    rows = _around(targets, src, time, [vec], key, width, True, tie)
    a, b = F.col(f"_prev.{vec}"), F.col(f"_next.{vec}")
    mixed = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(V.lerp(a, b, _ratio(time)))
    out = f"{vec}_interp"
    rows = rows.select(*targets.columns, mixed.alias(out))
    return rows.withColumn(out, V.unit(F.col(out))) if renorm else rows


def align_report(
    targets: DataFrame, modalities: Mapping[str, DataFrame], tolerance, max_gap, width: float, time: str = "time", key=KEY,
) -> DataFrame:
    """Per video and modality: interpolated and covered share, largest source gap, warnings."""
    keys = blocks.as_list(key)
    reports = []
    for name, sources in modalities.items():
        s = sources.select(*keys, time)
        marked = interp_linear(targets.select(*keys, time), s, [], tolerance, width, time, key)
        share = marked.groupBy(*keys).agg(
            (F.sum(F.coalesce(F.col("interpolated"), F.lit(True)).cast("bigint")) / F.count(F.lit(1)) * 100).alias("interpolated_pct")
        )
        stepped = blocks.two_phase(
            s.withColumn(blocks.BLOCK, blocks.axis_block(time, width)), keys, time,
            running={"_before": ("max", F.col(time))}, inclusive=False,
        )
        gaps = stepped.groupBy(*keys).agg(F.coalesce(F.max(F.col(time) - F.col("_before")), F.lit(0)).alias("max_gap"))
        joined = blocks.join_null_safe(share, gaps, keys, "left")
        available = F.col("max_gap").isNotNull()
        reports.append(
            joined.select(
                *keys, F.lit(name).alias("modality"), available.alias("available"),
                F.when(available, F.col("interpolated_pct")).otherwise(0.0).alias("interpolated_pct"),
                F.when(available, 100 - F.col("interpolated_pct")).otherwise(0.0).alias("coverage_pct"),
                F.coalesce("max_gap", F.lit(0)).alias("max_gap"),
                (available & (F.col("interpolated_pct") > 50)).alias("warn_interpolated"),
                (available & (F.col("max_gap") > max_gap)).alias("warn_gap"),
            )
        )
    result = reports[0]
    for other in reports[1:]:
        result = result.unionByName(other)
    return result


def grid(totals: DataFrame, last: str, key=KEY, out: str = ORDER) -> DataFrame:
    """Every tick from 0 to ``last`` inclusive."""
    return blocks.expand(totals.select(*blocks.as_list(key), last), F.lit(0), F.col(last) + 1, out).drop(last)


def covered(clips: DataFrame, key=KEY, start: str = START, end: str = END, out: str = ORDER) -> DataFrame:
    """Each tick under at least one interval, once: intervals are merged before they are expanded."""
    merged = blocks.merge_intervals(clips.where(F.col(end) > F.col(start)), key, start, end)
    return blocks.expand(merged, F.col(start), F.col(end), out).select(*blocks.as_list(key), out)


def label_grid(clips: DataFrame, totals: DataFrame, last: str, key=KEY, start: str = START, end: str = END) -> DataFrame:
    """Grid of ticks with ``active`` = 1 under any interval ``[start, end)``."""
    keys = blocks.as_list(key)
    on = covered(clips, key, start, end).withColumn("active", F.lit(1))
    return (
        blocks.join_null_safe(grid(totals, last, key), on, [*keys, ORDER], "left").withColumn("active", F.coalesce("active", F.lit(0)))
    )


def frame_first_match(
    frames: DataFrame, intervals: DataFrame, ordinal: str, cols: Sequence[str], defaults: Mapping[str, object] | None = None,
    key=KEY, order=ORDER, start: str = START, end: str = END,
) -> DataFrame:
    """Values of the first interval in list order covering each frame, else the default."""
    keys = blocks.as_list(key)
    pairs = interval_join(
        frames.select(*keys, order).distinct(), intervals.select(*keys, start, end, ordinal, *cols), keys, order, start, end
    )
    first = pairs.groupBy(*keys, order).agg(F.min(F.struct(F.col(ordinal).alias("_o"), *cols)).alias("_m"))
    defaults = defaults or {}
    return blocks.join_null_safe(frames, first, [*keys, order], "left").select(
        *frames.columns,
        *[F.coalesce(F.col(f"_m.{c}"), F.lit(defaults[c])).alias(c) if c in defaults else F.col(f"_m.{c}").alias(c) for c in cols],
    )


def frame_concat(
    frames: DataFrame, intervals: DataFrame, ordinal: str, text: str, key=KEY, order=ORDER, start: str = START,
    end: str = END, separator: str = " | ",
) -> DataFrame:
    """All texts covering each frame, joined in list order, and whether there is any."""
    keys = blocks.as_list(key)
    pairs = interval_join(
        frames.select(*keys, order).distinct(), intervals.select(*keys, start, end, ordinal, text), keys, order, start, end
    )
    joined = pairs.groupBy(*keys, order).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("x")))), lambda p: p["x"]),
            separator,
        ).alias("_text")
    )
    return blocks.join_null_safe(frames, joined, [*keys, order], "left").select(
        *frames.columns, F.col("_text").alias("caption_text"), F.col("_text").isNotNull().cast("int").alias("caption_active")
    )


def inside_tracks(track: Column, tracks: int) -> Column:
    """The track; a row of a track outside ``0 .. tracks - 1`` ends the job with a message."""
    message = F.concat(F.lit("track outside the grid: "), track.cast("string"))
    return F.when((track >= 0) & (track < tracks), track).otherwise(F.raise_error(message).cast("int"))


def clips_to_frames(
    clips: DataFrame, totals: DataFrame, steps: str, params: Sequence[str], ordinal: str, tracks: int, key=KEY,
    start: str = START, end: str = END, enabled: str | None = None,
) -> DataFrame:
    """Grid of frames x tracks with the parameters of the last clip in list order; uncovered = 0.

    ``enabled`` names a flag whose false rows are skipped. ``steps`` is the grid length per video. A clip on a track
    from ``tracks`` up is an error rather than a lost row.
    """
    keys = blocks.as_list(key)
    used = clips.withColumn("track", inside_tracks(F.col("track"), tracks))
    if enabled:
        used = used.where(enabled)
    bounded = blocks.join_per_key(used, totals.select(*keys, steps), key, ordinal)
    lo, hi = F.greatest(F.col(start), F.lit(0)), F.least(F.col(end), F.col(steps))
    cells = (
        blocks.expand(bounded, lo, hi, "_at", spread=False)
        .select(*keys, "track", ordinal, *params, F.col("_at").alias(ORDER))
        .groupBy(*keys, ORDER, "track")
        .agg(F.max(F.struct(F.col(ordinal).alias("_o"), *params)).alias("_p"))
    )
    empty = grid(totals.where(F.col(steps) > 0).withColumn("_last", F.col(steps) - 1), "_last", key).withColumn(
        "track", F.explode(F.sequence(F.lit(0), F.lit(tracks - 1)))
    )
    types = {f.name: f.dataType for f in clips.schema}
    return blocks.join_null_safe(empty, cells, [*keys, ORDER, "track"], "left").select(
        *keys, ORDER, "track", F.col("_p").isNotNull().cast("int").alias("active"),
        *[F.coalesce(F.col(f"_p.{p}"), F.lit(0).cast(types[p])).alias(p) for p in params],
    )


def clips_to_source_frames(
    clips: DataFrame, totals: DataFrame, steps: str, params: Sequence[str], ordinal: str, tracks: int, key=KEY,
    start: str = "in_frame", end: str = "out_frame", enabled: str = "enabled",
) -> DataFrame:
    """The same over each clip's source range, clamped to the source; disabled clips are skipped."""
    bounded = blocks.join_per_key(clips, totals.select(*blocks.as_list(key), steps), key, ordinal)
    lo = F.greatest(F.lit(0), F.least(F.col(start), F.col(steps) - 1))
    hi = F.greatest(F.lit(0), F.least(F.col(end), F.col(steps)))
    clamped = bounded.withColumns({"_lo": lo, "_hi": hi}).drop(steps)
    return clips_to_frames(clamped, totals, steps, params, ordinal, tracks, key, "_lo", "_hi", enabled)


def frame_clip_attrs(
    frames: DataFrame, clips: DataFrame, attrs: Sequence[str], ordinal: str, key=KEY, order=ORDER, start: str = START,
    end: str = END,
) -> DataFrame:
    """Descriptive attributes per frame and track from the first covering clip in list order."""
    return frame_first_match(frames, clips, ordinal, attrs, None, [*blocks.as_list(key), "track"], order, start, end)


def keyframe_values(
    clips: DataFrame, keyframes: DataFrame, length: str, fixed: str, default: float, key: str | Sequence[str] = "clip",
    step: int = 1,
) -> DataFrame:
    """Parameter value for every ``step``-th frame of each clip (one row per key).

    A fixed value wins, then the clip's ``(when, value)`` keyframes (linear, clamped at both ends),
    then ``default``. Frames count from the clip's start.

    Only clips and keyframes are shuffled: each of them learns of the next keyframe, and its stretch is expanded to
    frames where it is. Of keyframes at one time the greatest value ends there and the least one begins.
    """
    keys = blocks.as_list(key)
    value = F.struct(F.col("value").cast("double").alias("v"))
    knots = keyframes.where(F.col("when").isNotNull()).groupBy(*keys, F.col("when").alias("_t")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    clip = F.struct(F.col(length).cast("bigint").alias("n"), F.col(fixed).cast("double").alias("fixed"))
    heads = clips.select(*keys, clip.alias("_clip"), F.lit(-(1 << 62)).cast("bigint").alias(blocks.BLOCK))
    knots = knots.withColumn(blocks.BLOCK, blocks.axis_block("_t", blocks.ROWS_PER_BLOCK))
    both = heads.withColumn("_side", F.lit(0)).unionByName(knots.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    knot = F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_lo.v").alias("v")))
    chained = blocks.two_phase(
        both, keys, ["_side", "_t"], running={"_own": ("last", F.col("_clip"))}, backward={"_next": ("last", knot)}, inclusive=False
    ).withColumn("_own", F.coalesce("_clip", "_own")).where("_own.n is not null")
    frames = F.ceil(F.col("_own.n") / step)
    first = F.greatest(F.coalesce(F.ceil(F.col("_t") / step), F.lit(0)), F.lit(0))
    stop = F.least(F.coalesce(F.ceil(F.col("_next.t") / step), frames), frames)
    done = blocks.expand(chained, first, stop, "_i", spread=False).withColumn("when", (F.col("_i") * step).cast("bigint"))
    a, b = F.col("_hi.v"), F.col("_next.v")
    ratio = (F.col("when") - F.col("_t")) / (F.col("_next.t") - F.col("_t"))
    mixed = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * ratio)
    return done.select(*keys, "when", F.coalesce("_own.fixed", mixed, F.lit(default)).alias("value"))


def speaker_asset(features: DataFrame, tracks: DataFrame, mapping: DataFrame, key=KEY, order=ORDER) -> DataFrame:
    """How often each asset is active while each global speaker talks."""
    keys = blocks.as_list(key)
    on = blocks.join_null_safe(features.select(*keys, order, "speaker_id"), tracks.where(F.col("active") == 1).select(*keys, order, "asset_id"), [*keys, order])
    counts = on.groupBy(*keys, "speaker_id", "asset_id").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("first_seen"))
    return (
        blocks.join_null_safe(counts, mapping.select(*keys, "speaker_id", "global_id"), [*keys, "speaker_id"])
        .groupBy("global_id", "asset_id")
        .agg(F.sum("_n").alias("frames"), F.min("first_seen").alias("first_seen"))
    )


def replace_ids(tracks: DataFrame, features: DataFrame, mapping: DataFrame, key=KEY, order=ORDER) -> DataFrame:
    """Set ``asset_id`` to the global speaker of the frame; frames without one keep theirs."""
    keys = blocks.as_list(key)
    talk = features.groupBy(*keys, order).agg(F.min("speaker_id").alias("speaker_id"))
    spoken = (
        blocks.join_per_key(talk, mapping.select(*keys, "speaker_id", "global_id"), [*keys, "speaker_id"], order)
        .select(*keys, order, "global_id")
    )
    return blocks.join_null_safe(tracks, spoken, [*keys, order], "left").select(
        *[F.coalesce("global_id", "asset_id").alias(c) if c == "asset_id" else F.col(c) for c in tracks.columns]
    )


def join_retention(left: DataFrame, right: DataFrame, time: str = "time", key=KEY) -> DataFrame:
    """Compare two time axes per video: rows, range, mean step, and what an exact join keeps.

    Rows are counted per time first, so the join size comes from multiplying counts.
    """
    keys = blocks.as_list(key)

    def side(df: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        counts = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias(f"{p}_n"))
        summary = counts.groupBy(*keys).agg(
            F.sum(f"{p}_n").alias(f"{p}_rows"), F.min(time).alias(f"{p}_from"), F.max(time).alias(f"{p}_to")
        )
        return counts, summary

    lc, ls = side(left, "left")
    rc, rs = side(right, "right")
    kept = lc.join(rc, [*keys, time]).groupBy(*keys).agg(F.sum(F.col("left_n") * F.col("right_n")).alias("joined_rows"))

    def rounded(df: DataFrame) -> DataFrame:
        return df.select(*keys, tick(time, 2).alias("_t")).distinct()

    common = rounded(left).join(rounded(right), [*keys, "_t"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("common_times"))
    joined = F.coalesce("joined_rows", F.lit(0))
    return ls.join(rs, keys).join(kept, keys, "left").join(common, keys, "left").withColumns(
        {
            "joined_rows": joined,
            "common_times": F.coalesce("common_times", F.lit(0)),
            "left_step": (F.col("left_to") - F.col("left_from")) / F.greatest(F.col("left_rows") - 1, F.lit(1)),
            "right_step": (F.col("right_to") - F.col("right_from")) / F.greatest(F.col("right_rows") - 1, F.lit(1)),
            "retention": joined / F.col("left_rows"),
            "low": joined < 0.5 * F.col("left_rows"),
        }
    )
