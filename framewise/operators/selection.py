"""Choosing thresholds and clips under a duration budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framewise.operators import metrics
from framewise.operators.intervals import END, START, interval_join
from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks


def select_budget(
    clips: DataFrame, score: str, target: int, max_total: int, key=KEY, start: str = START, end: str = END,
    only_if_over: bool = False,
) -> DataFrame:
    """Greedy selection by score: take what still fits ``max_total``, stop at ``target`` (frames).

    Among clips of one length the greedy rule takes a prefix by score, and no more than
    ``max_total / length`` of them can fit. Keeping only that prefix per length leaves at most
    ``max_total * ln(max_total)`` candidates per video whatever its size, with the same result.
    ``only_if_over`` keeps every clip of a video whose clips together stay within ``target``.
    """
    keys = blocks.as_list(key)
    sized = clips.withColumn("_len", (F.col(end) - F.col(start)).cast("bigint"))
    rank = [F.col(score).desc(), F.col(start)]
    room = F.floor(F.lit(max_total) / F.col("_len"))
    fitting = sized.where((F.col("_len") > 0) & (F.col("_len") <= max_total))
    for by in (["_len", "_salt"], ["_len"]):
        w = Window.partitionBy(*keys, *by).orderBy(*rank)
        fitting = fitting.withColumn("_salt", F.pmod(F.hash(start), F.lit(blocks.SALTS)))
        fitting = fitting.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= room).drop("_rn", "_salt")

    item = F.struct(
        (-F.col(score)).alias("neg"), F.col(start).alias("s"), F.col("_len").alias("len"),
        F.struct(*clips.columns).alias("row"),
    )
    queue = fitting.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_queue"))
    empty = F.filter(F.transform("_queue", lambda i: i["row"]), lambda i: F.lit(False))

    def take(state: Column, i: Column) -> Column:
        fits = (state["total"] < target) & (state["total"] + i["len"] <= max_total)
        return F.when(
            fits,
            F.struct((state["total"] + i["len"]).alias("total"), F.concat(state["rows"], F.array(i["row"])).alias("rows")),
        ).otherwise(state)

    start_state = F.struct(F.lit(0).cast("bigint").alias("total"), empty.alias("rows"))
    picked = queue.select(
        F.explode(F.aggregate("_queue", start_state, take)["rows"]).alias("_row")
    ).select(*[F.col(f"_row.{c}").alias(c) for c in clips.columns])
    if not only_if_over:
        return picked
    totals = sized.groupBy(*keys).agg((F.sum("_len") <= target).alias("_all"))
    whole = blocks.join_per_key(clips, totals, key, start).where("_all").select(*clips.columns)
    partial = blocks.join_per_key(picked, totals, key, start).where(~F.col("_all")).select(*clips.columns)
    return whole.unionByName(partial)


def search_threshold(
    scores: DataFrame, score: str, target: float, fps: float = 10.0, over: float = 20.0, steps: int = 100,
    key=KEY, order=ORDER,
) -> DataFrame:
    """Pick one of ``steps`` evenly spaced thresholds per video.

    The lowest whose active seconds lie in ``[target / 2, target + over]`` wins, else the one
    closest to ``target``. A video shorter than ``target / 2`` is accepted whole. A threshold of
    exactly 0 gives way to the next admissible one.

    Each frame is put into its threshold bin once; everything after that is at most ``steps`` rows
    per video.
    """
    keys = blocks.as_list(key)
    s, lo, hi = F.col(score), F.col("_lo"), F.col("_hi")
    last = steps - 1
    ranged = blocks.two_phase(
        blocks.with_block(scores.select(*keys, order, score), order), key, order,
        stats={"_lo": ("min", s), "_hi": ("max", s)},
    )

    def threshold(i: Column) -> Column:
        return F.when(i >= last, hi).otherwise(lo + i * ((hi - lo) / last))

    guess = F.least(F.greatest(F.floor(F.try_divide(s - lo, (hi - lo) / last)), F.lit(0)), F.lit(last))
    guess = F.coalesce(guess, F.lit(last)).cast("int")
    bin_ = (
        F.when((guess < last) & (threshold(guess + 1) <= s), guess + 1)
        .when(threshold(guess) > s, guess - 1)
        .otherwise(guess)
    )
    binned = ranged.groupBy(*keys, "_lo", "_hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per_video = binned.groupBy(*keys, "_lo", "_hi").agg(
        F.collect_list(F.struct("bin", "n")).alias("bins"), F.sum("n").alias("frames")
    )
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda i: F.struct(
            i.alias("i"),
            threshold(i).alias("thr"),
            F.aggregate(
                F.filter("bins", lambda b: b["bin"] >= i), F.lit(0).cast("bigint"), lambda a, b: a + b["n"]
            ).alias("n"),
        ),
    )
    admissible = F.filter("grid", lambda g: (g["n"] / fps >= target / 2) & (g["n"] / fps <= target + over))
    inside = F.array_min(
        F.transform(admissible, lambda g: F.struct((g["thr"] == 0).alias("a"), g["i"].alias("b"), g["thr"].alias("thr"), g["n"].alias("n")))
    )
    nearest = F.array_min(
        F.transform("grid", lambda g: F.struct(F.abs(g["n"] / fps - target).alias("a"), g["i"].alias("b"), g["thr"].alias("thr"), g["n"].alias("n")))
    )
    short = F.col("frames") / fps < target / 2
    return (
        per_video.withColumn("grid", counts)
        .withColumns({"_in": inside, "_near": nearest})
        .select(
            *keys,
            F.when(short, lo - 1).otherwise(F.coalesce("_in.thr", "_near.thr")).alias("threshold"),
            F.when(short, F.col("frames")).otherwise(F.coalesce("_in.n", "_near.n")).alias("active_frames"),
        )
    )


def search_threshold_pr(
    scores: DataFrame, score: str, label: str, by: str = "f1", key: str | Sequence[str] = KEY, fps: float = 10.0,
    min_seconds: float = 90.0, max_seconds: float = 200.0,
) -> DataFrame:
    """Threshold with the best F1 or recall among those whose active seconds are admissible.

    Thresholds are the distinct scores; the lowest one wins ties and is the fallback. Videos
    shorter than ``min_seconds`` are accepted whole. An empty ``key`` searches globally.
    """
    keys = blocks.as_list(key)
    seconds = F.col("n_pred") / fps
    good = (seconds >= min_seconds * 0.95) & (seconds <= max_seconds * 1.05) & (F.col(by) > 0)
    best = F.max(F.when(good, F.struct(F.col(by).alias("v"), (-F.col("threshold")).alias("neg"))))
    found = metrics.pr_curve(scores, score, label, key).groupBy(*keys).agg(
        F.min("threshold").alias("_lowest"), F.max("frames").alias("frames"), best.alias("_best")
    )
    short = F.col("frames") / fps < min_seconds
    return found.select(
        *keys,
        F.when(short, F.col("_lowest") - 1).otherwise(F.coalesce(-F.col("_best.neg"), F.col("_lowest"))).alias("threshold"),
        F.when(~short, F.col("_best.v")).alias(f"best_{by}"),
        short.alias("accept_all"),
    )


def adjust_threshold(
    scores: DataFrame, score: str, current: DataFrame, threshold: str, min_seconds: float, min_clip: float,
    fps: float = 10.0, key=KEY, order=ORDER,
) -> DataFrame:
    """Lower a threshold until the clips it yields last ``min_seconds``: the largest that does, or the lowest score.

    A frame lies in a long enough clip at a threshold if some stretch of the least length around it stays above. So the
    highest such threshold of a frame is the greatest, over stretches that hold it, of their least scores, and the
    seconds a threshold yields are a count of frames: no threshold is tried.
    """
    keys = blocks.as_list(key)
    length = max(1, math.ceil(min_clip * fps - 1e-9))
    needed = math.ceil(min_seconds * fps - 1e-9)
    reach = length - 1

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        ahead, behind = w.rangeBetween(0, reach), w.rangeBetween(-reach, 0)
        d = d.withColumn("_least", F.when(F.count(score).over(ahead) == length, F.min(score).over(ahead)))
        return d.withColumn("_kept", F.max("_least").over(behind))

    frames = scores.select(*keys, F.col(order).cast("bigint").alias(order), score)
    opened = blocks.neighbourhood(frames, key, order, 2 * reach, reach, build)
    counts = opened.where("_kept is not null").groupBy(*keys, "_kept").agg(F.count(F.lit(1)).alias("_n"))
    counts = blocks.range_blocks(counts, keys, "_kept")
    above = blocks.two_phase(counts, keys, "_kept", backward={"_frames": ("sum", F.col("_n"))})
    best = above.where(F.col("_frames") >= needed).groupBy(*keys).agg(F.max("_kept").alias("_best"))
    lows = frames.groupBy(*keys).agg(F.min(score).alias("_lo"))
    bounds = blocks.join_null_safe(lows, current.select(*keys, F.col(threshold).alias("_hi")), keys)
    enough = F.col("_best").isNotNull() | F.lit(needed <= 0)
    return blocks.join_null_safe(bounds, best, keys, "left").select(
        *keys, F.when(F.lit(needed <= 0), F.col("_hi")).when(enough, F.least("_hi", "_best")).otherwise(F.col("_lo")).alias("threshold"), enough.alias("satisfied")
    )


def best_threshold(curve: DataFrame, min_recall: float = 0.71, by: str | Sequence[str] = ()) -> DataFrame:
    """Highest F1 with at least ``min_recall``; the lowest threshold wins ties."""
    keys = blocks.as_list(by)
    rank = F.struct("f1", (-F.col("threshold")).alias("neg"), "precision", "recall")
    return (
        curve.where(F.col("recall") >= min_recall)
        .groupBy(*keys)
        .agg(F.max(rank).alias("b"))
        .select(*keys, (-F.col("b.neg")).alias("threshold"), "b.f1", "b.precision", "b.recall")
    )


def sweep_f1(df: DataFrame, score: str, label: str, thresholds: Sequence[float] | None = None, default: float = 0.5) -> DataFrame:
    """F1 with ``score > threshold`` at fixed thresholds; the first maximum wins, ``default`` if all are 0.

    Rows are binned by how many thresholds they exceed, so the sweep reads the data once.
    """
    grid = list(thresholds) if thresholds is not None else [0.1 + 0.05 * i for i in range(16)]
    passed = sum(((F.col(score) > t).cast("int") for t in grid), F.lit(0))
    bins = df.groupBy(passed.alias("passed")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("bigint")).alias("pos")
    )
    packed = bins.agg(F.collect_list(F.struct("passed", "n", "pos")).alias("bins"), F.sum("pos").alias("positives"))
    eps = 1e-8

    def rated(t: Column, i: Column) -> Column:
        def over(field: str) -> Column:
            return F.aggregate(F.filter("bins", lambda b: b["passed"] > i), F.lit(0).cast("bigint"), lambda acc, b: acc + b[field])

        precision, recall = over("pos") / (over("n") + eps), over("pos") / (F.col("positives") + eps)
        return F.struct((2 * precision * recall / (precision + recall + eps)).alias("f1"), (-i).alias("place"), t.alias("threshold"))

    best = F.array_max(F.transform(F.array(*[F.lit(t) for t in grid]), rated))
    return packed.select(best.alias("b")).select(
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(default).alias("threshold"), F.col("b.f1").alias("f1")
    )


def tune_params(labels: DataFrame, flag: str, fps: float = 10.0, key: str | Sequence[str] = (KEY, "track"), sample=KEY, order=ORDER) -> DataFrame:
    """Clip parameters learned from label statistics, one row.

    25 % of clip lengths clamped to 2-5 s, 75 % of gaps clamped to 1-3 s, and median and 90 % of
    the active seconds per sample (any track).
    """
    keys = blocks.as_list(key)
    found = blocks.runs(labels, keys, order, flag)
    length = (F.col("last_pos") - F.col("first_pos") + 1).cast("bigint")
    on = found.where(F.col(flag) == 1)
    # A gap is an inactive run with clips on both sides.
    span = on.groupBy(*keys).agg(F.min("first_pos").alias("_a"), F.max("last_pos").alias("_b"))
    off = blocks.join_per_key(found.where(F.col(flag) == 0), span, keys, "first_pos").where(
        (F.col("first_pos") > F.col("_a")) & (F.col("last_pos") < F.col("_b"))
    )
    seconds = (
        labels.groupBy(sample, order).agg(F.max(flag).alias("_any"))
        .groupBy(sample).agg(F.sum("_any").alias("len"))
    )

    def quantiles(df: DataFrame, *points: tuple[str, float]) -> DataFrame:
        counted = df.groupBy("len").agg(F.count(F.lit(1)).alias("_n"))
        return counted.agg(*[(F.percentile("len", p, F.col("_n")) / fps).alias(name) for name, p in points])

    clip = quantiles(on.select(length.alias("len")), ("_p25", 0.25))
    gap = quantiles(off.select(length.alias("len")), ("_p75", 0.75)).scalar()
    one = quantiles(seconds, ("_p50", 0.5), ("_p90", 0.9)).select("*", clip.scalar().alias("_p25"), gap.alias("_p75"))

    def clamp(c: Column, lo: float, hi: float) -> Column:
        return F.greatest(F.lit(lo), F.least(c, F.lit(hi)))

    return one.select(
        F.when(F.col("_p25").isNull(), 3.0).otherwise(clamp(F.col("_p25"), 2.0, 5.0)).alias("min_duration"),
        F.when(F.col("_p75").isNull(), 2.0).otherwise(clamp(F.col("_p75"), 1.0, 3.0)).alias("max_gap"),
        F.coalesce("_p50", F.lit(90.0)).alias("target_duration"),
        F.coalesce("_p90", F.lit(150.0)).alias("max_duration"),
    )


def best_track(scores: DataFrame, prob: str, threshold: float, track: str = "track", key=KEY, order=ORDER) -> DataFrame:
    """Most probable track above ``threshold`` per frame, -1 if none; ties go to the lowest track."""
    rank = F.struct(F.col(prob).alias("p"), (-F.col(track)).alias("neg"))
    best = F.max(F.when(F.col(prob) > threshold, rank))
    return (
        scores.groupBy(*blocks.as_list(key), order)
        .agg(best.alias("_b"))
        .select(*blocks.as_list(key), order, F.coalesce(-F.col("_b.neg"), F.lit(-1)).alias("best_track"))
    )


def track_segments(
    scores: DataFrame, prob: str, threshold: float, means: Sequence[str] = (), asset: str | None = None,
    track: str = "track", key=KEY, order=ORDER,
) -> DataFrame:
    """Runs of one best track (inclusive end) with its mean score, mean parameters and median asset.

    The median is exact for any asset number, read off the counts per run and asset, and rounded down.
    """
    keys = blocks.as_list(key)
    carried = [prob, *means, *([asset] if asset else [])]
    rank = F.struct(
        F.col(prob).alias("p"), (-F.col(track)).alias("neg"), F.struct(*[F.col(c).alias(f"v_{c}") for c in carried]).alias("row")
    )
    frames = (
        scores.groupBy(*keys, order)
        .agg(F.max(F.when(F.col(prob) > threshold, rank)).alias("_b"))
        .select(*keys, order, (-F.col("_b.neg")).alias("track_id"), *[F.col(f"_b.row.v_{c}").alias(c) for c in carried])
        .where(F.col("track_id").isNotNull())
    )
    specs = {"_n": ("count", F.lit(1)), **{f"_sum_{c}": ("sum", F.col(c)) for c in [prob, *means]}}
    found = blocks.runs(frames, keys, order, "track_id", specs)
    result = found.select(
        *keys, "track_id", F.col("first_pos").alias("first_frame"), F.col("last_pos").alias("last_frame"),
        *[(F.col(f"_sum_{c}") / F.col("_n")).alias(c) for c in [prob, *means]],
    )
    if not asset:
        return result
    spans = found.select(*keys, F.col("first_pos").alias("first_frame"), (F.col("last_pos") + 1).alias("_stop"))
    inside = interval_join(frames.select(*keys, order, asset), spans, keys, order, "first_frame", "_stop")
    counted = inside.groupBy(*keys, "first_frame", asset).agg(F.count(F.lit(1)).alias("_many"))
    middle = counted.groupBy(*keys, "first_frame").agg(F.floor(F.percentile(asset, F.lit(0.5), F.col("_many"))).cast("bigint").alias(asset))
    return blocks.join_null_safe(result, middle, [*keys, "first_frame"], "left").select(*result.columns, asset)


def merge_segments(segments: DataFrame, max_gap: int, min_length: int, params: Sequence[str], key=KEY) -> DataFrame:
    """Merge inclusive segments across short gaps, keep the first one's parameters, drop short ones."""
    half_open = segments.withColumn("_stop", F.col("last_frame") + 1)
    specs = {p: ("first", F.col(p)) for p in params}
    merged = blocks.merge_intervals(half_open, key, "first_frame", "_stop", max_gap, specs)
    return merged.where(F.col("_stop") - F.col("first_frame") >= min_length).withColumn(
        "last_frame", F.col("_stop") - 1
    ).drop("_stop")


def infer_media(
    segments: DataFrame, frames: DataFrame, crops: Sequence[str], rotation: str, scale: str, key=(KEY, "track"), order=ORDER
) -> DataFrame:
    """Guess each segment's media kind from the predicted parameters inside it."""
    keys = blocks.as_list(key)
    half_open = segments.select(*keys, "first_frame", (F.col("last_frame") + 1).alias("_stop"))
    inside = interval_join(frames, half_open, keys, order, "first_frame", "_stop")
    crop = sum((F.abs(F.col(c)) for c in crops), F.lit(0.0)) / len(crops)
    return (
        inside.groupBy(*keys, "first_frame", (F.col("_stop") - 1).alias("last_frame"))
        .agg(F.avg(crop).alias("_crop"), F.avg(F.abs(rotation)).alias("_rot"), F.var_pop(scale).alias("_var"))
        .select(
            *keys, "first_frame", "last_frame",
            F.when((F.col("_crop") < 0.01) & (F.col("_rot") < 1.0), "graphic")
            .when(F.col("_var") < 0.001, "image").otherwise("video").alias("media_type"),
        )
    )
