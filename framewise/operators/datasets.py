"""Dataset building: reshape, scale, window, pad, split, augment."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from framewise.functions import vectors as V
from framewise.operators.align import inside_tracks
from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks

# Task functions travel inside the plan, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- reshape ----------------------------------------------------------------------------------


def pivot_tracks(df: DataFrame, params: Sequence[str], tracks: int, key=KEY, order=ORDER, track: str = "track") -> DataFrame:
    """One row per frame with ``track_{n}_{param}`` columns; missing cells are 0, a track from ``tracks`` up is an error."""
    picks = [F.first(p).alias(p) for p in params]
    wide = df.withColumn(track, inside_tracks(F.col(track), tracks)).groupBy(*blocks.as_list(key), order).pivot(track, list(range(tracks))).agg(*picks)
    keys = [*blocks.as_list(key), order]

    def source(n: int, p: str) -> str:
        return str(n) if len(params) == 1 else f"{n}_{p}"

    return wide.select(
        *keys,
        *[F.coalesce(F.col(f"`{source(n, p)}`"), F.lit(0).cast(df.schema[p].dataType)).alias(f"track_{n}_{p}") for n in range(tracks) for p in params],
    )


def unpivot_tracks(df: DataFrame, params: Sequence[str], tracks: int, key=KEY, order=ORDER) -> DataFrame:
    """The reverse of ``pivot_tracks``."""
    rows = F.array(*[F.struct(F.lit(n).alias("track"), *[F.col(f"track_{n}_{p}").alias(p) for p in params]) for n in range(tracks)])
    return df.select(*blocks.as_list(key), order, F.explode(rows).alias("r")).select(*blocks.as_list(key), order, "r.*")


# --- scaling ----------------------------------------------------------------------------------


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    """Scaler parameters as a table ``column, shift, scale``.

    ``standard``: mean and population deviation; ``minmax``: minimum and range. A constant column
    has scale 1. Fit on training rows only to keep evaluation data out.
    """

    def params(c: str) -> Column:
        if method == "standard":
            shift, spread = F.avg(c), F.stddev_pop(c)
        else:
            shift, spread = F.min(c), F.max(c) - F.min(c)
        return F.struct(
            F.lit(c).alias("column"), shift.cast("double").alias("shift"),
            F.when(spread > 0, spread).otherwise(1.0).cast("double").alias("scale"),
        )

    return df.agg(F.array(*[params(c) for c in cols]).alias("p")).select(F.explode("p").alias("s")).select("s.*")


def _scaling(scaler: DataFrame) -> Column:
    """The scaler table (one row per column) as one map value."""
    return scaler.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("shift", "scale"))))).scalar()


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], inverse: bool = False) -> DataFrame:
    ready = df.withColumn("_scaler", _scaling(scaler))

    def moved(c: str) -> Column:
        p = F.element_at("_scaler", F.lit(c))
        return F.col(c) * p["scale"] + p["shift"] if inverse else (F.col(c) - p["shift"]) / p["scale"]

    return ready.withColumns({c: moved(c) for c in cols}).drop("_scaler")


def fit_vector_scaler(df: DataFrame, vec: str) -> DataFrame:
    """Per-dimension mean and population deviation of a vector column, as one row of arrays."""
    per = df.select(F.posexplode(V.as_double(F.col(vec))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    item = F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))
    return per.agg(F.array_sort(F.collect_list(item)).alias("p")).select(
        F.transform("p", lambda d: d["m"]).alias("shift"), F.transform("p", lambda d: d["s"]).alias("scale")
    )


def apply_vector_scaler(df: DataFrame, scaler: DataFrame, vec: str) -> DataFrame:
    shift, scale = scaler.select("shift").scalar(), scaler.select("scale").scalar()
    centred = F.zip_with(V.as_double(F.col(vec)), "_shift", lambda x, m: x - m)
    return (
        df.withColumns({"_shift": shift, "_scale": scale})
        .withColumn(vec, F.zip_with(centred, "_scale", lambda x, s: x / s))
        .drop("_shift", "_scale")
    )


def l2_normalize(df: DataFrame, vec: str) -> DataFrame:
    """Divide vectors by their norm; norms below 1e-8 count as 1."""
    v = V.as_double(F.col(vec))
    return df.withColumn(vec, V.unit(v, tiny=1e-8))


# --- windows ----------------------------------------------------------------------------------


def windows(
    df: DataFrame, cols: Sequence[str], length: int, overlap: int = 0, mode: str = "pad", key=KEY, order=ORDER,
) -> DataFrame:
    """Fixed-length windows of each video as arrays with a validity mask.

    ``drop`` keeps only full windows; ``tail`` pads short videos and adds a last window ending at
    the video's end when its length is no multiple of the step; ``pad`` starts windows until the
    video is covered and pads the last. Rows are copied into the windows holding them, and a window
    gathers at most ``length`` rows.
    """
    keys = blocks.as_list(key)
    step = length - overlap
    counts = df.groupBy(*keys).agg((F.max(order) + 1).alias("original_length"))
    rows = blocks.join_per_key(df.select(*keys, order, *cols), counts, key, order)
    p, n = F.col(order), F.col("original_length")

    full = F.when(n >= length, blocks.int_div(n - length, step) + 1).otherwise(F.lit(0))
    if mode == "drop":
        regular = full
    elif mode == "tail":
        regular = F.when(n < length, F.lit(1)).otherwise(full)
    else:
        regular = F.when(n <= length, F.lit(1)).otherwise(blocks.int_div(n - length + step - 1, step) + 1)
    regular = regular.cast("bigint")
    has_tail = (n >= length) & (F.pmod(n, F.lit(step)) != 0) if mode == "tail" else F.lit(False)

    first = F.greatest(blocks.int_div(p - length + step, step), F.lit(0))
    last = F.least(blocks.int_div(p, step), regular - 1)
    places = F.when(
        first <= last,
        F.transform(F.sequence(first, last), lambda j: F.struct(j.alias("window_index"), (j * step).alias("window_start"))),
    ).otherwise(F.array().cast("array<struct<window_index:bigint,window_start:bigint>>"))
    tail = F.when(
        has_tail & (p >= n - length),
        F.array(F.struct(regular.alias("window_index"), (n - length).cast("bigint").alias("window_start"))),
    ).otherwise(F.array().cast("array<struct<window_index:bigint,window_start:bigint>>"))

    placed = rows.select(
        *keys, order, *cols, n, (regular + has_tail.cast("bigint")).alias("total_windows"),
        F.explode(F.concat(places, tail)).alias("w"),
    )
    item = F.struct(F.col(order).alias("o"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    gathered = placed.groupBy(*keys, "w", "original_length", "total_windows").agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    have = F.size("_rows")
    zero = F.array_repeat(F.array(*[F.lit(0.0) for _ in cols]), F.lit(length) - have)
    return gathered.select(
        *keys, "w.window_index", "w.window_start", (F.col("w.window_start") + have).alias("window_end"), "total_windows",
        "original_length", (F.lit(length) - have).cast("bigint").alias("padding_length"),
        F.concat(F.transform("_rows", lambda r: r["v"]), zero).alias("values"),
        F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= have).alias("mask"),
    )


def chunks_named(df: DataFrame, cols: Sequence[str], length: int = 1000, key=KEY, order=ORDER) -> DataFrame:
    """Consecutive chunks named ``{video}_chunk{i}`` (just ``{video}`` if single), padded to the longest chunk."""
    cut = windows(df, cols, length, 0, "pad", key, order)
    longest = cut.agg(F.max(F.lit(length) - F.col("padding_length"))).scalar()
    several = F.concat(F.col(key).cast("string"), F.lit("_chunk"), F.col("window_index").cast("string"))
    return (
        cut.withColumn("chunk_id", F.when(F.col("total_windows") > 1, several).otherwise(F.col(key).cast("string")))
        .withColumn("_longest", longest.cast("int"))
        .withColumns({"values": F.slice("values", F.lit(1), F.col("_longest")), "mask": F.slice("mask", F.lit(1), F.col("_longest"))})
        .withColumn("padding_length", F.size(F.filter("mask", lambda m: ~m)).cast("bigint"))
        .drop("_longest")
    )


def pad_batch(sequences: DataFrame, position: str, values: str, batch: int) -> DataFrame:
    """Pad each sequence to the longest of its batch; ``padding_mask`` is true on padding."""
    batched = sequences.withColumn("batch", blocks.int_div(position, batch)).withColumn("_n", F.size(values))
    longest = batched.groupBy("batch").agg(F.max("_n").alias("batch_length"))
    return (
        batched.join(longest, "batch")
        .withColumn(values, F.concat(F.col(values), F.array_repeat(F.lit(0.0), F.col("batch_length") - F.col("_n"))))
        .withColumn("padding_mask", F.transform(F.sequence(F.lit(1), F.col("batch_length")), lambda i: i > F.col("_n")))
        .drop("_n")
    )


def window_stats(cut: DataFrame, key=KEY) -> DataFrame:
    return cut.agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum((F.col("padding_length") > 0).cast("bigint")).alias("padded"),
        F.sum((F.col("total_windows") > 1).cast("bigint")).alias("segmented"),
        F.avg("original_length").alias("avg_original_length"),
        F.avg("padding_length").alias("avg_padding"),
        F.count_distinct(key).alias("videos"),
    )


# --- splits -----------------------------------------------------------------------------------


def _digest(seed: int, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]).cast("binary"))


def _bucket(digest: Column) -> Column:
    """The first three hex digits, an order-preserving block of the digest."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("bigint")


def group_split(df: DataFrame, key: str = KEY, train: float = 0.8, seed: int = 0, spread: str = ORDER) -> DataFrame:
    """Mark whole videos ``train`` or ``val``: a fixed share of keys in the order of a seeded hash."""
    keys = df.select(key).distinct().withColumn("_h", _digest(seed, key)).withColumn(blocks.BLOCK, _bucket(F.col("_h")))
    ranked = blocks.two_phase(
        keys, (), "_h", running={"_rank": ("count", F.lit(1))}, stats={"_n": ("count", F.lit(1))}, inclusive=False
    )
    split = ranked.select(key, F.when(F.col("_rank") < F.floor(F.col("_n") * F.lit(train)), "train").otherwise("val").alias("split"))
    return blocks.join_per_key(df, split, key, spread)


def _share_out(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one ``size`` each fold gets when every group goes to the lightest."""

    def upto(level: int) -> int:
        return sum((level - load) // size + 1 for load in loads if level >= load)

    low, high = min(loads), max(loads) + size * count
    while low < high:
        mid = (low + high) // 2
        if upto(mid) >= count:
            high = mid
        else:
            low = mid + 1
    given = [(low - 1 - load) // size + 1 if low - 1 >= load else 0 for load in loads]
    left = count - sum(given)
    for fold, load in enumerate(loads):
        if left and low >= load and (low - load) % size == 0:
            given[fold] += 1
            left -= 1
    return given


def group_kfold(df: DataFrame, key: str = KEY, folds: int = 5, seed: int = 0) -> DataFrame:
    """Fold of every video: largest first, each to the fold with the fewest rows so far.

    Videos of one size are interchangeable, so only the table of distinct sizes is walked in order
    (at most ``sqrt(2 * rows)`` entries). The videos of a size then take their fold by rank: the
    ``j``-th video of fold ``f`` brings that fold to ``load_f + j * size``, and counting how many
    such steps come earlier gives its rank directly.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    per_size = sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("videos"))
    plan_type = StructType([StructField("rows", LongType()), StructField("loads", ArrayType(LongType())), StructField("given", ArrayType(LongType()))])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        loads, steps = [0] * folds, []
        for size, count in pdf.sort_values("rows", ascending=False)[["rows", "videos"]].itertuples(index=False):
            given = _share_out(loads, int(size), int(count))
            steps.append((int(size), list(loads), given))
            loads = [load + int(size) * g for load, g in zip(loads, given, strict=True)]
        return pd.DataFrame(steps, columns=["rows", "loads", "given"])

    plan = per_size.groupBy(F.lit(0).alias("_all")).applyInPandas(walk, plan_type)
    seats = plan.select("rows", "loads", F.posexplode("given").alias("fold", "_g")).where(F.col("_g") > 0)
    seats = blocks.expand(seats, F.lit(0), F.col("_g"), "_j").drop("_g")
    reached = F.element_at("loads", F.col("fold") + 1) + F.col("_j") * F.col("rows")
    earlier = F.lit(0).cast("bigint")
    for g in range(folds):
        gap = reached - F.element_at("loads", F.lit(g + 1)) - F.when(F.col("fold") > g, 0).otherwise(1)
        steps_before = F.when(gap >= 0, blocks.int_div(gap, F.col("rows")) + 1).otherwise(0)
        earlier = earlier + F.when(F.col("fold") == g, F.col("_j")).otherwise(steps_before)
    seats = seats.select("rows", earlier.alias("_rank"), "fold")

    hashed = sizes.withColumn("_h", _digest(seed, key)).withColumn(blocks.BLOCK, _bucket(F.col("_h")))
    ranked = blocks.positions(hashed, "rows", "_h", blocks.BLOCK, "_rank")
    return ranked.join(seats, ["rows", "_rank"]).select(key, "rows", "fold")


def union_splits(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns missing from one are null there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


# --- augmentation -----------------------------------------------------------------------------


def uniform(seed: int, *parts: str | Column) -> Column:
    """A uniform number in [0, 1) that depends only on the row's identity.

    Recomputed tasks draw the same numbers, which ``rand`` does not promise.
    """
    return F.conv(F.substring(_digest(seed, *parts), 1, 12), 16, 10).cast("double") / float(16**12)


def _lengths(df: DataFrame, key, order) -> DataFrame:
    counts = df.groupBy(*blocks.as_list(key)).agg((F.max(order) + 1).alias("_n"))
    return blocks.join_per_key(df, counts, key, order)


def augment_shift(df: DataFrame, offset: Column | int, key=KEY, order=ORDER) -> DataFrame:
    """Rotate each video by one offset for all its columns."""
    k = offset if isinstance(offset, Column) else F.lit(offset)
    return _lengths(df, key, order).withColumn(order, F.pmod(F.col(order) + k, F.col("_n"))).drop("_n")


def shift_offset(seed: int, most: int = 5, key: str = KEY) -> Column:
    """One offset in ``[-most, most]`` per video."""
    return (F.floor(uniform(seed, F.lit("shift"), key) * (2 * most + 1)) - most).cast("bigint")


def augment_noise(
    df: DataFrame, cols: Sequence[str], seed: int, sigma: float = 0.01, low: float = 0.9, high: float = 1.1, chance: float = 0.5,
    key: str = KEY, order: str = ORDER,
) -> DataFrame:
    """Gaussian noise per value and one scale factor per video, each applied with ``chance``."""
    noisy = uniform(seed, F.lit("noise?"), key) < chance
    scaled = uniform(seed, F.lit("scale?"), key) < chance
    factor = F.when(scaled, low + (high - low) * uniform(seed, F.lit("scale"), key)).otherwise(1.0)

    def value(c: str) -> Column:
        u = F.greatest(uniform(seed, F.lit("r"), F.lit(c), key, order), F.lit(1e-12))
        angle = 2 * F.pi() * uniform(seed, F.lit("a"), F.lit(c), key, order)
        normal = F.sqrt(-2 * F.log(u)) * F.cos(angle)
        return (F.col(c) + F.when(noisy, sigma * normal).otherwise(0.0)) * factor

    return df.withColumns({c: value(c) for c in cols})


def augment_warp(df: DataFrame, factor: Column | float, key=KEY, order=ORDER) -> DataFrame:
    """Play each video at ``factor`` speed: row i repeats row ``floor(min(i * factor, n - 1))``."""
    keys = blocks.as_list(key)
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    played = _lengths(df.select(*keys, order), key, order).withColumn("_from", F.floor(F.col(order) * f).cast("bigint"))
    inside = played.where(F.col("_from") < F.col("_n")).select(*keys, F.col(order).alias("_i"), F.col("_from").alias(order))
    moved = inside.join(df, [*keys, order]).drop(order).withColumnRenamed("_i", order)
    # Beyond the end every row repeats the video's last one: one row per video, joined by salt.
    final = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_last"))
    beyond = played.where(F.col("_from") >= F.col("_n")).select(*keys, order)
    rest = [c for c in df.columns if c not in (*keys, order)]
    held = blocks.join_per_key(beyond, final, key, order).select(*keys, order, *[F.col(f"_last.{c}").alias(c) for c in rest])
    return moved.select(*df.columns).unionByName(held.select(*df.columns))
