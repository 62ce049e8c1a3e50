"""Score smoothing by name: moving average, Savitzky-Golay, exponential."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framewise.operators.intervals import interval_join
from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks


def _weighted(df: DataFrame, col: str, weights: list[float], key, order, out: str) -> DataFrame:
    """Weighted sum over a centred window; missing rows repeat the video's edge value."""
    half = len(weights) // 2
    value = F.col(col)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        head, tail = F.first(value).over(whole), F.last(value).over(whole)
        parts: list[Column] = []
        for offset, weight in zip(range(-half, half + 1), weights, strict=True):
            if offset < 0:
                term = F.coalesce(F.lag(value, -offset).over(w), head)
            elif offset > 0:
                term = F.coalesce(F.lead(value, offset).over(w), tail)
            else:
                term = value
            parts.append(term * F.lit(float(weight)))
        smooth = parts[0]
        for part in parts[1:]:
            smooth = smooth + part
        # A video shorter than the window lies wholly inside block 0.
        short = (F.col(blocks.BLOCK) == 0) & (F.count(F.lit(1)).over(whole) < len(weights))
        return d.withColumn(out, F.when(short, value).otherwise(smooth))

    return blocks.neighbourhood(df, key, order, len(weights), len(weights), build)


def moving_average(df: DataFrame, col: str, window: int = 5, key=KEY, order=ORDER, out: str = "smoothed") -> DataFrame:
    window += 1 - window % 2
    return _weighted(df, col, [1.0 / window] * window, key, order, out)


def savgol_weights(window: int, degree: int) -> list[float]:
    """Centre-point weights of the least-squares polynomial fit."""
    window += 1 - window % 2
    degree = min(degree, window - 1)
    offsets = np.arange(window) - window // 2
    return [float(w) for w in np.linalg.pinv(np.vander(offsets, degree + 1, increasing=True))[0]]


def savgol(
    df: DataFrame, col: str, window: int = 5, degree: int = 2, key=KEY, order=ORDER, out: str = "smoothed"
) -> DataFrame:
    return _weighted(df, col, savgol_weights(window, degree), key, order, out)


def zero_padded_average(df: DataFrame, col: str, window: int = 5, key=KEY, order=ORDER, out: str = "smoothed") -> DataFrame:
    """Window sum over the rows that exist, divided by the full window length."""
    half = window // 2

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn(out, F.sum(col).over(w.rowsBetween(-half, window - 1 - half)) / window)

    return blocks.neighbourhood(df, key, order, window, window, build)


def exponential(
    df: DataFrame, col: str, alpha: float | None = 0.3, window: int | None = None, key=KEY, order=ORDER,
    out: str = "smoothed",
) -> DataFrame:
    """``y = alpha * x + (1 - alpha) * previous y``, starting at the first value.

    Within a block the recurrence is a running sum of values weighted by ``(1 - alpha) ** -i``.
    Over a whole block the weight of older finite values falls to 1e-40, below what a double can see, so
    one value from the previous block completes every row; a NaN or infinity lasts to the end.
    """
    if alpha is None:
        alpha = 2.0 / (window + 1)
    if alpha >= 1:
        return df.withColumn(out, F.col(col))
    keep = 1.0 - alpha
    width = max(2, math.ceil(40 * math.log(10) / -math.log(keep)))
    blocked = blocks.with_block(df, order, width)
    i = F.col(order) - F.col(blocks.BLOCK) * width
    gain = F.when(F.col(order) == 0, 1.0).otherwise(alpha)
    term = F.col(col) * gain * F.pow(F.lit(keep), -i)

    keys = blocks.as_list(key)
    so_far = Window.partitionBy(*keys, blocks.BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    left = blocked.withColumn("_local", F.sum(term).over(so_far) * F.pow(F.lit(keep), i))
    handed_on = (
        blocked.groupBy(*keys, blocks.BLOCK)
        .agg((F.sum(term) * F.lit(keep ** (width - 1))).alias("_in"))
        .withColumn(blocks.BLOCK, F.col(blocks.BLOCK) + 1)
    )
    finite = F.abs(F.col("_in")) < float("inf")
    earlier = Window.partitionBy(*keys).orderBy(blocks.BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    lasting = F.coalesce(F.sum(F.when(~finite, F.col("_in"))).over(earlier), F.lit(0.0))
    # One row per block; the last block is handed on to one that does not exist, which the join below drops.
    handed_on = handed_on.withColumn("_in", F.when(finite, F.col("_in")).otherwise(F.lit(0.0)) + lasting)
    return (
        blocks.join_null_safe(left, handed_on, [*keys, blocks.BLOCK], "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_in") * F.pow(F.lit(keep), i + 1), F.lit(0.0)))
        .select(*df.columns, out)
    )


METHODS: dict[str, Callable[..., DataFrame]] = {
    "ma": moving_average,
    "savgol": savgol,
    "ema": exponential,
    "zero_ma": zero_padded_average,
}


def register(name: str, method: Callable[..., DataFrame]) -> None:
    """Add a smoothing method under ``name``."""
    METHODS[name] = method


def smooth(df: DataFrame, col: str, method: str = "savgol", **options) -> DataFrame:
    """Smooth ``col`` with the named method; an unknown name means the moving average."""
    return METHODS.get(method, moving_average)(df, col, **options)


def smooth_segments(
    segments: DataFrame, frames: DataFrame, params: list[str], method: str = "savgol", window: int = 5, key=KEY,
    order=ORDER,
) -> DataFrame:
    """Smooth each parameter inside its (inclusive) segment, then average it over the segment.

    Segments shorter than the window are averaged as they are.
    """
    keys = blocks.as_list(key)
    half_open = segments.select(*keys, "first_frame", (F.col("last_frame") + 1).alias("_stop"))
    inside = interval_join(frames.select(*keys, order, *params), half_open, keys, order, "first_frame", "_stop")
    inside = inside.withColumn("_pos", F.col(order) - F.col("first_frame"))
    for p in params:
        inside = smooth(inside, p, method, window=window, key=[*keys, "first_frame"], order="_pos", out=f"_s_{p}")
    return inside.groupBy(*keys, "first_frame", (F.col("_stop") - 1).alias("last_frame")).agg(
        *[F.avg(f"_s_{p}").alias(p) for p in params]
    )
