"""Windowed features over frame tables keyed by video and dense position.

Bounded frames use ``blocks.neighbourhood`` (one shuffle on video and block); running and whole-key
values use ``blocks.two_phase``. No operator partitions a window by the bare video id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framewise.functions import vectors as V
from framewise.plans import blocks

KEY, ORDER = "video_id", "frame_idx"


def centred_frame(w: WindowSpec, size: int) -> WindowSpec:
    """The frame of a centred moving window that shrinks at the edges."""
    return w.rowsBetween(-(size // 2), (size - 1) // 2)


def zero_if_null(c: Column, zero=0.0) -> Column:
    return F.coalesce(c, F.lit(zero))


def lagged(df: DataFrame, key, order, build, before: int = 1, after: int = 0) -> DataFrame:
    """Add ``build(w)`` columns next to the existing ones."""
    return blocks.neighbourhood(df, key, order, before, after, lambda d, w: d.select("*", *build(w)))


# Frames of up to this many rows are recomputed for every row; longer ones are differences of running sums.
SHORT_FRAME = 8
# Rows of a block of running sums: fewer lose less to cancellation.
SUM_ROWS = 4096
_NAN, _POSITIVE = 1 << 42, 1 << 21


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


# Column expressions as text: one parsed text costs far less to build than its twenty calls.
def _gained(cols: Sequence[str], size: int) -> Column:
    """What the running sums of every column gained from before the frame to its end."""

    def parts(c: str) -> str:
        end, before = f"coalesce(_end{size}, _all).`{c}`", f"_before{size}.`{c}`"
        gained = [f"'{k}', {end}.{k} - coalesce({before}.{k}, 0)" for k in ("s", "q", "n", "odd")]
        return f"named_struct({', '.join(gained)}, 'new', {end}.new - coalesce({before}.new, 0) - {end}.own)"

    return F.expr(f"""named_struct({', '.join(f"'{c}', {parts(c)}" for c in cols)})""")


def _mean(c: str, size: int) -> Column:
    f = f"_f{size}.`{c}`"
    return F.expr(
        f"CASE WHEN {f}.odd > 0 THEN CASE WHEN {f}.odd >= {_NAN} OR ({f}.odd >= {_POSITIVE} AND {f}.odd % {_POSITIVE} > 0) THEN double('NaN') "
        f"WHEN {f}.odd >= {_POSITIVE} THEN double('Infinity') ELSE double('-Infinity') END WHEN {f}.n > 0 THEN (`_mid_{c}` * {f}.n + {f}.s) / {f}.n END"
    )


def _deviation(c: str, size: int) -> Column:
    f = f"_f{size}.`{c}`"
    return F.expr(
        f"CASE WHEN {f}.odd > 0 THEN double('NaN') WHEN {f}.n < 2 OR {f}.new = 0 THEN 0D "
        f"ELSE sqrt(greatest(({f}.q - {f}.s * {f}.s / {f}.n) / ({f}.n - 1), 0D)) END"
    )


def with_sums(d: DataFrame, w: WindowSpec, cols: Sequence[str], means: Sequence[int], deviations: Sequence[int]) -> tuple[DataFrame, list[Column], list[str]]:
    """Moving means and deviations of every column: the rows they are computed from, the columns, and what to drop.

    Frames of any width are two lookups in running sums over the block. Values are centred at a round number near the
    block's mean (whole numbers stay whole), NaN and infinities are counted rather than added, and a frame of equal
    rows has no deviation, whatever the sums have lost. The sums of all columns travel as one value.
    """
    short = {
        **{f"{c}_ma{n}": F.avg(c).over(centred_frame(w, n)) for c in cols for n in means if n <= SHORT_FRAME},
        **{f"{c}_std{n}": zero_if_null(F.stddev_samp(c).over(centred_frame(w, n))) for c in cols for n in deviations if n <= SHORT_FRAME},
    }
    sizes = sorted({n for n in [*means, *deviations] if n > SHORT_FRAME})
    spare: list[str] = []
    if sizes:
        whole, upto = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
        x = {c: F.col(c).cast("double") for c in cols}
        d = d.select(
            "*",
            *[F.avg(F.when(_finite(x[c]), x[c])).over(whole).alias(f"_avg_{c}") for c in cols],
            *[F.stddev_pop(F.when(_finite(x[c]), x[c])).over(whole).alias(f"_dev_{c}") for c in cols],
            *[F.lead(x[c]).over(w).alias(f"_lead_{c}") for c in cols],
        )
        unit = {c: F.when(F.col(f"_dev_{c}") > 0, F.pow(F.lit(2.0), F.floor(F.log2(f"_dev_{c}")))) for c in cols}
        mid = {c: F.coalesce(F.rint(F.col(f"_avg_{c}") / unit[c]) * unit[c], F.col(f"_avg_{c}"), F.lit(0.0)) for c in cols}
        d = d.withColumns({f"_mid_{c}": mid[c] for c in cols} | {f"_new_{c}": (~x[c].eqNullSafe(F.col(f"_lead_{c}"))).cast("bigint") for c in cols})
        d = d.withColumns({f"_y_{c}": F.when(_finite(x[c]), x[c] - F.col(f"_mid_{c}")).otherwise(0.0) for c in cols})

        def sums(c: str) -> Column:
            odd = F.when(F.isnan(x[c]), _NAN).when(x[c] == float("inf"), _POSITIVE).when(x[c] == float("-inf"), 1).otherwise(0).cast("bigint")
            y, new = F.col(f"_y_{c}"), F.col(f"_new_{c}")
            parts = {"s": y, "q": y * y, "n": _finite(x[c]).cast("bigint"), "odd": odd, "new": new}
            return F.struct(*[F.sum(v).over(upto).alias(k) for k, v in parts.items()], new.alias("own")).alias(c)

        d = d.withColumn("_at", F.struct(*[sums(c) for c in cols]))
        looked = {"_all": F.last("_at").over(whole)}
        looked |= {f"_end{n}": F.lead("_at", (n - 1) // 2).over(w) for n in sizes} | {f"_before{n}": F.lag("_at", n // 2 + 1).over(w) for n in sizes}
        d = d.withColumns(looked).withColumns({f"_f{n}": _gained(cols, n) for n in sizes})
        spare = ["_at", *looked, *[f"_f{n}" for n in sizes], *[f"{p}{c}" for c in cols for p in ("_avg_", "_dev_", "_lead_", "_mid_", "_new_", "_y_")]]
    d = d.withColumns(short) if short else d
    new = [_mean(c, n).alias(f"{c}_ma{n}") for c in cols for n in means if n > SHORT_FRAME]
    new += [_deviation(c, n).alias(f"{c}_std{n}") for c in cols for n in deviations if n > SHORT_FRAME]
    return d, new, spare


def _rolling(df: DataFrame, cols: Sequence[str], means: Sequence[int], deviations: Sequence[int], key, order) -> DataFrame:
    reach = max(*means, *deviations, 1) // 2 + 1

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d, new, spare = with_sums(d, w, cols, means, deviations)
        return d.select("*", *new).drop(*spare)

    return blocks.neighbourhood(df, key, order, reach, reach, build, max(min(blocks.ROWS_PER_BLOCK, SUM_ROWS), 1))


def rolling_mean(df: DataFrame, cols: Sequence[str], windows: Sequence[int], key=KEY, order=ORDER) -> DataFrame:
    return _rolling(df, cols, windows, (), key, order)


def rolling_std(df: DataFrame, cols: Sequence[str], windows: Sequence[int], key=KEY, order=ORDER) -> DataFrame:
    return _rolling(df, cols, (), windows, key, order)


def diffs(df: DataFrame, cols: Sequence[str], lags: Sequence[int], key=KEY, order=ORDER) -> DataFrame:
    return lagged(
        df, key, order,
        lambda w: [zero_if_null(F.col(c) - F.lag(c, n).over(w)).alias(f"{c}_diff{n}") for c in cols for n in lags],
        max(lags), 0,
    )


def cut_timing(df: DataFrame, time: str, key=KEY, order=ORDER) -> DataFrame:
    """Distance to the neighbouring cuts and relative position in the video."""
    t = F.col(time)
    near = lagged(
        df, key, order,
        lambda w: [
            zero_if_null(t - F.lag(t).over(w)).alias("time_since_prev"),
            zero_if_null(F.lead(t).over(w) - t).alias("time_to_next"),
        ],
        1, 1,
    )
    ends = {"_t0": ("min", t), "_t1": ("max", t)}
    return (
        blocks.two_phase(blocks.with_block(near, order), key, order, stats=ends)
        .withColumns(
            {
                "cut_duration": (F.col("time_since_prev") + F.col("time_to_next")) / 2,
                "position_in_video": (t - F.col("_t0")) / (F.col("_t1") - F.col("_t0") + 1e-6),
            }
        )
        .drop("_t0", "_t1", blocks.BLOCK)
    )


def density(df: DataFrame, axis: str, radius: int, key=KEY) -> DataFrame:
    """Rows within ``radius`` axis units of each row, relative to the video's densest row.

    Counted as the difference of two running counts, at ``axis + radius`` and before
    ``axis - radius``, so the cost does not grow with the number of rows in reach.
    """
    keys = blocks.as_list(key)
    times = df.groupBy(*keys, axis).agg(F.count(F.lit(1)).alias("_n"))

    def point(offset: int, side: int, rows: Column, sign: int) -> Column:
        # At equal positions: lower bounds, then rows, then upper bounds.
        return F.struct(
            (F.col(axis) + offset).alias("pos"), F.lit(side).alias("side"), rows.alias("n"), F.lit(sign).alias("sign")
        )

    none = F.lit(0).cast("bigint")
    points = times.select(
        *keys, axis,
        F.inline(F.array(point(-radius, 0, none, -1), point(0, 1, F.col("_n"), 0), point(radius, 2, none, 1))),
    ).withColumn(blocks.BLOCK, blocks.int_div("pos", max(4 * radius, 1)))
    counted = blocks.two_phase(points, keys, ["pos", "side", axis], running={"_upto": ("sum", F.col("n"))})
    near = counted.groupBy(*keys, axis).agg(F.sum(F.col("sign") * F.col("_upto")).alias("neighbours"))
    peaks = near.groupBy(*keys).agg(F.max("neighbours").alias("_peak"))
    rated = blocks.join_per_key(near, peaks, key, axis).select(
        *keys, axis, "neighbours", (F.col("neighbours") / F.col("_peak")).alias("density")
    )
    return blocks.join_null_safe(df, rated, [*keys, axis])


def _cosine(a: Column, na: Column, b: Column, nb: Column, eps: float) -> Column:
    if eps:
        return zero_if_null(V.dot(a, b) / (na * nb + eps))
    return F.when((na > 0) & (nb > 0), V.dot(a, b) / (na * nb)).otherwise(0.0)


def sim_neighbours(df: DataFrame, vec: str, key=KEY, order=ORDER, eps: float = 0.0) -> DataFrame:
    """Cosine with the previous and next row; 0 at the edges and for zero vectors."""
    v, n = F.col("_v"), F.col("_n")
    ready = df.withColumn("_v", V.as_double(F.col(vec))).withColumn("_n", V.norm(v))

    def build(w: WindowSpec) -> list[Column]:
        return [
            _cosine(v, n, step(v).over(w), step(n).over(w), eps).alias(name)
            for name, step in (("sim_prev", F.lag), ("sim_next", F.lead))
        ]

    return lagged(ready, key, order, build, 1, 1).drop("_v", "_n")


def sim_local(df: DataFrame, vec: str, radius: int = 2, drop_identical: bool = True, key=KEY, order=ORDER) -> DataFrame:
    """Mean cosine with the ``radius`` rows on each side.

    ``drop_identical`` leaves out similarities of at least 0.9999 (self and duplicates); otherwise
    only the row itself is left out.
    """
    v, n = F.col("_v"), F.col("_n")
    ready = df.withColumn("_v", V.as_double(F.col(vec))).withColumn("_n", V.norm(v))
    offsets = [o for o in range(-radius, radius + 1) if o]

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        sims = [
            F.when(F.lag(n, o).over(w).isNotNull(), _cosine(v, n, F.lag(v, o).over(w), F.lag(n, o).over(w), 0.0))
            for o in offsets
        ]
        keep = (lambda s: s < 0.9999) if drop_identical else (lambda s: s.isNotNull())
        kept = F.filter(F.col("_sims"), lambda s: s.isNotNull() & keep(s))
        return (
            d.select("*", F.array(*sims).alias("_sims"))
            .withColumn("_kept", kept)
            .withColumn("sim_mean5", F.when(F.size("_kept") > 0, V.total(F.col("_kept")) / F.size("_kept")).otherwise(0.0))
            .drop("_sims", "_kept")
        )

    return blocks.neighbourhood(ready, key, order, radius, radius, build).drop("_v", "_n")


def change_score(df: DataFrame, col: str, smooth: int = 3, key=KEY, order=ORDER) -> DataFrame:
    """Absolute first difference, then a centred mean."""
    reach = smooth // 2

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        # The copy at the far edge of the halo has no predecessor of its own, so reach one further.
        stepped = d.withColumn("_step", zero_if_null(F.abs(F.col(col) - F.lag(col).over(w))))
        return stepped.withColumn(f"{col}_change", F.avg("_step").over(centred_frame(w, smooth))).drop("_step")

    return blocks.neighbourhood(df, key, order, reach + 1, reach, build)


def transitions(df: DataFrame, flag: str, key=KEY, order=ORDER) -> DataFrame:
    """Rising and falling edges of a 0/1 column."""

    def build(w: WindowSpec) -> list[Column]:
        step = F.coalesce(F.col(flag) - F.lag(flag).over(w), F.lit(0))
        return [(step > 0).cast("int").alias("rising"), (step < 0).cast("int").alias("falling")]

    return lagged(df, key, order, build)


def value_change(df: DataFrame, col: str, key=KEY, order=ORDER) -> DataFrame:
    """1 where the value differs from the previous row; the first row counts as a change."""
    return lagged(
        df, key, order,
        lambda w: [F.coalesce(F.col(col) != F.lag(col).over(w), F.lit(True)).cast("int").alias(f"{col}_changed")],
    )


def abs_diff(df: DataFrame, cols: Sequence[str], key=KEY, order=ORDER) -> DataFrame:
    return lagged(
        df, key, order,
        lambda w: [zero_if_null(F.abs(F.col(c) - F.lag(c).over(w)).cast("double")).alias(f"{c}_abs_diff") for c in cols],
    )


def movement(df: DataFrame, x: str, y: str, key=KEY, order=ORDER) -> DataFrame:
    return lagged(
        df, key, order,
        lambda w: [
            zero_if_null(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))).alias("movement")
        ],
    )


def cumulative(df: DataFrame, col: str, key=KEY, order=ORDER) -> DataFrame:
    """Relative position and expanding mean of ``col``."""
    done = blocks.two_phase(
        blocks.with_block(df, order), key, order,
        running={"_sum": ("sum", F.col(col)), "_rows": ("count", F.lit(1))},
        stats={"_n": ("count", F.lit(1))},
    )
    return done.withColumns(
        {"position": F.col(order) / F.col("_n"), f"{col}_cum_mean": F.col("_sum") / F.col("_rows")}
    ).drop("_sum", "_rows", "_n", blocks.BLOCK)


def silence_timer(df: DataFrame, flag: str, step: int = 100, key=KEY, order=ORDER) -> DataFrame:
    """Milliseconds of unbroken silence up to and including each row; 0 while ``flag`` is set."""
    spoken = F.when(F.col(flag) == 1, F.col(order))
    done = blocks.two_phase(
        blocks.with_block(df, order), key, order, running={"_spoke": ("max", spoken)}
    )
    # A leading silence counts from position 0.
    quiet = F.col(order) - F.coalesce(F.col("_spoke"), F.lit(-1))
    return done.withColumn("silence_duration_ms", (quiet * step).cast("bigint")).drop("_spoke", blocks.BLOCK)


def nonzero_std(df: DataFrame, col: str, radius: int = 5, key=KEY, order=ORDER) -> DataFrame:
    positive = F.when(F.col(col) > 0, F.col(col))
    return lagged(
        df, key, order,
        lambda w: [zero_if_null(F.stddev_pop(positive).over(w.rowsBetween(-radius, radius))).alias(f"{col}_std")],
        radius, radius,
    )


def frame_energy(samples: DataFrame, amplitude: str, hop: int, key=KEY, order=ORDER, loud: float = 0.01) -> DataFrame:
    """Root mean square per hop of samples."""
    return (
        samples.groupBy(key, blocks.int_div(order, hop).alias("hop"))
        .agg(F.sqrt(F.avg(F.col(amplitude) * F.col(amplitude))).alias("rms"))
        .withColumn("is_speaking", (F.col("rms") > loud).cast("int"))
    )


def zero_cross_rate(samples: DataFrame, amplitude: str, hop: int, key=KEY, order=ORDER) -> DataFrame:
    """Share of sign changes per hop of samples."""

    def build(w: WindowSpec) -> list[Column]:
        flip = (F.col(amplitude) < 0) != (F.lag(amplitude).over(w) < 0)
        return [F.coalesce(flip, F.lit(False)).cast("int").alias("_flip")]

    return (
        lagged(samples, key, order, build)
        .groupBy(key, blocks.int_div(order, hop).alias("hop"))
        .agg((F.sum("_flip") / F.count(F.lit(1))).alias("zcr"))
    )


def vector_change(df: DataFrame, vec: str, key=KEY, order=ORDER) -> DataFrame:
    """``max(0, 1 - correlation)`` with the previous row's vector; 0 on the first row."""
    ready = df.withColumn("_c", V.centred(V.as_double(F.col(vec)))).withColumn("_n", V.norm(F.col("_c")))

    def build(w: WindowSpec) -> list[Column]:
        c, n = F.col("_c"), F.col("_n")
        before, scale = F.lag(c).over(w), n * F.lag(n).over(w)
        corr = F.when(scale > 0, V.dot(c, before) / scale).otherwise(1.0)
        return [F.when(scale.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - corr)).alias("vector_change")]

    return lagged(ready, key, order, build).drop("_c", "_n")


def _hop_windows(df: DataFrame, pitch: str, energy: str, time: str, size: int, key, order) -> DataFrame:
    """Statistics of forward windows of ``size`` rows starting every ``size / 2`` rows."""
    hop = size // 2
    voiced = F.when(F.col(pitch) > 0, F.col(pitch))

    def build(w: WindowSpec) -> list[Column]:
        ahead = w.rowsBetween(0, size - 1)
        return [
            F.count(voiced).over(ahead).alias("_voiced"),
            F.avg(voiced).over(ahead).alias("pitch_mean"),
            F.stddev_pop(voiced).over(ahead).alias("pitch_std"),
            F.avg(energy).over(ahead).alias("_energy"),
            F.lead(time, size).over(w).alias("end_time"),
        ]

    windows = (
        lagged(df, key, order, build, 0, size)
        .where((F.pmod(F.col(order), F.lit(hop)) == 0) & F.col("end_time").isNotNull() & (F.col("_voiced") >= hop))
        .select(key, order, F.col(time).alias("start_time"), "end_time", "pitch_mean", "pitch_std", "_energy")
    )
    peaks = df.groupBy(key).agg(F.max(energy).alias("_peak"))
    return (
        blocks.join_per_key(windows, peaks, key, order)
        .withColumn("mean_energy", F.col("_energy") / (F.col("_peak") + 1e-8))
        .drop("_energy", "_peak")
    )


def detect_bursts(
    df: DataFrame, pitch: str, energy: str, time: str, units_per_second: float = 1.0, size: int = 20,
    min_std: float = 50.0, min_energy: float = 0.3, min_confidence: float = 0.6, key=KEY, order=ORDER,
) -> DataFrame:
    """Windows of strongly varying pitch and high energy, labelled by their length."""
    seconds = (F.col("end_time") - F.col("start_time")) / units_per_second
    level = (F.col("pitch_std") / min_std + F.col("mean_energy") / min_energy) / 2
    return (
        _hop_windows(df, pitch, energy, time, size, key, order)
        .where((F.col("pitch_std") > min_std) & (F.col("mean_energy") > min_energy))
        .withColumn("confidence", F.least(F.lit(1.0), level))
        .where(F.col("confidence") >= min_confidence)
        .withColumn("text", F.when(seconds < 1, "w").when(seconds < 2, "www").otherwise("wwww"))
    )


def detect_low(
    df: DataFrame, pitch: str, energy: str, time: str, size: int = 40, max_pitch: float = 150.0,
    max_energy: float = 0.1, min_confidence: float = 0.6, key=KEY, order=ORDER,
) -> DataFrame:
    """Windows of low pitch and low energy."""
    level = (2 - F.col("pitch_mean") / max_pitch - F.col("mean_energy") / max_energy) / 2
    return (
        _hop_windows(df, pitch, energy, time, size, key, order)
        .where((F.col("pitch_mean") < max_pitch) & (F.col("mean_energy") < max_energy))
        .withColumn("confidence", F.least(F.lit(1.0), level))
        .where(F.col("confidence") >= min_confidence)
    )


def detect_jumps(
    df: DataFrame, pitch: str, time: str, length, min_delta: float = 100.0, min_confidence: float = 0.6,
    key=KEY, order=ORDER,
) -> DataFrame:
    """Rows whose pitch jumps up from the previous voiced row."""

    def build(w: WindowSpec) -> list[Column]:
        return [F.lag(pitch).over(w).alias("_before"), F.lag(time).over(w).alias("start_time")]

    jumps = (
        lagged(df, key, order, build)
        .where((F.col(pitch) > 0) & (F.col("_before") > 0) & (F.col(pitch) - F.col("_before") > min_delta))
        .withColumn("confidence", F.least(F.lit(1.0), (F.col(pitch) - F.col("_before")) / min_delta))
        .where(F.col("confidence") >= min_confidence)
        .select(key, order, "start_time", time, "confidence")
    )
    ends = df.groupBy(key).agg(F.max(time).alias("_last"))
    return blocks.join_per_key(jumps, ends, key, order).select(
        key, order, "start_time", F.least(F.col(time) + length, F.col("_last")).alias("end_time"), "confidence"
    )


def running_best(history: DataFrame, metric: str, fold: str = "fold", epoch: str = "epoch") -> DataFrame:
    """Best metric so far; a history holds one row per fold and epoch."""
    w = Window.partitionBy(fold).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best_so_far", F.max(metric).over(w))


def total_variation(df: DataFrame, col: str, key=KEY, order=ORDER) -> DataFrame:
    return (
        lagged(df, key, order, lambda w: [F.abs(F.col(col) - F.lag(col).over(w)).alias("_step")])
        .groupBy(key)
        .agg(zero_if_null(F.avg("_step")).alias("total_variation"))
    )


def local_variance(df: DataFrame, col: str, size: int = 5, key=KEY, order=ORDER) -> DataFrame:
    """Mean sample variance over all complete windows of ``size`` rows."""

    def build(w: WindowSpec) -> list[Column]:
        back = w.rowsBetween(-(size - 1), 0)
        return [F.when(F.col(order) >= size - 1, F.var_samp(col).over(back)).alias("_var")]

    return (
        lagged(df, key, order, build, size - 1, 0)
        .groupBy(key)
        .agg(zero_if_null(F.avg("_var")).alias("local_variance"))
    )


# The enrichment's windows and lags.
MEAN_WINDOWS, STD_WINDOWS, LAGS = (5, 10, 30, 60, 120), (5, 30, 120), (1, 2, 30)


def _temporal(cols: Sequence[str], flag: str | None, order: str):
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        steps = {f"_step_{c}": zero_if_null(F.abs(F.col(c) - F.lag(c).over(w))) for c in cols}
        d, new, spare = with_sums(d.withColumns(steps), w, cols, MEAN_WINDOWS, STD_WINDOWS)
        for c in cols:
            new += [zero_if_null(F.col(c) - F.lag(c, n).over(w)).alias(f"{c}_diff{n}") for n in LAGS]
            new.append(F.avg(f"_step_{c}").over(centred_frame(w, 3)).alias(f"{c}_change"))
        if flag:
            edge = F.coalesce(F.col(flag) - F.lag(flag).over(w), F.lit(0))
            new += [(edge > 0).cast("int").alias("rising"), (edge < 0).cast("int").alias("falling")]
        return d.select("*", *new).drop(*steps, *spare)

    return build


#: Rows before and after that the frames of the enrichment reach.
REACH_BEFORE, REACH_AFTER = max(max(MEAN_WINDOWS) // 2, max(LAGS)) + 1, max(MEAN_WINDOWS) // 2 + 1


def _bounded(df: DataFrame, build, key, order) -> DataFrame:
    return blocks.neighbourhood(df, key, order, REACH_BEFORE, REACH_AFTER, build, max(min(blocks.ROWS_PER_BLOCK, SUM_ROWS), 1))


def temporal_features(df: DataFrame, cols: Sequence[str], flag: str | None = None, key=KEY, order=ORDER) -> DataFrame:
    """Moving means and deviations, lag differences, change scores and edges in one pass.

    All frames share one window per block, so the enrichment costs one shuffle and one sort.
    """
    return _bounded(df, _temporal(cols, flag, order), key, order)


def enrich(
    df: DataFrame, cols: Sequence[str], time: str, vec: str, flag: str, changes: Sequence[str], place: tuple[str, str], radius: int,
    axis: str, key=KEY, order=ORDER,
) -> DataFrame:
    """The whole enrichment of a frame table.

    Statistics of ``cols``, cut timing along ``time``, similarity of ``vec`` to its neighbours, differences of ``changes``, the
    movement of ``place`` and the cumulative share of ``flag``: one shuffle for all bounded frames, one for all running
    values; and the density of rows within ``radius`` units of the integer ``axis``.
    """
    t, v, n = F.col(time), F.col("_v"), F.col("_n")
    x, y = (F.col(c) for c in place)
    statistics = _temporal(cols, flag, order)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_v", V.as_double(F.col(vec))).withColumn("_n", V.norm(F.col("_v")))
        last_x, last_y = (F.lag(c).over(w) for c in (x, y))
        return statistics(d, w).select(
            "*", zero_if_null(t - F.lag(t).over(w)).alias("time_since_prev"), zero_if_null(F.lead(t).over(w) - t).alias("time_to_next"),
            *[_cosine(v, n, step(v).over(w), step(n).over(w), 0.0).alias(name) for name, step in (("sim_prev", F.lag), ("sim_next", F.lead))],
            *[zero_if_null(F.abs(F.col(c) - F.lag(c).over(w)).cast("double")).alias(f"{c}_abs_diff") for c in changes],
            zero_if_null(F.hypot(x - last_x, y - last_y)).alias("movement"),
        ).drop("_v", "_n")

    near = blocks.with_block(_bounded(df, build, key, order), order)
    done = blocks.two_phase(
        near, key, order, running={"_sum": ("sum", F.col(flag)), "_rows": ("count", F.lit(1))},
        stats={"_all": ("count", F.lit(1)), "_t0": ("min", t), "_t1": ("max", t)},
    ).withColumns(
        {
            "cut_duration": (F.col("time_since_prev") + F.col("time_to_next")) / 2,
            "position_in_video": (t - F.col("_t0")) / (F.col("_t1") - F.col("_t0") + 1e-6),
            "position": F.col(order) / F.col("_all"), f"{flag}_cum_mean": F.col("_sum") / F.col("_rows"),
        }
    )
    return density(done.drop("_sum", "_rows", "_all", "_t0", "_t1", blocks.BLOCK), axis, radius, key)
