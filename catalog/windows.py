"""Windowed features and smoothing over frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import FRAMES, LONG, frames, long_frames, table
from catalog.registry import query
from catalog.shape import big, out, q6
from framewise.operators import smoothing as S
from framewise.operators import windows as W

OVER = "OVER (PARTITION BY video_id ORDER BY frame_idx)"


def over(lo: int, hi: int) -> str:
    def bound(n: int, side: str) -> str:
        return "CURRENT ROW" if n == 0 else f"{n} {side}"

    return (
        f"OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN {bound(lo, 'PRECEDING')} AND {bound(hi, 'FOLLOWING')})"
    )


def centred(n: int) -> str:
    return over(n // 2, (n - 1) // 2)


def per_frame(*cols: str, src: str = FRAMES, extra: str = "", frm: str = "frames") -> str:
    return f"WITH {src}{extra} SELECT video_id, frame_idx, {', '.join(cols)} FROM {frm}"


KEYS = "video_id frame_idx"
MEAN_COLS, MEAN_WINDOWS = ["energy", "motion"], [3, 5, 10, 30, 60, 120]
STD_WINDOWS = [5, 30, 120]

# Means are compared as sums over counts of hundredths, so that both engines divide equal integers.


@query(
    "roll_mean",
    per_frame(*[q6(f"avg({c}) {centred(n)}", f"{c}_ma{n}") for c in MEAN_COLS for n in MEAN_WINDOWS],
              extra=", cents AS (SELECT video_id, frame_idx, round(energy*100) AS energy, motion FROM frames)", frm="cents"),
)
def roll_mean(spark, sf):
    f = frames(spark, sf).withColumn("energy", F.round(F.col("energy") * 100))
    done = W.rolling_mean(f, MEAN_COLS, MEAN_WINDOWS)
    return out(done, KEYS, floats=" ".join(f"{c}_ma{n}" for c in MEAN_COLS for n in MEAN_WINDOWS))


@query(
    "roll_std",
    per_frame(*[q6(f"coalesce(stddev_samp({c}) {centred(n)}, 0)", f"{c}_std{n}") for c in MEAN_COLS for n in STD_WINDOWS]),
)
def roll_std(spark, sf):
    done = W.rolling_std(frames(spark, sf), MEAN_COLS, STD_WINDOWS)
    return out(done, KEYS, floats=" ".join(f"{c}_std{n}" for c in MEAN_COLS for n in STD_WINDOWS))


@query(
    "diff_lag",
    per_frame(*[q6(f"coalesce({c} - lag({c}, {n}) {OVER}, 0)", f"{c}_diff{n}") for c in MEAN_COLS for n in (1, 2, 30)]),
)
def diff_lag(spark, sf):
    done = W.diffs(frames(spark, sf), MEAN_COLS, [1, 2, 30])
    return out(done, KEYS, floats=" ".join(f"{c}_diff{n}" for c in MEAN_COLS for n in (1, 2, 30)))


@query(
    "cut_timing",
    f"""WITH {FRAMES}, t AS (SELECT *, t_us/1e3 AS s FROM frames),
    n AS (SELECT *, coalesce(s - lag(s) {OVER}, 0) AS a, coalesce(lead(s) {OVER} - s, 0) AS b,
      min(s) OVER (PARTITION BY video_id) AS lo, max(s) OVER (PARTITION BY video_id) AS hi FROM t)
    SELECT video_id, frame_idx, {q6('a', 'time_since_prev')}, {q6('b', 'time_to_next')},
      {q6('(a+b)/2', 'cut_duration')}, {q6('(s-lo)/(hi-lo+1e-6)', 'position_in_video')} FROM n""",
)
def cut_timing(spark, sf):
    f = frames(spark, sf).withColumn("s", F.col("t_us") / 1e3)
    return out(W.cut_timing(f, "s"), KEYS, floats="time_since_prev time_to_next cut_duration position_in_video")


HOUR_US = 3_600_000_000


@query(
    "density_window",
    f"""WITH {FRAMES}, n AS (SELECT video_id, frame_idx, count(*) OVER (PARTITION BY video_id ORDER BY t_us
      RANGE BETWEEN {24 * HOUR_US} PRECEDING AND {24 * HOUR_US} FOLLOWING) AS c FROM frames)
    SELECT video_id, frame_idx, {big('c', 'neighbours')},
      {q6('c / max(c) OVER (PARTITION BY video_id)', 'density')} FROM n""",
)
def density_window(spark, sf):
    return out(W.density(frames(spark, sf, once=True), "t_us", 24 * HOUR_US), KEYS, "neighbours", "density")


VECS = """frames AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
  vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def vectors(spark, sf):
    from framewise.plans import blocks

    e = table(spark, sf, "embeddings").select(F.col("label").alias("video_id"), "vec_id", "embedding")
    stamped = blocks.with_block(e, "vec_id")
    return blocks.positions(stamped, "video_id", "vec_id", blocks.BLOCK, "frame_idx")


COS = "coalesce(list_cosine_similarity(v, {other}), 0)"


@query(
    "sim_prev_next",
    per_frame(q6(COS.format(other=f"lag(v) {OVER}"), "sim_prev"), q6(COS.format(other=f"lead(v) {OVER}"), "sim_next"), src=VECS),
)
def sim_prev_next(spark, sf):
    return out(W.sim_neighbours(vectors(spark, sf), "embedding"), KEYS, floats="sim_prev sim_next")


@query(
    "sim_mean5",
    f"""WITH {VECS}, pairs AS (SELECT a.video_id, a.frame_idx, list_cosine_similarity(a.v, b.v) AS s
      FROM frames a JOIN frames b ON a.video_id=b.video_id AND b.frame_idx BETWEEN a.frame_idx-2 AND a.frame_idx+2)
    SELECT video_id, frame_idx, {q6('coalesce(avg(s) FILTER (s < 0.9999), 0)', 'sim_mean5')} FROM pairs GROUP BY ALL""",
)
def sim_mean5(spark, sf):
    return out(W.sim_local(vectors(spark, sf), "embedding"), KEYS, floats="sim_mean5")


@query(
    "sim_mean5_others",
    f"""WITH {VECS}, pairs AS (SELECT a.video_id, a.frame_idx, list_cosine_similarity(a.v, b.v) AS s
      FROM frames a JOIN frames b ON a.video_id=b.video_id AND b.frame_idx BETWEEN a.frame_idx-2 AND a.frame_idx+2
       AND a.frame_idx <> b.frame_idx)
    SELECT video_id, frame_idx, {q6('avg(s)', 'sim_mean5')} FROM pairs GROUP BY ALL""",
)
def sim_mean5_others(spark, sf):
    return out(W.sim_local(vectors(spark, sf), "embedding", drop_identical=False), KEYS, floats="sim_mean5")


@query(
    "change_score",
    per_frame(
        q6(f"avg(de) {centred(3)}", "energy_change"), q6(f"avg(dp) {centred(3)}", "pitch_change"),
        extra=f", d AS (SELECT video_id, frame_idx, coalesce(abs(energy - lag(energy) {OVER}), 0) AS de, coalesce(abs(pitch - lag(pitch) {OVER}), 0) AS dp FROM frames)",
        frm="d",
    ),
)
def change_score(spark, sf):
    both = W.change_score(W.change_score(frames(spark, sf), "energy"), "pitch")
    return out(both, KEYS, floats="energy_change pitch_change")


@query(
    "transitions",
    per_frame(
        big(f"coalesce(speaking - lag(speaking) {OVER}, 0) > 0", "rising"),
        big(f"coalesce(speaking - lag(speaking) {OVER}, 0) < 0", "falling"),
    ),
)
def transitions(spark, sf):
    return out(W.transitions(frames(spark, sf), "speaking"), KEYS, "rising falling")


@query("value_change", per_frame(big(f"coalesce(speaker_id <> lag(speaker_id) {OVER}, true)", "speaker_id_changed")))
def value_change(spark, sf):
    return out(W.value_change(frames(spark, sf), "speaker_id"), KEYS, "speaker_id_changed")


@query(
    "abs_diff",
    per_frame(*[q6(f"coalesce(abs({c} - lag({c}) {OVER}), 0)", f"{c}_abs_diff") for c in ("motion", "speaker_id")]),
)
def abs_diff(spark, sf):
    return out(W.abs_diff(frames(spark, sf), ["motion", "speaker_id"]), KEYS, floats="motion_abs_diff speaker_id_abs_diff")


@query(
    "movement_2d",
    per_frame(q6(f"coalesce(sqrt(power(x - lag(x) {OVER}, 2) + power(y - lag(y) {OVER}, 2)), 0)", "movement")),
)
def movement_2d(spark, sf):
    return out(W.movement(frames(spark, sf), "x", "y"), KEYS, floats="movement")


@query(
    "cumulative",
    per_frame(
        q6("frame_idx / count(*) OVER (PARTITION BY video_id)", "position"),
        q6("avg(active) OVER (PARTITION BY video_id ORDER BY frame_idx)", "active_cum_mean"),
    ),
)
def cumulative(spark, sf):
    return out(W.cumulative(frames(spark, sf), "active"), KEYS, floats="position active_cum_mean")


@query(
    "run_length_timer",
    f"""WITH {LONG}, g AS (SELECT *, sum(speaking) {OVER} AS island FROM frames)
    SELECT video_id, frame_idx, {big('100 * sum(1 - speaking) OVER (PARTITION BY video_id, island ORDER BY frame_idx)', 'silence_duration_ms')} FROM g""",
)
def run_length_timer(spark, sf):
    return out(W.silence_timer(long_frames(spark, sf), "speaking"), KEYS, "silence_duration_ms")


@query(
    "nonzero_std",
    per_frame(q6(f"coalesce(stddev_pop(CASE WHEN pitch > 0 THEN pitch END) {over(5, 5)}, 0)", "pitch_std")),
)
def nonzero_std(spark, sf):
    return out(W.nonzero_std(frames(spark, sf), "pitch"), KEYS, floats="pitch_std")


SAMPLES = f"{FRAMES}, samples AS (SELECT *, value - 50 AS amp FROM frames)"


def samples(spark, sf):
    return frames(spark, sf).withColumn("amp", F.col("value") - 50)


@query(
    "frame_energy",
    f"""WITH {SAMPLES}, e AS (SELECT video_id, frame_idx // 10 AS hop, sqrt(avg(amp*amp)) AS rms FROM samples GROUP BY ALL)
    SELECT video_id, {big('hop')}, {q6('rms')}, {big('rms > 0.01', 'is_speaking')} FROM e""",
)
def frame_energy(spark, sf):
    return out(W.frame_energy(samples(spark, sf), "amp", 10), "video_id", "hop is_speaking", "rms")


@query(
    "zero_cross_rate",
    f"""WITH {SAMPLES}, z AS (SELECT video_id, frame_idx // 10 AS hop,
      coalesce((amp < 0) <> (lag(amp) {OVER} < 0), false)::int AS flip FROM samples)
    SELECT video_id, {big('hop')}, {q6('avg(flip)', 'zcr')} FROM z GROUP BY video_id, hop""",
)
def zero_cross_rate(spark, sf):
    return out(W.zero_cross_rate(samples(spark, sf), "amp", 10), "video_id", "hop", "zcr")


@query(
    "hist_change",
    f"""WITH {VECS}, c AS (SELECT video_id, frame_idx, list_transform(v, lambda x: x - list_avg(v)) AS w FROM frames),
    p AS (SELECT *, lag(w) {OVER} AS before FROM c)
    SELECT video_id, frame_idx, {q6('CASE WHEN before IS NULL THEN 0 ELSE greatest(0, 1 - list_cosine_similarity(before, w)) END', 'vector_change')} FROM p""",
)
def hist_change(spark, sf):
    return out(W.vector_change(vectors(spark, sf), "embedding"), KEYS, floats="vector_change")


def edge(offset: int) -> str:
    if offset == 0:
        return "score"
    fn, end = ("lag", "first_value") if offset < 0 else ("lead", "last_value")
    whole = "OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce({fn}(score, {abs(offset)}) {OVER}, {end}(score) {whole})"


def weighted_sql(weights: list[float], src: str = LONG) -> str:
    half = len(weights) // 2
    terms = " + ".join(f"({w!r})::double * {edge(o)}" for o, w in zip(range(-half, half + 1), weights, strict=True))
    short = f"count(*) OVER (PARTITION BY video_id) < {len(weights)}"
    return per_frame(q6(f"CASE WHEN {short} THEN score ELSE {terms} END", "smoothed"), src=src)


@query("smooth_ma", weighted_sql([0.2] * 5))
def smooth_ma(spark, sf):
    return out(S.smooth(long_frames(spark, sf), "score", "ma", window=5), KEYS, floats="smoothed")


@query("smooth_zero_ma", per_frame(q6(f"sum(k) {over(2, 2)} / 500.0::double", "smoothed"), src=LONG))
def smooth_zero_ma(spark, sf):
    f = long_frames(spark, sf).withColumn("score", F.col("k") / 1.0)
    done = S.smooth(f, "score", "zero_ma", window=5)
    return out(done.withColumn("smoothed", F.col("smoothed") / 100), KEYS, floats="smoothed")


@query("smooth_savgol", weighted_sql([n / 35 for n in (-3, 12, 17, 12, -3)]))
def smooth_savgol(spark, sf):
    return out(S.smooth(long_frames(spark, sf), "score", "savgol", window=5, degree=2), KEYS, floats="smoothed")


@query(
    "smooth_ema",
    f"""WITH RECURSIVE {FRAMES}, ema AS (
      SELECT video_id, frame_idx, sqrt(k + 2.0::double) AS y FROM frames WHERE frame_idx = 0
      UNION ALL SELECT f.video_id, f.frame_idx, 0.3::double * sqrt(f.k + 2.0::double) + 0.7::double * e.y
      FROM ema e JOIN frames f ON f.video_id = e.video_id AND f.frame_idx = e.frame_idx + 1)
    SELECT video_id, frame_idx, {q6('y', 'smoothed')} FROM ema""",
)
def smooth_ema(spark, sf):
    # Square roots have no finite decimals, so no smoothed value sits on a rounding boundary.
    f = frames(spark, sf).withColumn("root", F.sqrt(F.col("k") + 2.0))
    return out(S.smooth(f, "root", "ema", alpha=0.3), KEYS, floats="smoothed")


def hop_sql(size: int, body: str) -> str:
    ahead = over(0, size - 1)
    voiced = "CASE WHEN pitch > 0 THEN pitch END"
    return f"""WITH {FRAMES}, w AS (SELECT video_id, frame_idx, t_us AS start_time, lead(t_us, {size}) {OVER} AS end_time,
      count({voiced}) {ahead} AS voiced, avg({voiced}) {ahead} AS pitch_mean, stddev_pop({voiced}) {ahead} AS pitch_std,
      avg(energy) {ahead} / (max(energy) OVER (PARTITION BY video_id) + 1e-8) AS mean_energy FROM frames),
    h AS (SELECT *, (end_time - start_time) / {DAY_US}.0::double AS days FROM w
      WHERE frame_idx % {size // 2} = 0 AND end_time IS NOT NULL AND voiced >= {size // 2})
    {body}"""


DAY_US = 86_400_000_000


@query(
    "hop_window_detect",
    hop_sql(
        20,
        f"""SELECT video_id, frame_idx, {big('start_time')}, {big('end_time')},
        {q6('least(1.0::double, (pitch_std/50.0::double + mean_energy/0.15::double)/2)', 'confidence')},
        CASE WHEN days/5 < 1 THEN 'w' WHEN days/5 < 2 THEN 'www' ELSE 'wwww' END AS text
        FROM h WHERE pitch_std > 50 AND mean_energy > 0.15 AND (pitch_std/50.0::double + mean_energy/0.15::double)/2 >= 0.6""",
    ),
)
def hop_window_detect(spark, sf):
    done = W.detect_bursts(frames(spark, sf), "pitch", "energy", "t_us", units_per_second=5.0 * DAY_US, min_energy=0.15)
    return out(done, "video_id frame_idx text", "start_time end_time", "confidence")


@query(
    "hop_window_low",
    hop_sql(
        40,
        f"""SELECT video_id, frame_idx, {big('start_time')}, {big('end_time')},
        {q6('least(1.0::double, (2 - pitch_mean/250.0::double - mean_energy/0.4::double)/2)', 'confidence')}
        FROM h WHERE pitch_mean < 250 AND mean_energy < 0.4
        AND (2 - pitch_mean/250.0::double - mean_energy/0.4::double)/2 >= 0.1""",
    ),
)
def hop_window_low(spark, sf):
    done = W.detect_low(
        frames(spark, sf), "pitch", "energy", "t_us", max_pitch=250.0, max_energy=0.4, min_confidence=0.1
    )
    return out(done, KEYS, "start_time end_time", "confidence")


@query(
    "jump_detect",
    f"""WITH {FRAMES}, j AS (SELECT video_id, frame_idx, pitch, lag(pitch) {OVER} AS before, lag(t_us) {OVER} AS start_time,
      least(t_us + {HOUR_US}, max(t_us) OVER (PARTITION BY video_id)) AS end_time FROM frames)
    SELECT video_id, frame_idx, {big('start_time')}, {big('end_time')}, {q6('least(1.0::double, (pitch-before)/100.0::double)', 'confidence')}
    FROM j WHERE pitch > 0 AND before > 0 AND pitch - before > 100""",
)
def jump_detect(spark, sf):
    return out(W.detect_jumps(frames(spark, sf), "pitch", "t_us", HOUR_US), KEYS, "start_time end_time", "confidence")


HISTORY = """history AS (SELECT o_custkey % 5 AS fold, month(o_orderdate) AS epoch,
  sum(CAST(round(o_totalprice*100) AS BIGINT))::double / count(*) / 1e8 AS metric FROM orders GROUP BY ALL)"""


def history(spark, sf):
    o = table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.groupBy(
        F.pmod("o_custkey", F.lit(5)).alias("fold"), F.month("o_orderdate").cast("bigint").alias("epoch")
    ).agg((F.sum(cents).cast("double") / F.count(F.lit(1)) / 1e8).alias("metric"))


@query(
    "running_best",
    f"WITH {HISTORY} SELECT fold, epoch, {q6('max(metric) OVER (PARTITION BY fold ORDER BY epoch)', 'best_so_far')} FROM history",
)
def running_best(spark, sf):
    return out(W.running_best(history(spark, sf), "metric"), "fold epoch", floats="best_so_far")


@query(
    "chatter_tv",
    f"""WITH {FRAMES}, d AS (SELECT video_id, abs(score - lag(score) {OVER}) AS s FROM frames)
    SELECT video_id, {q6('coalesce(avg(s), 0)', 'total_variation')} FROM d GROUP BY video_id""",
)
def chatter_tv(spark, sf):
    return out(W.total_variation(frames(spark, sf), "score"), "video_id", floats="total_variation")


@query(
    "local_variance",
    f"""WITH {FRAMES}, d AS (SELECT video_id, frame_idx, var_samp(score) {over(4, 0)} AS v FROM frames)
    SELECT video_id, {q6('coalesce(avg(v) FILTER (frame_idx >= 4), 0)', 'local_variance')} FROM d GROUP BY video_id""",
)
def local_variance(spark, sf):
    return out(W.local_variance(frames(spark, sf), "score"), "video_id", floats="local_variance")


# Six columns in whole numbers, so that both engines average equal integers; every output of the operator is compared.
SIX = {"energy": "energy*100", "motion": "motion", "pitch": "pitch", "x": "x*10", "y": "y*10", "score": "score*100"}
TEMPORAL, TEMPORAL_SQL = [], []
for _c in SIX:
    _each = [(f"ma{n}", f"avg({_c}) {centred(n)}") for n in W.MEAN_WINDOWS]
    _each += [(f"std{n}", f"coalesce(stddev_samp({_c}) {centred(n)}, 0)") for n in W.STD_WINDOWS]
    _each += [(f"diff{n}", f"coalesce({_c} - lag({_c}, {n}) {OVER}, 0)") for n in W.LAGS]
    _each += [("change", f"avg(d_{_c}) {centred(3)}")]
    TEMPORAL += [f"{_c}_{n}" for n, _ in _each]
    TEMPORAL_SQL += [q6(e, f"{_c}_{n}") for n, e in _each]


@query(
    "temporal_features",
    per_frame(
        *TEMPORAL_SQL, *[big(f"coalesce(speaking - lag(speaking) {OVER}, 0) {sign} 0", n) for n, sign in (("rising", ">"), ("falling", "<"))], src=LONG,
        extra=f""", whole AS (SELECT video_id, frame_idx, {', '.join(f"round({e}) AS {c}" for c, e in SIX.items())}, speaking FROM frames),
        d AS (SELECT *, {', '.join(f"coalesce(abs({c} - lag({c}) {OVER}), 0) AS d_{c}" for c in SIX)} FROM whole)""",
        frm="d",
    ),
)
def temporal_features(spark, sf):
    f = long_frames(spark, sf).select(*KEYS.split(), *[F.expr(f"round({e})").alias(c) for c, e in SIX.items()], "speaking")
    return out(W.temporal_features(f, list(SIX), "speaking"), KEYS, "rising falling", " ".join(TEMPORAL))


_TWO = {"energy": "energy*100", "score": "score*100"}
ENRICHED = [*[n for n in TEMPORAL if n.rsplit("_", 1)[0] in _TWO], "time_since_prev", "time_to_next", "cut_duration", "position_in_video", "sim_prev", "sim_next",
            "motion_abs_diff", "speaker_id_abs_diff", "movement", "position", "speaking_cum_mean", "density"]
_KEPT = [e for n, e in zip(TEMPORAL, TEMPORAL_SQL, strict=True) if n.rsplit("_", 1)[0] in _TWO]
_SIM = "coalesce(list_cosine_similarity(v, {other}), 0)"


@query(
    "enrich",
    f"""WITH {LONG}, whole AS (SELECT video_id, frame_idx, t_us, round(energy*100) AS energy, round(score*100) AS score, speaking, motion, speaker_id, x, y,
      t_us/1e3 AS s, [x + 1, y, motion]::DOUBLE[] AS v FROM frames),
    d AS (SELECT *, {', '.join(f"coalesce(abs({c} - lag({c}) {OVER}), 0) AS d_{c}" for c in _TWO)}, coalesce(s - lag(s) {OVER}, 0) AS a, coalesce(lead(s) {OVER} - s, 0) AS b,
      min(s) OVER (PARTITION BY video_id) AS lo, max(s) OVER (PARTITION BY video_id) AS hi,
      count(*) OVER (PARTITION BY video_id ORDER BY t_us RANGE BETWEEN {24 * HOUR_US} PRECEDING AND {24 * HOUR_US} FOLLOWING) AS c FROM whole)
    SELECT video_id, frame_idx, {', '.join(_KEPT)}, {q6('a', 'time_since_prev')}, {q6('b', 'time_to_next')}, {q6('(a+b)/2', 'cut_duration')},
      {q6('(s-lo)/(hi-lo+1e-6)', 'position_in_video')}, {q6(_SIM.format(other=f'lag(v) {OVER}'), 'sim_prev')}, {q6(_SIM.format(other=f'lead(v) {OVER}'), 'sim_next')},
      {', '.join(q6(f"coalesce(abs({c} - lag({c}) {OVER}), 0)", f"{c}_abs_diff") for c in ("motion", "speaker_id"))},
      {q6(f"coalesce(sqrt(power(x - lag(x) {OVER}, 2) + power(y - lag(y) {OVER}, 2)), 0)", "movement")},
      {q6("frame_idx / count(*) OVER (PARTITION BY video_id)", "position")}, {q6("avg(speaking) OVER (PARTITION BY video_id ORDER BY frame_idx)", "speaking_cum_mean")},
      {q6('c / max(c) OVER (PARTITION BY video_id)', 'density')}, {big(f"coalesce(speaking - lag(speaking) {OVER}, 0) > 0", "rising")}, {big(f"coalesce(speaking - lag(speaking) {OVER}, 0) < 0", "falling")} FROM d""",
)
def enrich(spark, sf):
    """Statistics, cut timing, similarity, visual change, cumulative values and density of one table."""
    f = long_frames(spark, sf).select(
        *KEYS.split(), "t_us", *[F.expr(f"round({_TWO[c]})").alias(c) for c in _TWO], "speaking", "motion", "speaker_id", "x", "y",
        (F.col("t_us") / 1e3).alias("s"), F.array(F.col("x") + 1, "y", "motion").alias("v"),
    )
    done = W.enrich(f, list(_TWO), "s", "v", "speaking", ["motion", "speaker_id"], ("x", "y"), 24 * HOUR_US, "t_us")
    return out(done, KEYS, "rising falling", " ".join(ENRICHED))
