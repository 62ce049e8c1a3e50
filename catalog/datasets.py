"""Reshaping, scaling, windows, splits, augmentation and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import FRAMES, LONG, event_base, frames, long_frames, table
from catalog.align import AROUND, AXES, FLAG, WIDTH_S, axes, views_and_clicks
from catalog.cleaning import DIRTY, dirty
from catalog.intervals import TRACKS, tracks
from catalog.registry import query
from catalog.shape import big, out, q6
from catalog.windows import HOUR_US, KEYS, OVER, VECS, vectors
from framewise.functions import vectors as V
from framewise.operators import align as A
from framewise.operators import datasets as D
from framewise.operators import quality as Q

WIDE = [f"track_{n}_{p}" for n in range(5) for p in ("scale", "active")]


@query(
    "pivot_tracks",
    f"""WITH {FRAMES}, {TRACKS} SELECT video_id, frame_idx, {', '.join(q6(f"coalesce(max({p}) FILTER (track = {n}), 0)", f"track_{n}_{p}") for n in range(5) for p in ('scale', 'active'))}
    FROM tracks WHERE (frame_idx + track) % 4 <> 0 GROUP BY video_id, frame_idx""",
)
def pivot_tracks(spark, sf):
    t = tracks(frames(spark, sf)).where(F.pmod(F.col("frame_idx") + F.col("track"), F.lit(4)) != 0)
    return out(D.pivot_tracks(t, ["scale", "active"], 5), KEYS, floats=" ".join(WIDE))


@query(
    "join_outer_tracks",
    f"""WITH {FRAMES}, {TRACKS.replace('tracks AS', 'tracks AS MATERIALIZED', 1)}, a AS (SELECT video_id, frame_idx, scale FROM tracks WHERE track = 0 AND frame_idx % 3 = 0),
    b AS (SELECT video_id, frame_idx, scale FROM tracks WHERE track = 1 AND frame_idx % 2 = 0), c AS (SELECT video_id, frame_idx, scale FROM tracks WHERE track = 2 AND frame_idx % 5 = 0),
    k AS (SELECT video_id, frame_idx FROM a UNION SELECT video_id, frame_idx FROM b UNION SELECT video_id, frame_idx FROM c)
    SELECT k.video_id, k.frame_idx, {q6('coalesce(a.scale, 0)', 'track_0_scale')}, {q6('coalesce(b.scale, 0)', 'track_1_scale')}, {q6('coalesce(c.scale, 0)', 'track_2_scale')}
    FROM k LEFT JOIN a ON a.video_id = k.video_id AND a.frame_idx = k.frame_idx LEFT JOIN b ON b.video_id = k.video_id AND b.frame_idx = k.frame_idx
    LEFT JOIN c ON c.video_id = k.video_id AND c.frame_idx = k.frame_idx""",
)
def join_outer_tracks(spark, sf):
    """Per-track tables with different rows, merged on time: one pivot instead of a chain of outer joins."""
    i, n = F.col("frame_idx"), F.col("track")
    there = ((n == 0) & (i % 3 == 0)) | ((n == 1) & (i % 2 == 0)) | ((n == 2) & (i % 5 == 0))
    wide = D.pivot_tracks(tracks(frames(spark, sf)).where(there), ["scale"], 3)
    return out(wide, KEYS, floats="track_0_scale track_1_scale track_2_scale")


@query(
    "unpivot_tracks",
    f"""WITH {FRAMES}, {TRACKS} SELECT video_id, frame_idx, {big('track')}, {q6('scale')}, {big('active')} FROM tracks""",
)
def unpivot_tracks(spark, sf):
    wide = D.pivot_tracks(tracks(frames(spark, sf)), ["scale", "active"], 5)
    return out(D.unpivot_tracks(wide, ["scale", "active"], 5), KEYS, "track active", "scale")


@query(
    "standard_scale",
    f"""WITH {FRAMES}, s AS (SELECT avg(energy) AS m, stddev_pop(energy) AS d, avg(pitch) AS mp, stddev_pop(pitch) AS dp FROM frames WHERE video_id % 5 <> 0)
    SELECT video_id, frame_idx, {q6('(energy - m)/d', 'energy')}, {q6('(pitch - mp)/dp', 'pitch')}, {q6('1.0::double - 1.0::double', 'constant')} FROM frames, s""",
)
def standard_scale(spark, sf):
    f = frames(spark, sf).withColumn("constant", F.lit(1.0))
    cols = ["energy", "pitch", "constant"]
    scaler = D.fit_scaler(f.where(F.pmod("video_id", F.lit(5)) != 0), cols)
    return out(D.apply_scaler(f, scaler, cols), KEYS, floats=" ".join(cols))


@query("standard_scale_inverse", f"WITH {FRAMES} SELECT video_id, frame_idx, {q6('energy')}, {q6('pitch')} FROM frames")
def standard_scale_inverse(spark, sf):
    f, cols = frames(spark, sf), ["energy", "pitch"]
    scaler = D.fit_scaler(f, cols)
    return out(D.apply_scaler(D.apply_scaler(f, scaler, cols), scaler, cols, inverse=True), KEYS, floats="energy pitch")


@query(
    "standard_scale_vector",
    f"""WITH {VECS}, s AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS d FROM frames, range(1, 65) r(i) GROUP BY i)
    SELECT vec_id, {q6('sum((v[i] - m)/d)', 'total')}, {q6('max((v[i] - m)/d)', 'largest')} FROM frames, s GROUP BY vec_id""",
)
def standard_scale_vector(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    done = D.apply_vector_scaler(e, D.fit_vector_scaler(e, "embedding"), "embedding")
    v = F.col("embedding")
    return out(done.select("vec_id", V.total(v).alias("total"), F.array_max(v).alias("largest")), "vec_id", floats="total largest")


@query(
    "minmax_scale",
    f"""WITH {FRAMES}, s AS (SELECT min(energy) AS a, max(energy) AS b, min(pitch) AS c, max(pitch) AS d FROM frames)
    SELECT video_id, frame_idx, {q6('(energy - a)/(b - a)', 'energy')}, {q6('(pitch - c)/(d - c)', 'pitch')} FROM frames, s""",
)
def minmax_scale(spark, sf):
    f, cols = frames(spark, sf), ["energy", "pitch"]
    return out(D.apply_scaler(f, D.fit_scaler(f, cols, "minmax"), cols), KEYS, floats="energy pitch")


@query(
    "l2_normalize",
    f"""WITH {VECS}, d AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(v, lambda x: 0.0::double) ELSE list_transform(v, lambda x: x * (vec_id + 1)) END AS w FROM frames),
    n AS (SELECT *, sqrt(list_dot_product(w, w)) AS norm FROM d)
    SELECT vec_id, {q6('list_sum(w)/(CASE WHEN norm < 1e-8 THEN 1 ELSE norm END)', 'total')}, {q6('CASE WHEN norm < 1e-8 THEN 0 ELSE 1 END', 'norm')} FROM n""",
)
def l2_normalize(spark, sf):
    i = F.col("vec_id")
    raw = F.transform(V.as_double(F.col("embedding")), lambda x: F.when(i % 9 == 0, 0.0).otherwise(x * (i + 1)))
    done = D.l2_normalize(table(spark, sf, "embeddings").select("vec_id", raw.alias("v")), "v")
    v = F.col("v")
    return out(done.select("vec_id", V.total(v).alias("total"), V.norm(v).alias("norm")), "vec_id", floats="total norm")


# --- windows: start ranges from the video length, checked by content sums ----------------------

WINDOW_INTS = "window_index window_start window_end total_windows original_length padding_length valid"


def windows_sql(length: int, step: int, starts: str) -> str:
    """``starts`` selects (window_index, window_start) for a video of n rows."""
    return f"""WITH {LONG}, v AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), st AS ({starts}),
    w AS (SELECT st.video_id, n, window_index, window_start, count(*) OVER (PARTITION BY st.video_id) AS total_windows FROM st JOIN v USING (video_id))
    SELECT w.video_id, {big('window_index')}, {big('window_start')}, {big(f'least(window_start + {length}, n)', 'window_end')}, {big('total_windows')}, {big('n', 'original_length')},
      {big(f'greatest(0, window_start + {length} - n)', 'padding_length')}, {big('count(*)', 'valid')}, {q6('sum(f.k)', 'first_sum')},
      {q6('sum(f.k * (f.frame_idx - window_start + 1))', 'placed_sum')}
    FROM w JOIN frames f ON f.video_id = w.video_id AND f.frame_idx >= window_start AND f.frame_idx < window_start + {length}
    GROUP BY w.video_id, window_index, window_start, n, total_windows"""


def window_rows(cut):
    v = F.col("values")
    first = F.transform(v, lambda r: r[0])
    placed = F.transform(v, lambda r, i: r[0] * (i + 1))
    done = cut.select("*", F.size(F.filter("mask", lambda m: m)).alias("valid"), V.total(first).alias("first_sum"), V.total(placed).alias("placed_sum"))
    return out(done, "video_id", WINDOW_INTS, "first_sum placed_sum")


def drop_starts(length: int, step: int) -> str:
    return f"SELECT video_id, j AS window_index, j * {step} AS window_start FROM v, LATERAL (SELECT unnest(range(0, CASE WHEN n >= {length} THEN (n - {length}) // {step} + 1 ELSE 0 END)) AS j)"


@query("windows_drop", windows_sql(90, 45, drop_starts(90, 45)))
def windows_drop(spark, sf):
    return window_rows(D.windows(long_frames(spark, sf), ["k", "energy"], 90, 45, "drop"))


@query(
    "windows_tail",
    windows_sql(
        90, 45,
        drop_starts(90, 45) + " UNION ALL SELECT video_id, CASE WHEN n < 90 THEN 0 ELSE (n - 90)//45 + 1 END, greatest(n - 90, 0) FROM v WHERE n < 90 OR n % 45 <> 0",
    ),
)
def windows_tail(spark, sf):
    return window_rows(D.windows(long_frames(spark, sf), ["k", "energy"], 90, 45, "tail"))


PAD_STARTS = "SELECT video_id, j AS window_index, j * {step} AS window_start FROM v, LATERAL (SELECT unnest(range(0, CASE WHEN n <= {length} THEN 1 ELSE CAST(ceil((n - {length})/{step}.0::double) AS BIGINT) + 1 END)) AS j)"


@query("windows_pad", windows_sql(100, 70, PAD_STARTS.format(length=100, step=70)))
def windows_pad(spark, sf):
    return window_rows(D.windows(long_frames(spark, sf), ["k", "energy"], 100, 30, "pad"))


@query(
    "chunks_named",
    f"""WITH {LONG}, v AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), c AS (SELECT f.video_id, frame_idx // 64 AS i, count(*) AS valid, sum(k) AS total FROM frames f GROUP BY ALL)
    SELECT CASE WHEN n > 64 THEN c.video_id || '_chunk' || i ELSE c.video_id::varchar END AS chunk_id, {big('valid')}, {big('(SELECT max(valid) FROM c) - valid', 'padding_length')}, {q6('total')} FROM c JOIN v USING (video_id)""",
)
def chunks_named(spark, sf):
    cut = D.chunks_named(long_frames(spark, sf), ["k"], 64)
    total = V.total(F.transform("values", lambda r: r[0]))
    done = cut.select("chunk_id", F.size(F.filter("mask", lambda m: m)).alias("valid"), "padding_length", total.alias("total"))
    return out(done, "chunk_id", "valid padding_length", "total")


@query(
    "batch_pad",
    f"""WITH {FRAMES}, v AS (SELECT video_id, frame_idx // 32 AS i, count(*) AS n, sum(k) AS total FROM frames GROUP BY ALL), b AS (SELECT *, max(n) OVER (PARTITION BY video_id // 8) AS longest FROM v)
    SELECT video_id, {big('i', 'window_index')}, {big('video_id // 8', 'batch')}, {big('longest', 'width')}, {big('longest - n', 'padded')}, {q6('total')} FROM b""",
)
def batch_pad(spark, sf):
    # Stored sequences: the unpadded windows of every video; eight videos form a batch.
    seq = D.windows(frames(spark, sf), ["k"], 32, 0, "pad")
    have = (F.lit(32) - F.col("padding_length")).cast("int")
    values = F.slice(F.transform("values", lambda r: r[0]), F.lit(1), have)
    done = D.pad_batch(seq.select("video_id", "window_index", values.alias("values")), "video_id", "values", 8)
    show = done.select(
        "video_id", "window_index", "batch", F.size("values").alias("width"), F.size(F.filter("padding_mask", lambda m: m)).alias("padded"),
        V.total(F.col("values")).alias("total"),
    )
    return out(show, "video_id", "window_index batch width padded", "total")


@query(
    "window_stats",
    f"""WITH {LONG}, v AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), st AS ({PAD_STARTS.format(length=100, step=70)}),
    w AS (SELECT *, count(*) OVER (PARTITION BY st.video_id) AS t, greatest(0, window_start + 100 - n) AS pad FROM st JOIN v USING (video_id))
    SELECT {big('count(*)', 'windows')}, {big('count(*) FILTER (pad > 0)', 'padded')}, {big('count(*) FILTER (t > 1)', 'segmented')}, {q6('avg(n)', 'avg_original_length')}, {q6('avg(pad)', 'avg_padding')},
      {big('count(DISTINCT video_id)', 'videos')} FROM w""",
)
def window_stats(spark, sf):
    done = D.window_stats(D.windows(long_frames(spark, sf), ["k"], 100, 30, "pad"))
    return out(done, "", "windows padded segmented videos", "avg_original_length avg_padding")


@query(
    "group_split",
    f"""WITH {FRAMES}, v AS (SELECT DISTINCT video_id FROM frames), r AS (SELECT video_id, row_number() OVER (ORDER BY md5('7:' || video_id)) - 1 AS i, count(*) OVER () AS n FROM v)
    SELECT f.video_id, {big('count(*)', 'frames')}, CASE WHEN i < floor(n * 0.8::double) THEN 'train' ELSE 'val' END AS split FROM frames f JOIN r USING (video_id) GROUP BY f.video_id, i, n""",
)
def group_split(spark, sf):
    marked = D.group_split(frames(spark, sf), seed=7)
    return out(marked.groupBy("video_id", "split").agg(F.count(F.lit(1)).alias("frames")), "video_id split", "frames")


@query(
    "group_kfold",
    f"""WITH RECURSIVE {FRAMES}, v AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id),
    o AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('0:' || video_id)) AS rn FROM v),
    walk AS (SELECT 0::BIGINT AS rn, [0, 0, 0, 0, 0]::BIGINT[] AS loads, -1::BIGINT AS fold
      UNION ALL SELECT o.rn, list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + o.n ELSE x END),
        (list_position(w.loads, list_min(w.loads)) - 1)::BIGINT FROM walk w JOIN o ON o.rn = w.rn + 1)
    SELECT o.video_id, {big('o.n', 'rows')}, {big('w.fold', 'fold')} FROM o JOIN walk w USING (rn)""",
)
def group_kfold(spark, sf):
    return out(D.group_kfold(frames(spark, sf)), "video_id", "rows fold")


@query(
    "union_splits",
    f"""WITH {FRAMES} SELECT video_id, frame_idx, active, 'train' AS part, {q6('score')} FROM frames WHERE video_id % 5 <> 0
    UNION ALL SELECT video_id, frame_idx, active, 'val', NULL FROM frames WHERE video_id % 5 = 0""",
)
def union_splits(spark, sf):
    f = frames(spark, sf)
    held = F.pmod("video_id", F.lit(5)) == 0
    a = f.where(~held).select(*KEYS.split(), "active", F.lit("train").alias("part"), "score")
    b = f.where(held).select(*KEYS.split(), "active", F.lit("val").alias("part"))
    return out(D.union_splits(a, b), KEYS + " active part", floats="score")


def uniform_sql(*parts: str) -> str:
    joined = " || ':' || ".join(f"({p})::varchar" for p in parts)
    return f"(CAST('0x' || substr(md5({joined}), 1, 12) AS BIGINT)::double / 281474976710656.0::double)"


@query(
    "augment_shift",
    f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, CAST(floor({uniform_sql("'3'", "'shift'", 'video_id')} * 11) AS BIGINT) - 5 AS off FROM frames)
    SELECT video_id, {big('((frame_idx + off) % n + n) % n', 'frame_idx')}, {q6('energy')}, {big('active')} FROM n""",
)
def augment_shift(spark, sf):
    f = frames(spark, sf).select(*KEYS.split(), "energy", "active")
    return out(D.augment_shift(f, D.shift_offset(3)), "video_id", "frame_idx active", "energy")


NOISE = f"""CASE WHEN {uniform_sql("'5'", "'noise?'", 'video_id')} < 0.5 THEN 0.01::double * sqrt(-2 * ln(greatest({uniform_sql("'5'", "'r'", "'energy'", 'video_id', 'frame_idx')}, 1e-12)))
  * cos(2 * pi() * {uniform_sql("'5'", "'a'", "'energy'", 'video_id', 'frame_idx')}) ELSE 0 END"""
FACTOR = f"CASE WHEN {uniform_sql(chr(39) + '5' + chr(39), chr(39) + 'scale?' + chr(39), 'video_id')} < 0.5 THEN 0.9::double + (1.1::double - 0.9::double) * {uniform_sql(chr(39) + '5' + chr(39), chr(39) + 'scale' + chr(39), 'video_id')} ELSE 1 END"


@query("augment_noise_scale", f"WITH {FRAMES} SELECT video_id, frame_idx, {q6(f'(energy + {NOISE}) * {FACTOR}', 'energy')} FROM frames")
def augment_noise_scale(spark, sf):
    return out(D.augment_noise(frames(spark, sf), ["energy"], seed=5), KEYS, floats="energy")


@query(
    "augment_warp",
    f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM frames)
    SELECT a.video_id, a.frame_idx, {q6('b.energy', 'energy')}, {big('b.active', 'active')} FROM n a JOIN n b ON b.video_id = a.video_id
      AND b.frame_idx = floor(least(a.frame_idx * 1.25::double, a.n - 1))""",
)
def augment_warp(spark, sf):
    f = frames(spark, sf).select(*KEYS.split(), "energy", "active")
    return out(D.augment_warp(f, 1.25), KEYS, "active", "energy")


# --- quality reports ---------------------------------------------------------------------------


@query(
    "nonfinite_profile",
    f"""WITH {DIRTY}, c AS (SELECT video_id, 'd' AS "column", count(*) AS n, count(*) FILTER (d IS NULL) AS nulls, count(*) FILTER (isnan(d)) AS nans, count(*) FILTER (isinf(d)) AS infs FROM dirty GROUP BY video_id
      UNION ALL SELECT video_id, 'active', count(*), 0, 0, 0 FROM dirty GROUP BY video_id)
    SELECT video_id, "column", {big('n', 'rows')}, {big('nulls')}, {big('nans')}, {big('infs')} FROM c""",
)
def nonfinite_profile(spark, sf):
    done = Q.profile_nonfinite(dirty(spark, sf).select("video_id", "d", "active"), "video_id")
    return out(done, "video_id column", "rows nulls nans infs")


# Ingest order is the event number; some time stamps are pushed back.
DISORDER = f"""{FRAMES}, dis AS (SELECT video_id, frame_idx, CASE WHEN k % 29 = 0 THEN t_us - {48 * HOUR_US} ELSE t_us END AS t FROM frames)"""


@query(
    "timestamp_checks",
    f"""WITH {DISORDER}, s AS (SELECT video_id, t - lag(t) {OVER} AS step FROM dis)
    SELECT video_id, coalesce(bool_or(step < 0), false) AS non_monotonic, {big(f'count(*) FILTER (step > {24 * HOUR_US})', 'gaps')}, {big('coalesce(max(step), 0)', 'max_gap')} FROM s GROUP BY video_id""",
)
def timestamp_checks(spark, sf):
    f = frames(spark, sf)
    t = F.when(F.pmod("k", F.lit(29)) == 0, F.col("t_us") - 48 * HOUR_US).otherwise(F.col("t_us"))
    return out(Q.check_time(f.withColumn("t", t), "t", 24 * HOUR_US), "video_id non_monotonic", "gaps max_gap")


@query(
    "schema_checks",
    """SELECT 'frame_rate' AS "column", 'missing' AS problem, 0::BIGINT AS "rows"
    UNION ALL SELECT 'embedding', 'width', count(*) FILTER (vec_id % 11 = 0) FROM embeddings""",
)
def schema_checks(spark, sf):
    short = F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    e = table(spark, sf, "embeddings").withColumn("embedding", short)
    return out(Q.check_schema(e, ["vec_id", "frame_rate"], {"embedding": 64}), "column problem", "rows")


# Audio exists for videos not divisible by 7, visual for those not divisible by 5.
def modality_sql(name: str, mod: int) -> str:
    return f"SELECT p.video_id, '{name}' AS modality, pct, max_gap/{HOUR_US * 12}.0::double AS max_gap FROM p JOIN g USING (video_id) WHERE video_id % {mod} <> 0"


VALIDATED = f"""{AROUND}, src AS (SELECT video_id, t_us - lag(t_us) OVER (PARTITION BY video_id ORDER BY t_us) AS gap FROM s),
  g AS (SELECT video_id, coalesce(max(gap), 0) AS max_gap FROM src GROUP BY video_id),
  p AS (SELECT video_id, avg(coalesce({FLAG}, true)::int) * 100 AS pct FROM n GROUP BY video_id),
  au AS ({modality_sql('audio', 7)}), vi AS ({modality_sql('visual', 5)}),
  rep AS (SELECT v.video_id, v.video_id % 7 <> 0 AS has_audio, v.video_id % 5 <> 0 AS has_visual, au.pct AS ap, au.max_gap AS ag, vi.pct AS vp, vi.max_gap AS vg
    FROM (SELECT DISTINCT video_id FROM frames) v LEFT JOIN au USING (video_id) LEFT JOIN vi USING (video_id)),
  val AS (SELECT *, list_filter([CASE WHEN NOT has_audio THEN 'audio features not found' END, CASE WHEN has_audio AND ap > 50 THEN 'audio high interpolation' END, CASE WHEN has_audio AND ag > 5 THEN 'audio large gap' END,
     CASE WHEN NOT has_visual THEN 'visual features not found' END, CASE WHEN has_visual AND vp > 50 THEN 'visual high interpolation' END, CASE WHEN has_visual AND vg > 5 THEN 'visual large gap' END], lambda x: x IS NOT NULL) AS issues FROM rep),
  fin AS (SELECT *, CASE WHEN len(issues) = 0 THEN 'success' WHEN NOT has_audio OR NOT has_visual THEN 'missing_features' ELSE 'issues_found' END AS status FROM val)"""


def validated(spark, sf):
    targets, sources = views_and_clicks(spark, sf)
    base = A.align_report(targets, {"any": sources}, 6 * HOUR_US, 60 * HOUR_US, WIDTH_S * 1e6, "t_us")

    kinds = [("audio", 7), ("visual", 5)]
    each = F.array_compact(F.array(*[F.when(F.pmod("video_id", F.lit(m)) != 0, F.lit(n)) for n, m in kinds]))
    stats = base.select("video_id", F.explode(each).alias("modality"), "interpolated_pct", (F.col("max_gap") / (12.0 * HOUR_US)).alias("max_gap"))
    videos = event_base(spark, sf).select("video_id").distinct()
    audio, visual = (videos.where(F.pmod("video_id", F.lit(m)) != 0) for _, m in kinds)
    return Q.validate_videos(videos, audio, visual, stats)


@query("validate_videos", f"WITH {VALIDATED} SELECT video_id, has_audio, has_visual, array_to_string(issues, '; ') AS issues, status FROM fin")
def validate_videos(spark, sf):
    return validated(spark, sf).select("video_id", "has_audio", "has_visual", F.array_join("issues", "; ").alias("issues"), "status")


@query(
    "validation_summary",
    f"""WITH {VALIDATED} SELECT {big('count(*)', 'videos')}, {big("count(*) FILTER (status = 'success')", 'successful')}, {q6('avg(100 - ap)', 'avg_audio_coverage')}, {q6('avg(vp)', 'avg_visual_interpolation')},
    {q6('max(ag)', 'max_audio_gap')}, {big('count(*) FILTER (len(issues) > 0)', 'videos_with_issues')}, {big('count(*) FILTER (ap > 50 OR vp > 50)', 'videos_with_high_interpolation')},
    {big('count(*) FILTER (ag > 5 OR vg > 5)', 'videos_with_large_gaps')} FROM fin""",
)
def validation_summary(spark, sf):
    done = Q.validation_summary(validated(spark, sf))
    return out(
        done, "", "videos successful videos_with_issues videos_with_high_interpolation videos_with_large_gaps",
        "avg_audio_coverage avg_visual_interpolation max_audio_gap",
    )


@query(
    "find_issues",
    f"""WITH {FRAMES}, d AS (SELECT video_id, t_us - lag(t_us) OVER (PARTITION BY video_id ORDER BY frame_idx) AS step, k FROM frames)
    SELECT video_id, 'events gaps in time' AS issue FROM d GROUP BY video_id HAVING count(*) FILTER (step > 86400000000) > 0
    UNION ALL SELECT video_id, 'events values missing' FROM d GROUP BY video_id HAVING count(*) FILTER (k % 97 = 0 OR k = 45) > 0""",
)
def find_issues(spark, sf):
    """Gaps of more than a day, missing values, and vectors with a NaN."""
    holed = F.when(F.pmod("k", F.lit(97)) != 0, F.col("energy"))
    vector = F.array("x", F.when(F.col("k") == 45, float("nan")).otherwise(F.col("y")))
    f = frames(spark, sf).select(*KEYS.split(), F.col("t_us").alias("time"), holed.alias("energy"), vector.alias("place"))
    return Q.find_issues(f, "events", ["time", "energy", "place"], gap=86_400_000_000)


LABEL_SIDES = f"{AXES}, old AS (SELECT video_id, time, active, 0 AS track FROM lab), new AS (SELECT video_id, frame_idx/10.0::double AS time, active, track FROM (SELECT * FROM frames, range(2) t(track)))"


def label_sides(spark, sf):
    feat, lab = axes(spark, sf)
    f = frames(spark, sf)
    new = f.select("video_id", (F.col("frame_idx") / 10.0).alias("time"), "active", F.explode(F.array(F.lit(0), F.lit(1))).alias("track"))
    return feat, lab.withColumn("track", F.lit(0)), new


@query(
    "integrity_compare",
    f"""WITH {LABEL_SIDES}, f AS (SELECT video_id, count(*) AS n, max(time) AS d FROM feat WHERE video_id % 9 <> 0 GROUP BY video_id),
    l AS (SELECT video_id, count(DISTINCT time) AS n, max(time) AS d, avg(active) AS r, max(track) + 1 AS t FROM old WHERE video_id % 8 <> 0 GROUP BY video_id),
    b AS (SELECT coalesce(f.video_id, l.video_id) AS video_id, f.n AS fn, l.n AS ln, abs(f.n - l.n) AS sd, abs(f.d - l.d) AS td, r, t FROM f FULL JOIN l ON l.video_id = f.video_id),
    i AS (SELECT *, list_filter([CASE WHEN sd > greatest(fn, ln) * 0.05::double THEN 'steps differ' END, CASE WHEN td > 5 THEN 'duration differs' END, CASE WHEN t <> 1 THEN 'unexpected tracks' END], lambda x: x IS NOT NULL) AS issues FROM b)
    SELECT video_id, {big('sd', 'step_diff')}, {q6('td', 'duration_diff')}, {q6('r', 'active_ratio')}, array_to_string(issues, '; ') AS issues,
      CASE WHEN fn IS NULL OR ln IS NULL THEN 'MISSING' WHEN len(issues) > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM i""",
)
def integrity_compare(spark, sf):
    feat, old, _ = label_sides(spark, sf)
    done = Q.integrity(feat.where(F.pmod("video_id", F.lit(9)) != 0), old.where(F.pmod("video_id", F.lit(8)) != 0), tracks=1)
    return out(done.withColumn("issues", F.array_join("issues", "; ")), "video_id issues status", "step_diff", "duration_diff active_ratio")


@query(
    "label_diff",
    f"""WITH {LABEL_SIDES}, a AS (SELECT video_id, count(DISTINCT time) AS n, max(time) AS d, sum(active) AS x FROM old GROUP BY video_id),
    b AS (SELECT video_id, count(DISTINCT time) AS n, max(time) AS d, sum(active) AS x FROM new GROUP BY video_id)
    SELECT a.video_id, {big('b.n - a.n', 'step_diff')}, {q6('b.d - a.d', 'duration_diff')}, {big('a.x', 'old_active')}, {big('b.x', 'new_active')}, b.n > a.n * 1.5 AS grown FROM a JOIN b USING (video_id)""",
)
def label_diff(spark, sf):
    _, old, new = label_sides(spark, sf)
    return out(Q.label_diff(old, new), "video_id grown", "step_diff old_active new_active", "duration_diff")


@query(
    "source_kind_report",
    """WITH p AS (SELECT CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 6 = 1 THEN 'C:\\rec\\Bandicam ' || page_id || '.mp4' WHEN page_id % 6 = 2 THEN 'C:\\出力\\動画' || page_id || '.mp4'
      WHEN page_id % 6 = 3 THEN 'C:\\bandicam\\字幕.mp4' ELSE url END AS path FROM pages)
    SELECT CASE WHEN path IS NULL THEN 'error' WHEN contains(lower(path), 'bandicam') THEN 'recording' WHEN contains(path, '動画') THEN 'output' ELSE 'unknown' END AS kind, count(*) AS files FROM p GROUP BY kind""",
)
def source_kind_report(spark, sf):
    i = F.col("page_id")
    text = i.cast("string")
    path = (
        F.when(i % 6 == 0, None).when(i % 6 == 1, F.concat(F.lit("C:\\rec\\Bandicam "), text, F.lit(".mp4")))
        .when(i % 6 == 2, F.concat(F.lit("C:\\出力\\動画"), text, F.lit(".mp4"))).when(i % 6 == 3, "C:\\bandicam\\字幕.mp4").otherwise(F.col("url"))
    )
    return out(Q.source_report(table(spark, sf, "pages").select(path.alias("path")), "path", "bandicam"), "kind", "files")


@query(
    "batch_report",
    f"WITH {FRAMES}, v AS (SELECT video_id, min(value) > 0.5 AS ok FROM frames GROUP BY video_id) SELECT {big('count(*)', 'total')}, {big('count(*) FILTER (ok)', 'succeeded')}, {big('count(*) FILTER (NOT ok)', 'failed')}, {q6('count(*) FILTER (ok)/count(*)*100', 'success_pct')} FROM v",
)
def batch_report(spark, sf):
    v = frames(spark, sf).groupBy("video_id").agg((F.min("value") > 0.5).alias("ok"))
    return out(Q.batch_report(v, F.col("ok")), "", "total succeeded failed", "success_pct")
