"""Joins on time, as-of and interpolation, intervals to frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import CLIPS, FRAMES, clips, frames, table
from catalog.intervals import TOTALS, TRACKS, totals, tracks
from catalog.registry import query
from catalog.shape import big, out, q6
from catalog.windows import HOUR_US, KEYS
from framewise.operators import align as A
from framewise.plans import blocks

# Two time axes: features on the 0.1 s grid with jitter, labels thinned out and partly repeated.
AXES = f"""{FRAMES}, feat AS (SELECT video_id, frame_idx, frame_idx/10.0::double + (k % 5)/500.0::double AS time, energy FROM frames),
  lab AS (SELECT video_id, frame_idx/10.0::double AS time, active FROM frames WHERE frame_idx % 3 <> 0
          UNION ALL SELECT video_id, frame_idx/10.0::double, active FROM frames WHERE frame_idx % 7 = 0)"""


def axes(spark, sf):
    f = frames(spark, sf)
    t = F.col("frame_idx") / 10.0
    feat = f.select("video_id", "frame_idx", (t + F.pmod("k", F.lit(5)) / 500.0).alias("time"), "energy")
    thin = f.where(F.pmod("frame_idx", F.lit(3)) != 0).select("video_id", t.alias("time"), "active")
    again = f.where(F.pmod("frame_idx", F.lit(7)) == 0).select("video_id", t.alias("time"), "active")
    return feat, thin.unionByName(again)


@query(
    "join_rounded_time",
    f"""WITH {AXES} SELECT f.video_id, f.frame_idx, {q6('f.energy', 'energy')}, {big('l.active', 'active')} FROM feat f JOIN lab l
    ON f.video_id = l.video_id AND CAST(round(f.time*10) AS BIGINT) = CAST(round(l.time*10) AS BIGINT)""",
)
def join_rounded_time(spark, sf):
    return out(A.join_on_time(*axes(spark, sf)), KEYS, "active", "energy")


def of_type(f, kind):
    """Events of one kind with their own dense position."""
    picked = f.where(F.col("event_type") == kind).select("video_id", "t_us", "value")
    stamped = picked.withColumn("_b", blocks.int_div("t_us", HOUR_US))
    return blocks.positions(stamped, "video_id", "t_us", "_b", "frame_idx")


@query(
    "join_positional",
    f"""WITH {FRAMES}, p AS (SELECT video_id, event_type, value, row_number() OVER (PARTITION BY video_id, event_type ORDER BY t_us) - 1 AS i FROM frames)
    SELECT a.video_id, {big('a.i', 'frame_idx')}, {q6('a.value', 'view_value')}, {q6('b.value', 'click_value')}
    FROM p a JOIN p b ON a.video_id = b.video_id AND a.i = b.i WHERE a.event_type = 'view' AND b.event_type = 'click'""",
)
def join_positional(spark, sf):
    f = frames(spark, sf)
    views = of_type(f, "view").select("video_id", "frame_idx", F.col("value").alias("view_value"))
    clicks = of_type(f, "click").select("video_id", "frame_idx", F.col("value").alias("click_value"))
    return out(A.zip_by_index(views, clicks), "video_id", "frame_idx", "view_value click_value")


def views_and_clicks(spark, sf):
    f = frames(spark, sf)
    sources = f.where(F.col("event_type") != "click").select("video_id", "t_us", "value")
    targets = f.where(F.col("event_type") == "click").select("video_id", "frame_idx", "t_us")
    return targets, sources


# Stretch of a time axis that one task sorts.
WIDTH_S = 86_400.0


def in_seconds(df):
    return df.withColumn("seconds", F.col("t_us") / 1e6)


# Neighbouring sources of every target.
AROUND = f"""{FRAMES}, s AS (SELECT * FROM frames WHERE event_type <> 'click'), t AS (SELECT * FROM frames WHERE event_type = 'click'),
  n AS (SELECT t.video_id, t.frame_idx, t.t_us, max(s.t_us) FILTER (s.t_us <= t.t_us) AS t0, min(s.t_us) FILTER (s.t_us > t.t_us) AS t1,
     arg_max(s.value, s.t_us) FILTER (s.t_us <= t.t_us) AS v0, arg_min(s.value, s.t_us) FILTER (s.t_us > t.t_us) AS v1,
     arg_min(s.value, s.t_us) AS vf FROM t LEFT JOIN s ON s.video_id = t.video_id GROUP BY ALL)"""
FLAG = f"least(t_us - t0, t1 - t_us) > {6 * HOUR_US}"


@query("asof_ffill", f"WITH {AROUND} SELECT video_id, frame_idx, {q6('coalesce(v0, vf)', 'value_asof')} FROM n")
def asof_ffill(spark, sf):
    targets, sources = (in_seconds(df) for df in views_and_clicks(spark, sf))
    return out(A.asof_ffill(targets, sources, ["value"], WIDTH_S, "seconds"), KEYS, floats="value_asof")


@query(
    "interp_linear",
    f"""WITH {AROUND} SELECT video_id, frame_idx, {q6('CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((t_us - t0)/(t1 - t0)) END', 'value_interp')},
    {FLAG} AS interpolated FROM n""",
)
def interp_linear(spark, sf):
    targets, sources = (in_seconds(df) for df in views_and_clicks(spark, sf))
    return out(A.interp_linear(targets, sources, ["value"], 6 * 3600.0, WIDTH_S, "seconds"), KEYS + " interpolated", floats="value_interp")


# Every fourth vector is a source; the others are targets on the same axis.
VAROUND = """e AS (SELECT label AS video_id, vec_id, vec_id * 10 AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  s AS (SELECT * FROM e WHERE vec_id % 4 = 0), g AS (SELECT * FROM e WHERE vec_id % 4 <> 0),
  n AS (SELECT g.video_id, g.vec_id, g.t, max(s.t) FILTER (s.t <= g.t) AS t0, min(s.t) FILTER (s.t > g.t) AS t1,
     arg_max(s.v, s.t) FILTER (s.t <= g.t) AS v0, arg_min(s.v, s.t) FILTER (s.t > g.t) AS v1
     FROM g JOIN s ON s.video_id = g.video_id GROUP BY ALL),
  mixed AS (SELECT video_id, vec_id, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE
     list_transform(list_zip(v0, v1), lambda p: p[1] + (p[2] - p[1]) * ((t - t0)/(t1 - t0))) END AS m FROM n)"""


def vector_sides(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("video_id"), "vec_id", (F.col("vec_id") * 10).alias("t"), "embedding"
    )
    source = F.pmod("vec_id", F.lit(4)) == 0
    return e.where(~source).select("video_id", "vec_id", "t"), e.where(source).select("video_id", "t", "embedding")


@query(
    "interp_vector_l2",
    f"""WITH {VAROUND}, u AS (SELECT *, sqrt(list_dot_product(m, m)) AS nrm FROM mixed)
    SELECT video_id, vec_id, {q6('m[1]/nrm', 'first')}, {q6('m[64]/nrm', 'last')}, {q6('list_sum(m)/nrm', 'total')} FROM u""",
)
def interp_vector_l2(spark, sf):
    done = A.interp_vector(*vector_sides(spark, sf), "embedding", 100_000, "t")
    return vector_digest(done)


def vector_digest(done):
    v = F.col("embedding_interp")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return out(done.select("video_id", "vec_id", v[0].alias("first"), v[63].alias("last"), total.alias("total")), "video_id vec_id", floats="first last total")


@query(
    "interp_vector_upsample",
    f"WITH {VAROUND} SELECT video_id, vec_id, {q6('m[1]', 'first')}, {q6('m[64]', 'last')}, {q6('list_sum(m)', 'total')} FROM mixed",
)
def interp_vector_upsample(spark, sf):
    return vector_digest(A.interp_vector(*vector_sides(spark, sf), "embedding", 100_000, "t", renorm=False))


@query(
    "align_report",
    f"""WITH {AROUND}, src AS (SELECT video_id, t_us, t_us - lag(t_us) OVER (PARTITION BY video_id ORDER BY t_us) AS gap FROM s),
    g AS (SELECT video_id, coalesce(max(gap), 0) AS max_gap FROM src GROUP BY video_id),
    p AS (SELECT video_id, avg(coalesce({FLAG}, true)::int) * 100 AS pct FROM n GROUP BY video_id)
    SELECT p.video_id, 'view' AS modality, max_gap IS NOT NULL AS available, {q6('CASE WHEN max_gap IS NULL THEN 0 ELSE pct END', 'interpolated_pct')},
      {q6('CASE WHEN max_gap IS NULL THEN 0 ELSE 100 - pct END', 'coverage_pct')}, {big('coalesce(max_gap, 0)', 'max_gap')},
      coalesce(max_gap IS NOT NULL AND pct > 50, false) AS warn_interpolated, coalesce(max_gap > {48 * HOUR_US}, false) AS warn_gap FROM p LEFT JOIN g USING (video_id)""",
)
def align_report(spark, sf):
    targets, sources = views_and_clicks(spark, sf)
    done = A.align_report(targets, {"view": sources}, 6 * HOUR_US, 48 * HOUR_US, WIDTH_S * 1e6, "t_us")
    return out(done, "video_id modality available warn_interpolated warn_gap", "max_gap", "interpolated_pct coverage_pct")


@query(
    "interval_label",
    f"""WITH {CLIPS}, {TOTALS}, grid AS (SELECT video_id, unnest(range(0, total)) AS frame_idx FROM totals)
    SELECT g.video_id, g.frame_idx, {big('max(CASE WHEN c.video_id IS NULL THEN 0 ELSE 1 END)', 'active')} FROM grid g
    LEFT JOIN clips c ON c.video_id = g.video_id AND c.start_frame <= g.frame_idx AND g.frame_idx < c.end_frame GROUP BY ALL""",
)
def interval_label(spark, sf):
    t = totals(frames(spark, sf)).withColumn("last", F.col("total") - 1)
    return out(A.label_grid(clips(spark, sf), t, "last"), KEYS, "active")


COVER = "LEFT JOIN clips c ON c.video_id = f.video_id AND c.start_frame <= f.frame_idx AND f.frame_idx < c.end_frame"


@query(
    "interval_first_match",
    f"WITH {CLIPS} SELECT f.video_id, f.frame_idx, {big('coalesce(arg_min(c.track, c.ord), -1)', 'track')}, arg_min(c.name, c.ord) AS name FROM frames f {COVER} GROUP BY f.video_id, f.frame_idx",
)
def interval_first_match(spark, sf):
    f = frames(spark, sf).select("video_id", "frame_idx")
    return out(A.frame_first_match(f, clips(spark, sf), "ord", ["track", "name"], {"track": -1}), KEYS + " name", "track")


@query(
    "interval_concat",
    f"WITH {CLIPS} SELECT f.video_id, f.frame_idx, string_agg(c.name, ' | ' ORDER BY c.ord) AS caption_text, {big('count(c.ord) > 0', 'caption_active')} FROM frames f {COVER} GROUP BY f.video_id, f.frame_idx",
)
def interval_concat(spark, sf):
    f = frames(spark, sf).select("video_id", "frame_idx")
    return out(A.frame_concat(f, clips(spark, sf), "ord", "name"), KEYS + " caption_text", "caption_active")


def cells_sql(start: str, end: str, where: str) -> str:
    return f"""WITH {CLIPS}, {TOTALS}, grid AS (SELECT video_id, unnest(range(0, total + 1)) AS frame_idx FROM totals),
    cells AS (SELECT g.video_id, frame_idx, t.track FROM grid g, range(5) t(track)),
    hit AS (SELECT c.*, {start} AS lo, {end} AS hi FROM clips c JOIN totals USING (video_id) WHERE {where})
    SELECT c.video_id, c.frame_idx, {big('c.track', 'track')}, {big('count(h.ord) > 0', 'active')}, {q6('coalesce(arg_max(h.scale, h.ord), 0)', 'scale')}
    FROM cells c LEFT JOIN hit h ON h.video_id = c.video_id AND h.track = c.track AND h.lo <= c.frame_idx AND c.frame_idx < h.hi
    GROUP BY c.video_id, c.frame_idx, c.track"""


def grid_steps(spark, sf):
    return totals(frames(spark, sf)).withColumn("steps", F.col("total") + 1).drop("total")


@query("clips_to_frames", cells_sql("start_frame", "end_frame", "true"))
def clips_to_frames(spark, sf):
    done = A.clips_to_frames(clips(spark, sf), grid_steps(spark, sf), "steps", ["scale"], "ord", tracks=5)
    return out(done, KEYS, "track active", "scale")


@query("clips_to_source_frames", cells_sql("greatest(0, least(in_frame, total))", "least(out_frame, total + 1)", "enabled"))
def clips_to_source_frames(spark, sf):
    done = A.clips_to_source_frames(clips(spark, sf), grid_steps(spark, sf), "steps", ["scale"], "ord", tracks=5)
    return out(done, KEYS, "track active", "scale")


@query(
    "frame_clip_attrs",
    f"""WITH {CLIPS}, cells AS (SELECT f.video_id, f.frame_idx, t.track FROM frames f, range(5) t(track))
    SELECT f.video_id, f.frame_idx, {big('f.track', 'track')}, arg_min(c.name, c.ord) AS name, arg_min(c.enabled, c.ord) AS enabled
    FROM cells f {COVER} AND c.track = f.track GROUP BY f.video_id, f.frame_idx, f.track""",
)
def frame_clip_attrs(spark, sf):
    f = frames(spark, sf).select("video_id", "frame_idx", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("track"))
    return out(A.frame_clip_attrs(f, clips(spark, sf), ["name", "enabled"], "ord"), KEYS + " name enabled", "track")


KEYFRAMES = """kf AS (SELECT l_orderkey AS clip, l_linenumber * 10 AS w, arg_min(l_quantity, (l_partkey, l_suppkey, l_quantity)) AS v
    FROM lineitem GROUP BY ALL),
  clip AS (SELECT clip, CASE WHEN clip % 700 = 0 THEN 5.0::double END AS fixed FROM kf GROUP BY clip
           UNION ALL SELECT DISTINCT -l_orderkey - 1, NULL FROM lineitem)"""


@query(
    "keyframe_interp",
    f"""WITH {KEYFRAMES}, f AS (SELECT clip, fixed, unnest(range(0, 81)) AS w FROM clip),
    n AS (SELECT f.clip, f.w, f.fixed, max(k.w) FILTER (k.w <= f.w) AS w0, min(k.w) FILTER (k.w > f.w) AS w1,
      arg_max(k.v, k.w) FILTER (k.w <= f.w) AS v0, arg_min(k.v, k.w) FILTER (k.w > f.w) AS v1 FROM f LEFT JOIN kf k ON k.clip = f.clip GROUP BY ALL)
    SELECT clip, {big('w', 'frame')}, {q6('coalesce(fixed, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((w - w0)/(w1 - w0)) END, 100.0::double)', 'value')} FROM n""",
)
def keyframe_interp(spark, sf):
    li = table(spark, sf, "lineitem")
    kf = li.groupBy(F.col("l_orderkey").alias("clip"), (F.col("l_linenumber") * 10).cast("bigint").alias("when")).agg(
        F.min_by("l_quantity", F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("value")
    )
    fixed = kf.select("clip").distinct().withColumn("fixed", F.when(F.pmod("clip", F.lit(700)) == 0, 5.0))
    bare = li.select((-F.col("l_orderkey") - 1).alias("clip")).distinct()
    every = fixed.unionByName(bare.withColumn("fixed", F.lit(None).cast("double"))).withColumn("length", F.lit(81))
    done = A.keyframe_values(every, kf, "length", "fixed", 100.0).withColumnRenamed("when", "frame")
    return out(done, "clip", "frame", "value")


MAPPING = "mapping AS (SELECT DISTINCT video_id, speaker_id, (video_id * 3 + speaker_id) % 7 AS global_id FROM frames WHERE speaker_id <> 3)"


def mapping(f):
    pairs = f.where(F.col("speaker_id") != 3).select("video_id", "speaker_id").distinct()
    return pairs.withColumn("global_id", F.pmod(F.col("video_id") * 3 + F.col("speaker_id"), F.lit(7)).cast("int"))


@query(
    "speaker_asset_join",
    f"""WITH {FRAMES}, {TRACKS}, {MAPPING} SELECT {big('global_id')}, {big('asset_id')}, {big('count(*)', 'frames')}
    FROM frames f JOIN tracks t USING (video_id, frame_idx) JOIN mapping m ON m.video_id = f.video_id AND m.speaker_id = f.speaker_id
    WHERE t.active = 1 GROUP BY global_id, asset_id""",
)
def speaker_asset_join(spark, sf):
    f = frames(spark, sf)
    return out(A.speaker_asset(f, tracks(f), mapping(f)), "", "global_id asset_id frames")


@query(
    "replace_ids",
    f"""WITH {FRAMES}, {TRACKS}, {MAPPING} SELECT t.video_id, t.frame_idx, {big('t.track', 'track')}, {big('coalesce(m.global_id, t.asset_id)', 'asset_id')}
    FROM tracks t LEFT JOIN (frames f JOIN mapping m ON m.video_id = f.video_id AND m.speaker_id = f.speaker_id)
      ON f.video_id = t.video_id AND f.frame_idx = t.frame_idx""",
)
def replace_ids(spark, sf):
    f = frames(spark, sf)
    return out(A.replace_ids(tracks(f), f, mapping(f)), KEYS, "track asset_id")


@query(
    "time_overlap_diag",
    f"""WITH {AXES}, a AS (SELECT video_id, count(*) AS n, min(time) AS lo, max(time) AS hi FROM feat GROUP BY video_id),
    b AS (SELECT video_id, count(*) AS n, min(time) AS lo, max(time) AS hi FROM lab GROUP BY video_id),
    j AS (SELECT f.video_id, count(*) AS n FROM feat f JOIN lab l ON l.video_id = f.video_id AND l.time = f.time GROUP BY f.video_id),
    c AS (SELECT video_id, count(*) AS n FROM (SELECT video_id, CAST(round(time*100) AS BIGINT) FROM feat INTERSECT SELECT video_id, CAST(round(time*100) AS BIGINT) FROM lab) GROUP BY video_id)
    SELECT a.video_id, {big('a.n', 'left_rows')}, {big('b.n', 'right_rows')}, {q6('a.lo', 'left_from')}, {q6('b.hi', 'right_to')},
      {q6('(a.hi - a.lo)/greatest(a.n - 1, 1)', 'left_step')}, {big('coalesce(j.n, 0)', 'joined_rows')}, {big('coalesce(c.n, 0)', 'common_times')},
      {q6('coalesce(j.n, 0)/a.n', 'retention')}, coalesce(j.n, 0) < 0.5 * a.n AS low
    FROM a JOIN b USING (video_id) LEFT JOIN j USING (video_id) LEFT JOIN c USING (video_id)""",
)
def time_overlap_diag(spark, sf):
    done = A.join_retention(*axes(spark, sf))
    return out(done, "video_id low", "left_rows right_rows joined_rows common_times", "left_from right_to left_step retention")
