"""Runs, gaps, coverage, overlap, packing and selection under a duration budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import CLIPS, FRAMES, LONG, clips, frames, long_frames, table
from catalog.registry import query
from catalog.shape import big, out, q6
from catalog.windows import KEYS, OVER, weighted_sql
from framewise.operators import clean as C
from framewise.operators import intervals as I
from framewise.operators import metrics as M
from framewise.operators import selection as S
from framewise.operators import smoothing as SM
from framewise.plans import blocks
from framewise.session import materialise

SPAN = "start_frame end_frame"


def runs_sql(flag: str, src: str = "frames", name: str = "runs", key: str = "video_id", where: str | None = None) -> str:
    """CTE of maximal runs of ``flag`` = 1 as half-open frame ranges."""
    return f"""{name} AS (SELECT {key}, min(frame_idx) AS start_frame, max(frame_idx) + 1 AS end_frame FROM
      (SELECT {key}, frame_idx, frame_idx - row_number() OVER (PARTITION BY {key} ORDER BY frame_idx) AS g
       FROM {src} WHERE {where or flag + ' = 1'}) GROUP BY {key}, g)"""


def merge_sql(src: str, name: str, gap: int, extra: str = "", key: str = "video_id", s="start_frame", e="end_frame") -> str:
    """CTE merging the ranges of ``src`` whose distance is at most ``gap``."""
    by = f"PARTITION BY {key} ORDER BY {s}, {e}"
    return f"""{name} AS (SELECT {key}, min({s}) AS {s}, max({e}) AS {e}{extra} FROM
      (SELECT *, sum(brk) OVER ({by} ROWS UNBOUNDED PRECEDING) AS g FROM
        (SELECT *, CASE WHEN {s} - max({e}) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap}
                   THEN 0 ELSE 1 END AS brk FROM {src})) GROUP BY {key}, g)"""


@query(
    "islands",
    f"""WITH {LONG}, {runs_sql('active')} SELECT video_id, {big('start_frame')}, {big('end_frame')},
    {q6('start_frame/10.0::double', 'start_time')}, {q6('end_frame/10.0::double', 'end_time')} FROM runs""",
)
def islands(spark, sf):
    return out(I.extract_clips(long_frames(spark, sf), "active"), "video_id", SPAN, "start_time end_time")


@query(
    "speech_segments",
    f"WITH {LONG}, {runs_sql('speaking')} SELECT video_id, {big('start_frame')}, {big('end_frame')} FROM runs WHERE end_frame - start_frame >= 5",
)
def speech_segments(spark, sf):
    return out(I.extract_clips(long_frames(spark, sf), "speaking", min_seconds=0.5), "video_id", SPAN)


CAPTIONED = f"""{FRAMES}, cap AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'c' || k END AS caption FROM frames)"""


@query(
    "caption_runs",
    f"""WITH {CAPTIONED}, {runs_sql('speaking', 'cap')},
    spans AS (SELECT r.*, least(r.end_frame, (SELECT max(frame_idx) FROM cap c WHERE c.video_id = r.video_id)) AS stop FROM runs r)
    SELECT s.video_id, arg_min(c.caption, c.frame_idx) AS text, {big('min(c.t_us)', 'start_time')}, {big('max(c.t_us)', 'end_time')}
    FROM spans s JOIN cap c ON c.video_id = s.video_id AND c.frame_idx BETWEEN s.start_frame AND s.stop
    GROUP BY s.video_id, s.start_frame HAVING count(c.caption) > 0""",
)
def caption_runs(spark, sf):
    f = frames(spark, sf).withColumn("caption", F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), F.col("k").cast("string"))))
    return out(I.caption_runs(f, "speaking", "caption", "t_us"), "video_id text", "start_time end_time")


@query(
    "merge_gaps",
    f"WITH {LONG}, {runs_sql('active')}, {merge_sql('runs', 'merged', 2, ', count(*) AS parts')} SELECT video_id, {big('start_frame')}, {big('end_frame')}, {big('parts')} FROM merged",
)
def merge_gaps(spark, sf):
    found = I.extract_clips(long_frames(spark, sf), "active")
    return out(I.merge_gaps(found, 2, specs={"parts": ("count", F.lit(1))}), "video_id", SPAN + " parts")


@query(
    "merge_nested",
    f"WITH {CLIPS}, {merge_sql('clips', 'merged', 1, ', count(*) AS parts, arg_min(name, (start_frame, end_frame)) AS name')} SELECT video_id, name, {big('start_frame')}, {big('end_frame')}, {big('parts')} FROM merged",
)
def merge_nested(spark, sf):
    specs = {"parts": ("count", F.lit(1)), "name": ("first", F.col("name"))}
    return out(I.merge_gaps(clips(spark, sf), 1, specs=specs), "video_id name", SPAN + " parts")


LEN = "end_frame - start_frame"


@query(
    "clip_refine_merge_first",
    f"WITH {LONG}, {runs_sql('active')}, {merge_sql('runs', 'merged', 1)} SELECT video_id, {big('start_frame')}, {big('end_frame')} FROM merged WHERE {LEN} >= 3",
)
def clip_refine_merge_first(spark, sf):
    return out(I.refine_clips(I.extract_clips(long_frames(spark, sf), "active"), 1, 3), "video_id", SPAN)


@query(
    "clip_refine_filter_first",
    f"""WITH {LONG}, {runs_sql('active')}, kept AS (SELECT * FROM runs WHERE {LEN} >= 2), {merge_sql('kept', 'merged', 2)}
    SELECT video_id, {big('start_frame')}, {big('end_frame')} FROM merged""",
)
def clip_refine_filter_first(spark, sf):
    found = I.extract_clips(long_frames(spark, sf), "active")
    return out(I.refine_clips(found, 2, 2, ("filter", "merge")), "video_id", SPAN)


SCORED = f"""scored AS (SELECT m.video_id, m.start_frame, m.end_frame, sum(f.k)::double / count(*) / 100.0::double AS mean_score
   FROM merged m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx >= m.start_frame AND f.frame_idx < m.end_frame GROUP BY ALL)"""


def scored_clips(spark, sf):
    f = long_frames(spark, sf).withColumn("score", F.col("k").cast("double"))
    merged = I.merge_gaps(I.extract_clips(f, "active"), 1)
    s = I.score_clips(merged, f, "score")
    mean = F.col("mean_score") / 100
    # Whole hundredths, so that both engines order equal scores alike.
    return s.withColumns({"mean_score": mean, "pick": F.round(mean * (F.col("end_frame") - F.col("start_frame")) * 100)})


@query(
    "clip_score",
    f"""WITH {LONG}, {runs_sql('active')}, {merge_sql('runs', 'merged', 1)}, {SCORED}
    SELECT video_id, {big('start_frame')}, {big('end_frame')}, {q6(f'mean_score * ({LEN}) / 10.0::double', 'clip_score')} FROM scored""",
)
def clip_score(spark, sf):
    f = long_frames(spark, sf)
    merged = I.merge_gaps(I.extract_clips(f, "active"), 1)
    return out(I.score_clips(merged, f, "score"), "video_id", SPAN, "clip_score")


def budget_sql(target: int, limit: int) -> str:
    return f"""WITH RECURSIVE {LONG}, {runs_sql('active')}, {merge_sql('runs', 'merged', 1)}, {SCORED},
    ranked AS (SELECT *, {LEN} AS len, row_number() OVER (PARTITION BY video_id
        ORDER BY round(mean_score * ({LEN}) * 100) DESC, start_frame) AS rn FROM scored),
    walk AS (SELECT video_id, 0::BIGINT AS rn, 0::BIGINT AS total, false AS taken, false AS done FROM (SELECT DISTINCT video_id FROM ranked)
      UNION ALL SELECT r.video_id, r.rn,
        CASE WHEN NOT w.done AND w.total + r.len <= {limit} THEN w.total + r.len ELSE w.total END,
        NOT w.done AND w.total + r.len <= {limit},
        w.done OR (CASE WHEN w.total + r.len <= {limit} THEN w.total + r.len ELSE w.total END) >= {target}
      FROM walk w JOIN ranked r ON r.video_id = w.video_id AND r.rn = w.rn + 1)"""


@query(
    "budget_select",
    budget_sql(60, 100)
    + f" SELECT r.video_id, {big('start_frame')}, {big('end_frame')} FROM ranked r JOIN walk w USING (video_id, rn) WHERE w.taken",
)
def budget_select(spark, sf):
    return out(S.select_budget(scored_clips(spark, sf), "pick", 60, 100), "video_id", SPAN)


@query(
    "budget_select_if_over",
    budget_sql(150, 200)
    + f""", totals AS (SELECT video_id, sum(len) AS total_len FROM ranked GROUP BY video_id)
    SELECT r.video_id, {big('start_frame')}, {big('end_frame')} FROM ranked r JOIN walk w USING (video_id, rn)
    JOIN totals t USING (video_id) WHERE w.taken OR t.total_len <= 150""",
)
def budget_select_if_over(spark, sf):
    return out(S.select_budget(scored_clips(spark, sf), "pick", 150, 200, only_if_over=True), "video_id", SPAN)


def grid_sql(target: float, over: float, src: str = "frames", score: str = "score") -> str:
    t = f"{target}::double"
    return f"""lim AS (SELECT video_id, min({score}) AS lo, max({score}) AS hi, count(*) AS n FROM {src} GROUP BY video_id),
    thr AS (SELECT video_id, i, n AS frames, lo, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS thr FROM lim, range(100) r(i)),
    cnt AS (SELECT t.video_id, i, frames, lo, thr, count(f.{score}) AS n FROM thr t LEFT JOIN {src} f
       ON f.video_id = t.video_id AND f.{score} >= t.thr GROUP BY ALL),
    pick AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY
        CASE WHEN n/10.0::double >= {t}/2 AND n/10.0::double <= {t} + {over}::double THEN 0 ELSE 1 END,
        CASE WHEN n/10.0::double >= {t}/2 AND n/10.0::double <= {t} + {over}::double THEN (thr = 0)::int ELSE abs(n/10.0::double - {t}) END, i) AS rn FROM cnt),
    chosen AS (SELECT video_id, CASE WHEN frames/10.0::double < {t}/2 THEN lo - 1 ELSE thr END AS threshold,
        CASE WHEN frames/10.0::double < {t}/2 THEN frames ELSE n END AS active_frames FROM pick WHERE rn = 1)"""


@query("threshold_grid", f"WITH {FRAMES}, {grid_sql(2.0, 1.0)} SELECT video_id, {q6('threshold')}, {big('active_frames')} FROM chosen")
def threshold_grid(spark, sf):
    return out(S.search_threshold(frames(spark, sf), "score", 2.0, over=1.0), "video_id", "active_frames", "threshold")


@query(
    "threshold_grid_strict_window",
    f"WITH {LONG}, {grid_sql(1.0, 0.02)} SELECT video_id, {q6('threshold')}, {big('active_frames')} FROM chosen",
)
def threshold_grid_strict_window(spark, sf):
    return out(S.search_threshold(long_frames(spark, sf), "score", 1.0, over=0.02), "video_id", "active_frames", "threshold")


def pr_sql(key: str = "video_id, ", src: str = "frames", score: str = "score", label: str = "active") -> str:
    part = f"PARTITION BY {key.rstrip(', ')}" if key else ""
    return f"""cnt AS (SELECT {key}{score} AS threshold, count(*) AS n, sum({label}) AS p FROM {src} GROUP BY ALL),
    cum AS (SELECT *, sum(n) OVER ({part} ORDER BY threshold DESC) AS n_pred, sum(p) OVER ({part} ORDER BY threshold DESC) AS tp,
       sum(p) OVER ({part}) AS positives, sum(n) OVER ({part}) AS frames FROM cnt),
    rates AS (SELECT *, tp/n_pred AS precision, CASE WHEN positives > 0 THEN tp/positives ELSE 1 END AS recall FROM cum),
    curve AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1 FROM rates)"""


@query(
    "pr_curve",
    f"WITH {LONG}, {pr_sql()} SELECT video_id, {q6('threshold')}, {big('n_pred')}, {big('tp')}, {q6('precision')}, {q6('recall')}, {q6('f1')} FROM curve",
)
def pr_curve(spark, sf):
    done = M.pr_curve(long_frames(spark, sf), "score", "active", "video_id")
    return out(done, "video_id", "n_pred tp", "threshold precision recall f1")


@query(
    "pr_curve_global",
    f"WITH {FRAMES}, {pr_sql('', score='value')} SELECT {q6('threshold')}, {big('n_pred')}, {big('tp')}, {q6('precision')}, {q6('recall')}, {q6('f1')} FROM curve",
)
def pr_curve_global(spark, sf):
    return out(M.pr_curve(frames(spark, sf), "value", "active"), "", "n_pred tp", "threshold precision recall f1")


def constrained_sql(by: str, lo: float, hi: float, key: str = "video_id") -> str:
    part = f"PARTITION BY {key}" if key else ""
    ks = f"{key}, " if key else ""
    good = f"n_pred/10.0::double >= {lo}::double*0.95 AND n_pred/10.0::double <= {hi}::double*1.05 AND {by} > 0"
    return f"""ranked AS (SELECT *, ({good}) AS ok, min(threshold) OVER ({part}) AS lowest,
       row_number() OVER ({part} ORDER BY ({good}) DESC, CASE WHEN {good} THEN {by} END DESC, threshold) AS rn FROM curve)
    SELECT {ks}{q6(f'CASE WHEN frames/10.0::double < {lo} THEN lowest - 1 WHEN ok THEN threshold ELSE lowest END', 'threshold')},
      {q6(f'CASE WHEN frames/10.0::double >= {lo} AND ok THEN {by} END', f'best_{by}')},
      frames/10.0::double < {lo} AS accept_all FROM ranked WHERE rn = 1"""


# A label that depends on the score, so that curves are not flat.
LAB = ", lab AS (SELECT video_id, frame_idx, score, CASE WHEN (k * 7 + event_id) % 100 < k THEN 1 ELSE 0 END AS truth FROM frames)"


def labelled(f):
    hit = F.pmod(F.col("k") * 7 + F.col("event_id"), F.lit(100)) < F.col("k")
    return f.select("video_id", "frame_idx", "score", hit.cast("int").alias("truth"))


@query("threshold_pr_constrained", f"WITH {FRAMES}{LAB}, {pr_sql(src='lab', label='truth')}, {constrained_sql('f1', 2.0, 3.0)}")
def threshold_pr_constrained(spark, sf):
    done = S.search_threshold_pr(labelled(frames(spark, sf)), "score", "truth", min_seconds=2.0, max_seconds=3.0)
    return out(done, "video_id accept_all", floats="threshold best_f1")


@query("threshold_pr_recall", f"WITH {FRAMES}{LAB}, {pr_sql(src='lab', label='truth')}, {constrained_sql('recall', 2.0, 3.0)}")
def threshold_pr_recall(spark, sf):
    done = S.search_threshold_pr(labelled(frames(spark, sf)), "score", "truth", "recall", min_seconds=2.0, max_seconds=3.0)
    return out(done, "video_id accept_all", floats="threshold best_recall")


@query("threshold_pr_global", f"WITH {FRAMES}{LAB}, {pr_sql('', src='lab', label='truth')}, {constrained_sql('recall', 20.0, 60.0, '')}")
def threshold_pr_global(spark, sf):
    done = S.search_threshold_pr(labelled(frames(spark, sf)), "score", "truth", "recall", (), min_seconds=20.0, max_seconds=60.0)
    return out(done, "accept_all", floats="threshold best_recall")


@query(
    "threshold_bisect",
    f"""WITH {LONG}, lim AS (SELECT video_id, min(score) AS lo, 0.9::double AS hi FROM frames GROUP BY video_id),
    cand AS (SELECT video_id, lo, hi AS thr FROM lim UNION SELECT f.video_id, l.lo, f.score FROM frames f JOIN lim l ON l.video_id = f.video_id AND f.score < l.hi),
    hit AS (SELECT f.video_id, thr, frame_idx FROM cand c JOIN frames f ON f.video_id = c.video_id AND f.score >= c.thr),
    {runs_sql('', 'hit', key='video_id, thr', where='true')},
    dur AS (SELECT video_id, thr, sum(end_frame - start_frame)/10.0::double AS s FROM runs WHERE end_frame - start_frame >= 3 GROUP BY ALL),
    best AS (SELECT video_id, max(thr) AS thr FROM dur WHERE s >= 3.0 GROUP BY video_id)
    SELECT l.video_id, {q6('coalesce(b.thr, l.lo)', 'threshold')}, b.thr IS NOT NULL AS satisfied
    FROM lim l LEFT JOIN best b USING (video_id)""",
)
def threshold_bisect(spark, sf):
    f = long_frames(spark, sf)
    current = f.groupBy("video_id").agg(F.lit(0.9).alias("threshold"))
    return out(S.adjust_threshold(f, "score", current, "threshold", 3.0, 0.3), "video_id satisfied", floats="threshold")


@query(
    "threshold_f1_min_recall",
    f"""WITH {FRAMES}{LAB}, {pr_sql('', src='lab', label='truth')}
    SELECT {q6('threshold')}, {q6('f1')}, {q6('precision')}, {q6('recall')} FROM curve WHERE recall >= 0.71 ORDER BY curve.f1 DESC, curve.threshold LIMIT 1""",
)
def threshold_f1_min_recall(spark, sf):
    curve = M.pr_curve(labelled(frames(spark, sf)), "score", "truth")
    return out(S.best_threshold(curve), "", floats="threshold f1 precision recall")


@query(
    "threshold_sweep",
    f"""WITH {FRAMES}{LAB}, grid AS (SELECT i, 0.1::double + 0.05::double * i AS threshold FROM range(16) r(i)),
    c AS (SELECT i, threshold, count(*) FILTER (score > threshold AND truth = 1) AS tp, count(*) FILTER (score > threshold AND truth = 0) AS fp,
      count(*) FILTER (truth = 1) AS pos FROM grid, lab GROUP BY ALL),
    r AS (SELECT *, tp/(tp+fp+1e-8) AS p, tp/(pos+1e-8) AS rec FROM c), f AS (SELECT *, 2*p*rec/(p+rec+1e-8) AS f1 FROM r)
    SELECT {q6('CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END', 'threshold')}, {q6('f1')} FROM f ORDER BY f.f1 DESC, i LIMIT 1""",
)
def threshold_sweep(spark, sf):
    return out(S.sweep_f1(labelled(frames(spark, sf)), "score", "truth"), "", floats="threshold f1")


# Per-track scores over every frame, with runs of three frames.
TRACKS = """tracks AS (SELECT video_id, frame_idx, t.track,
    (((frame_idx // 3) * 37 + t.track * 29 + video_id * 11) % 100) / 100.0::double AS prob, (k + t.track) % 10 AS asset_id,
    value / 100.0::double AS scale, x, (CASE WHEN frame_idx % 30 < 15 THEN 0 ELSE k % 3 END) / 100.0::double AS crop_l,
    (k % 5) / 10.0::double AS rotation,
    CASE WHEN (frame_idx // 4 + t.track * 3 + video_id) % 3 = 0 THEN 1 ELSE 0 END AS active
  FROM frames, range(5) t(track))"""


def tracks(f):
    t = f.withColumn("track", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    raw = F.floor(F.col("frame_idx") / 3) * 37 + F.col("track") * 29 + F.col("video_id") * 11
    k = F.col("k")
    return t.select(
        "video_id", "frame_idx", "track", (F.pmod(raw, F.lit(100)) / 100.0).alias("prob"),
        F.pmod(k + F.col("track"), F.lit(10)).alias("asset_id"), (F.col("value") / 100.0).alias("scale"), "x",
        (F.when(F.pmod("frame_idx", F.lit(30)) < 15, 0).otherwise(F.pmod(k, F.lit(3))) / 100.0).alias("crop_l"),
        (F.pmod(k, F.lit(5)) / 10.0).alias("rotation"),
        (F.pmod(F.floor(F.col("frame_idx") / 4) + F.col("track") * 3 + F.col("video_id"), F.lit(3)) == 0).cast("int").alias("active"),
    )


BEST = """best AS (SELECT video_id, frame_idx, coalesce(arg_max(track, prob) FILTER (prob > 0.9), -1) AS best_track FROM tracks GROUP BY ALL)"""


@query("best_track", f"WITH {FRAMES}, {TRACKS}, {BEST} SELECT video_id, frame_idx, {big('best_track')} FROM best")
def best_track(spark, sf):
    return out(S.best_track(tracks(frames(spark, sf)), "prob", 0.9), KEYS, "best_track")


SEGMENTS = f"""{BEST}, hit AS (SELECT b.best_track AS track_id, t.* FROM best b JOIN tracks t ON t.video_id = b.video_id
      AND t.frame_idx = b.frame_idx AND t.track = b.best_track),
   grp AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx) AS g FROM hit),
   segs AS (SELECT video_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, avg(prob) AS prob,
      avg(scale) AS scale, floor(median(asset_id)) AS asset_id FROM grp GROUP BY video_id, track_id, g)"""


def segments(spark, sf):
    return S.track_segments(tracks(long_frames(spark, sf)), "prob", 0.9, ["scale"], "asset_id")


@query(
    "track_segments",
    f"""WITH {LONG}, {TRACKS}, {SEGMENTS} SELECT video_id, {big('track_id')}, {big('first_frame')}, {big('last_frame')},
    {q6('prob')}, {q6('scale')}, {big('asset_id')} FROM segs""",
)
def track_segments(spark, sf):
    return out(segments(spark, sf), "video_id", "track_id first_frame last_frame asset_id", "prob scale")


@query(
    "segment_merge_inclusive",
    f"""WITH {LONG}, {TRACKS}, {SEGMENTS},
    gaps AS (SELECT *, CASE WHEN first_frame - lag(last_frame) OVER (PARTITION BY video_id ORDER BY first_frame) - 1 <= 3 THEN 0 ELSE 1 END AS brk FROM segs),
    ids AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY first_frame) AS g FROM gaps),
    m AS (SELECT video_id, min(first_frame) AS first_frame, max(last_frame) AS last_frame, arg_min(track_id, first_frame) AS track_id,
       arg_min(scale, first_frame) AS scale FROM ids GROUP BY video_id, g)
    SELECT video_id, {big('first_frame')}, {big('last_frame')}, {big('track_id')}, {q6('scale')} FROM m WHERE last_frame - first_frame + 1 >= 4""",
)
def segment_merge_inclusive(spark, sf):
    done = S.merge_segments(segments(spark, sf), 3, 4, ["track_id", "scale"])
    return out(done, "video_id", "first_frame last_frame track_id", "scale")


@query(
    "infer_media_type",
    f"""WITH {LONG}, {TRACKS}, {SEGMENTS}, a AS (SELECT s.video_id, s.track_id, s.first_frame, s.last_frame, avg(abs(crop_l)) AS c,
       avg(abs(rotation)) AS r, var_pop(t.scale) AS v FROM segs s JOIN tracks t ON t.video_id = s.video_id AND t.track = s.track_id
       AND t.frame_idx BETWEEN s.first_frame AND s.last_frame GROUP BY ALL)
    SELECT video_id, {big('track_id')}, {big('first_frame')}, {big('last_frame')},
      CASE WHEN c < 0.01 AND r < 0.25 * 4 THEN 'graphic' WHEN v < 0.001 THEN 'image' ELSE 'video' END AS media_type FROM a""",
)
def infer_media_type(spark, sf):
    t = tracks(long_frames(spark, sf)).withColumnRenamed("track", "track_id")
    done = S.infer_media(segments(spark, sf), t, ["crop_l"], "rotation", "scale", ("video_id", "track_id"))
    return out(done, "video_id media_type", "track_id first_frame last_frame")


@query(
    "segment_smooth_params",
    f"""WITH {LONG}, {runs_sql('speaking')}, ins AS (SELECT r.video_id AS v, r.start_frame, r.end_frame, f.frame_idx, f.score FROM runs r
      JOIN frames f ON f.video_id = r.video_id AND f.frame_idx >= r.start_frame AND f.frame_idx < r.end_frame),
    w AS (SELECT *, count(*) OVER (PARTITION BY v, start_frame) AS n, {{smooth}} AS y FROM ins)
    SELECT v AS video_id, {big('start_frame', 'first_frame')}, {big('end_frame - 1', 'last_frame')},
      {q6('avg(CASE WHEN n < 5 THEN score ELSE y END)', 'score')} FROM w GROUP BY v, start_frame, end_frame""".replace(
        "{smooth}",
        "("
        + " + ".join(
            f"coalesce({fn}(score, {k}) OVER (PARTITION BY v, start_frame ORDER BY frame_idx), {edge}(score) OVER (PARTITION BY v, start_frame ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
            for fn, k, edge in (("lag", 2, "first_value"), ("lag", 1, "first_value"), ("lead", 1, "last_value"), ("lead", 2, "last_value"))
        )
        + " + score) / 5",
    ),
)
def segment_smooth_params(spark, sf):
    f = long_frames(spark, sf)
    segs = I.extract_clips(f, "speaking").select(
        "video_id", F.col("start_frame").alias("first_frame"), (F.col("end_frame") - 1).alias("last_frame")
    )
    return out(SM.smooth_segments(segs, f, ["score"], "ma"), "video_id", "first_frame last_frame", "score")


@query(
    "clip_stat_params",
    f"""WITH {FRAMES}, {TRACKS}, {runs_sql('active', 'tracks', key='video_id, track')},
    g AS (SELECT lead(start_frame) OVER (PARTITION BY video_id, track ORDER BY start_frame) - end_frame AS gap FROM runs),
    s AS (SELECT video_id, sum(a) AS len FROM (SELECT video_id, frame_idx, max(active) AS a FROM tracks GROUP BY ALL) GROUP BY video_id)
    SELECT {q6("greatest(2.0::double, least(5.0::double, (SELECT quantile_cont(end_frame - start_frame, 0.25) FROM runs)/10.0::double))", 'min_duration')},
      {q6("greatest(1.0::double, least(3.0::double, (SELECT quantile_cont(gap, 0.75) FROM g)/10.0::double))", 'max_gap')},
      {q6("(SELECT quantile_cont(len, 0.5) FROM s)/10.0::double", 'target_duration')}, {q6("(SELECT quantile_cont(len, 0.9) FROM s)/10.0::double", 'max_duration')}""",
)
def clip_stat_params(spark, sf):
    return out(S.tune_params(tracks(frames(spark, sf)), "active"), "", floats="min_duration max_gap target_duration max_duration")


DIALOGUE = """turns AS (SELECT conv_id AS video_id, turn, text, 20 * length(text) AS dur, (turn * 37) % 700 AS gap FROM conversations),
 seg AS (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY video_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms,
   row_number() OVER (PARTITION BY video_id ORDER BY turn) - 1 AS pos FROM turns),
 segments AS (SELECT *, start_ms + dur AS end_ms FROM seg)"""


def dialogue(spark, sf):
    """Conversation turns as caption segments in milliseconds (FIXTURES B5)."""
    t = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"), "turn", "text",
        (20 * F.length("text")).cast("bigint").alias("dur"), F.pmod(F.col("turn") * 37, F.lit(700)).alias("gap"),
    )
    placed = blocks.two_phase(
        t.withColumn("_b", blocks.int_div("turn", 64)), "video_id", "turn",
        running={"start_ms": ("sum", F.col("dur") + F.col("gap")), "pos": ("count", F.lit(1))}, inclusive=False, block="_b",
    )
    return placed.withColumn("end_ms", F.col("start_ms") + F.col("dur")).drop("_b", "dur", "gap")


@query(
    "merge_short_segments",
    f"""WITH RECURSIVE {DIALOGUE}, cand AS (SELECT *, coalesce(end_ms - start_ms < 2000 AND
       lead(start_ms) OVER (PARTITION BY video_id ORDER BY pos) - end_ms < 500, false) AS c,
       lead(end_ms) OVER (PARTITION BY video_id ORDER BY pos) AS next_end, lead(text) OVER (PARTITION BY video_id ORDER BY pos) AS next_text FROM segments),
    walk AS (SELECT video_id, pos, false AS consumed, c FROM cand WHERE pos = 0
      UNION ALL SELECT n.video_id, n.pos, w.c AND NOT w.consumed, n.c FROM walk w JOIN cand n ON n.video_id = w.video_id AND n.pos = w.pos + 1)
    SELECT c.video_id, {big('c.pos', 'pos')}, {big('start_ms')}, {big('CASE WHEN c.c THEN next_end ELSE end_ms END', 'end_ms')},
      CASE WHEN c.c THEN text || ' ' || next_text ELSE text END AS text FROM cand c JOIN walk w USING (video_id, pos) WHERE NOT w.consumed""",
)
def merge_short_segments(spark, sf):
    done = I.merge_short(dialogue(spark, sf), "text", "start_ms", "end_ms", "pos", 2000, 500)
    return out(done, "video_id text", "pos start_ms end_ms")


@query(
    "split_long_segments",
    f"""WITH {DIALOGUE}, raw AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '([^。、！？.,!?]*[。、！？.,!?]|[^。、！？.,!?]+)', 1),
       lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 0) AS p FROM segments),
    parts AS (SELECT *, CASE WHEN end_ms - start_ms > 5000 AND len(p) > 1 THEN p ELSE [text] END AS q FROM raw),
    opened AS (SELECT video_id, turn, text, start_ms, end_ms, len(q) AS n, unnest(q) AS piece, generate_subscripts(q, 1) - 1 AS part FROM parts),
    cum AS (SELECT *, sum(length(piece)) OVER (PARTITION BY video_id, turn ORDER BY part) AS upto FROM opened)
    SELECT video_id, turn, {big('part')}, piece,
      {q6("start_ms + (upto - length(piece)) * ((end_ms - start_ms)::double / length(text))", 'piece_start')},
      {q6("CASE WHEN n > 1 THEN start_ms + upto * ((end_ms - start_ms)::double / length(text)) ELSE end_ms END", 'piece_end')} FROM cum""",
)
def split_long_segments(spark, sf):
    done = I.split_long(dialogue(spark, sf), "text", "start_ms", "end_ms", 5000, ("video_id", "turn"))
    return out(done, "video_id turn piece", "part", "piece_start piece_end")


TOTALS = "totals AS (SELECT video_id, max(frame_idx) + 1 AS total FROM frames GROUP BY video_id)"


def totals(f):
    return f.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("total"))


@query(
    "complement",
    f"""WITH {CLIPS}, {TOTALS}, inside AS (SELECT c.video_id, start_frame, least(end_frame, total) AS end_frame FROM clips c JOIN totals USING (video_id)),
    {merge_sql('inside', 'merged', 0)},
    cov AS (SELECT video_id, sum({LEN}) AS covered FROM merged GROUP BY video_id),
    g AS (SELECT video_id, end_frame AS a, lead(start_frame) OVER (PARTITION BY video_id ORDER BY start_frame) AS b FROM merged
      UNION ALL SELECT t.video_id, 0, (SELECT min(start_frame) FROM merged m WHERE m.video_id = t.video_id) FROM totals t)
    SELECT g.video_id, {big('a', 'gap_start')}, {big('coalesce(b, total)', 'gap_end')}, {big('coalesce(covered, 0)', 'covered')},
      {q6('coalesce(covered, 0)/total', 'covered_ratio')} FROM g JOIN totals USING (video_id) LEFT JOIN cov USING (video_id) WHERE a < coalesce(b, total)""",
)
def complement(spark, sf):
    t = totals(frames(spark, sf, once=True))
    inside = blocks.join_per_key(clips(spark, sf), t, "video_id", "ord").withColumn("end_frame", F.least("end_frame", "total"))
    return out(I.complement(inside.drop("total"), t, "total"), "video_id", "gap_start gap_end covered", "covered_ratio")


@query(
    "coverage_buckets",
    f"""WITH {CLIPS}, {TOTALS}, inside AS (SELECT c.video_id, start_frame, least(end_frame, total) AS end_frame FROM clips c JOIN totals USING (video_id)),
    hit AS (SELECT DISTINCT video_id, unnest(range(start_frame, end_frame)) AS f FROM inside),
    grid AS (SELECT video_id, unnest(range(0, total // 10 + 1)) AS bucket FROM totals),
    r AS (SELECT g.video_id, g.bucket, count(f)/10.0::double AS ratio FROM grid g LEFT JOIN hit h ON h.video_id = g.video_id AND h.f // 10 = g.bucket GROUP BY ALL)
    SELECT video_id, {big('bucket')}, {q6('ratio')}, CASE WHEN ratio > 0.8 THEN 'full' WHEN ratio > 0.5 THEN 'half' WHEN ratio > 0.2 THEN 'part' ELSE 'none' END AS label FROM r""",
)
def coverage_buckets(spark, sf):
    t = totals(frames(spark, sf, once=True))
    inside = blocks.join_per_key(clips(spark, sf), t, "video_id", "ord").withColumn("end_frame", F.least("end_frame", "total"))
    return out(I.coverage(inside, t, "total"), "video_id label", "bucket", "ratio")


PAIRS = """pairs AS (SELECT a.video_id, a.ord AS clip1, b.ord AS clip2, greatest(a.in_frame, b.in_frame) AS overlap_start,
   least(a.out_frame, b.out_frame) AS overlap_end FROM clips a JOIN clips b ON a.video_id = b.video_id AND a.ord < b.ord
   AND a.in_frame < b.out_frame AND b.in_frame < a.out_frame)"""


@query(
    "overlap_pairs",
    f"""WITH {CLIPS}, {PAIRS}, ends AS (SELECT video_id, clip1 AS ord, overlap_end - overlap_start AS n FROM pairs
      UNION ALL SELECT video_id, clip2, overlap_end - overlap_start FROM pairs)
    SELECT c.video_id, c.ord, {big('count(n)', 'partners')}, {big('coalesce(sum(n), 0)', 'overlap_frames')}
    FROM clips c LEFT JOIN ends e ON e.video_id = c.video_id AND e.ord = c.ord GROUP BY c.video_id, c.ord""",
)
def overlap_pairs(spark, sf):
    return out(I.overlaps(clips(spark, sf), start="in_frame", end="out_frame"), "video_id ord", "partners overlap_frames")


@query(
    "overlap_totals",
    f"""WITH {CLIPS}, {PAIRS} SELECT v.video_id, {big('count(p.clip1)', 'pairs')}, {big('coalesce(sum(overlap_end - overlap_start), 0)', 'overlap_frames')}
    FROM (SELECT DISTINCT video_id FROM clips) v LEFT JOIN pairs p USING (video_id) GROUP BY v.video_id""",
)
def overlap_totals(spark, sf):
    return out(I.overlap_totals(clips(spark, sf), start="in_frame", end="out_frame"), "video_id", "pairs overlap_frames")


@query(
    "overlap_report",
    f"""WITH {CLIPS}, {PAIRS} SELECT video_id, clip1, clip2, {big('overlap_start')}, {big('overlap_end')} FROM pairs
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY clip1, clip2) <= 20""",
)
def overlap_report(spark, sf):
    done = I.overlap_report(clips(spark, sf), "ord", start="in_frame", end="out_frame")
    return out(done, "video_id clip1 clip2", "overlap_start overlap_end")


@query(
    "interval_pack",
    f"""WITH RECURSIVE {CLIPS}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_frame, ord) AS rn FROM clips),
    walk AS (SELECT video_id, 0::BIGINT AS rn, []::BIGINT[] AS lanes, -1::BIGINT AS lane FROM (SELECT DISTINCT video_id FROM o)
      UNION ALL SELECT video_id, rn, CASE WHEN p IS NULL OR p = 0 THEN list_append(lanes, end_frame)
          ELSE lanes[1:p-1] || [end_frame] || lanes[p+1:] END, CASE WHEN p IS NULL OR p = 0 THEN len(lanes) ELSE p - 1 END
      FROM (SELECT o.video_id, o.rn, w.lanes, o.end_frame, list_position(list_transform(w.lanes, lambda t: t <= o.start_frame), true) AS p
            FROM walk w JOIN o ON o.video_id = w.video_id AND o.rn = w.rn + 1))
    SELECT o.video_id, o.ord, {big('w.lane', 'lane')} FROM o JOIN walk w USING (video_id, rn)""",
)
def interval_pack(spark, sf):
    return out(I.pack_lanes(clips(spark, sf), "ord"), "video_id ord", "lane")


@query(
    "usage_stats",
    f"""WITH {FRAMES}, {TRACKS}, v AS (SELECT video_id, max(frame_idx) + 1 AS frames, sum(active) AS used FROM tracks GROUP BY video_id),
    r AS (SELECT video_id, sum(frames) AS frames, sum(used) AS used FROM v GROUP BY ROLLUP (video_id))
    SELECT video_id, {big('frames')}, {big('used')}, {big('frames - used', 'cut')}, {q6('(frames - used)/frames', 'cut_ratio')} FROM r""",
)
def usage_stats(spark, sf):
    return out(I.usage_stats(tracks(frames(spark, sf)), "active"), "video_id", "frames used cut", "cut_ratio")


@query(
    "chunk_scores_avg",
    f"""WITH {LONG}, num AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id),
    ch AS (SELECT video_id, unnest(range(0, CAST(ceil(n / 30.0) AS BIGINT))) AS c FROM num),
    s AS (SELECT f.video_id, f.frame_idx, k * 8 + (c % 5) AS raw FROM frames f JOIN ch ON ch.video_id = f.video_id AND f.frame_idx >= c * 30 AND f.frame_idx < c * 30 + 40)
    SELECT video_id, frame_idx, {q6('avg(raw)', 'raw')}, {big('count(*)', 'chunks')} FROM s GROUP BY video_id, frame_idx""",
)
def chunk_scores_avg(spark, sf):
    chunked = I.chunk_frames(long_frames(spark, sf), 40, 10)
    scored = chunked.withColumn("raw", F.col("k") * 8 + F.pmod("chunk", F.lit(5)))
    return out(I.average_chunks(scored, "raw"), KEYS, "chunks", "raw")


SMOOTHED = "sm AS (" + weighted_sql([n / 35 for n in (-3, 12, 17, 12, -3)]).replace(f"WITH {LONG}", "").replace(
    "SELECT video_id, frame_idx,", "SELECT video_id, frame_idx, k,"
) + ")"


@query(
    "highlight_selection",
    f"""WITH RECURSIVE {LONG}, {SMOOTHED}, {grid_sql(4.0, 1.0, 'sm', 'smoothed')},
    act AS (SELECT s.*, CASE WHEN smoothed >= threshold - 1e-9 THEN 1 ELSE 0 END AS on_ FROM sm s JOIN chosen USING (video_id)),
    {runs_sql('on_', 'act')}, {merge_sql('runs', 'joined', 1)}, merged AS (SELECT * FROM joined WHERE {LEN} >= 2), {SCORED},
    ranked AS (SELECT *, {LEN} AS len, row_number() OVER (PARTITION BY video_id ORDER BY round(mean_score * ({LEN}) * 100) DESC, start_frame) AS rn FROM scored),
    walk AS (SELECT video_id, 0::BIGINT AS rn, 0::BIGINT AS total, false AS taken FROM (SELECT DISTINCT video_id FROM ranked)
      UNION ALL SELECT r.video_id, r.rn, CASE WHEN w.total < 20 AND w.total + r.len <= 30 THEN w.total + r.len ELSE w.total END,
        w.total < 20 AND w.total + r.len <= 30 FROM walk w JOIN ranked r ON r.video_id = w.video_id AND r.rn = w.rn + 1)
    SELECT r.video_id, {big('count(*)', 'clips')}, {q6('sum(len)/10.0::double', 'seconds')}, {big('min(start_frame)', 'first_start')}
    FROM ranked r JOIN walk w USING (video_id, rn) WHERE w.taken GROUP BY r.video_id""",
)
def highlight_selection(spark, sf):
    """Scores to clips: smooth, threshold, runs, merge, score, budget."""
    f = long_frames(spark, sf).select("video_id", "frame_idx", "k", "score")
    smooth = SM.smooth(f, "score", "savgol", window=5, degree=2).withColumn("smoothed", F.round("smoothed", 6))
    # Four steps below start from this table; it is computed once.
    smooth = materialise(smooth)
    chosen = S.search_threshold(smooth, "smoothed", 4.0, over=1.0).withColumn("threshold", F.col("threshold") - 1e-9)
    active = C.apply_thresholds(smooth, chosen, "smoothed", out="on_")
    found = I.refine_clips(I.extract_clips(active, "on_"), 1, 2)
    scored = I.score_clips(found, smooth.withColumn("score", F.col("k").cast("double")), "score")
    pick = F.round(F.col("mean_score") * (F.col("end_frame") - F.col("start_frame")))
    chosen_clips = S.select_budget(scored.withColumn("pick", pick), "pick", 20, 30)
    kept = chosen_clips.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("clips"),
        (F.sum(F.col("end_frame") - F.col("start_frame")) / 10).alias("seconds"),
        F.min("start_frame").alias("first_start"),
    )
    return out(kept, "video_id", "clips first_start", "seconds")
