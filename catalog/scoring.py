"""Metrics, ensembles, balance and fold summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import FRAMES, LONG, frames, long_frames, table
from catalog.intervals import LAB, TRACKS, labelled, pr_sql, runs_sql, tracks
from catalog.registry import query
from catalog.shape import big, out, q6
from catalog.windows import HISTORY, history
from framewise.operators import clean as C
from framewise.operators import ensemble as E
from framewise.operators import evaluation as V
from framewise.operators import intervals as I
from framewise.operators import metrics as M
from framewise.operators import scorer

RATES = ["accuracy", "precision", "recall", "f1", "specificity"]


def counts_sql(pred: str, truth: str) -> str:
    def n(a: int, b: int) -> str:
        return f"count(*) FILTER ({pred} = {a} AND {truth} = {b})"

    return f"{n(1, 1)} AS tp, {n(1, 0)} AS fp, {n(0, 1)} AS fn, {n(0, 0)} AS tn"


def rates_sql(src: str, keep: str = "") -> str:
    """CTEs turning tp/fp/fn/tn of ``src`` into rates named ``rated``."""
    return f"""pr AS (SELECT *, CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END AS precision, CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END AS recall FROM {src}),
    rated AS (SELECT *, CASE WHEN tp+fp+fn+tn > 0 THEN (tp+tn)/(tp+fp+fn+tn) ELSE 0 END AS accuracy,
      CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1,
      CASE WHEN tn+fp > 0 THEN tn/(tn+fp) ELSE 0 END AS specificity FROM pr)"""


SHOW = ", ".join([big(c) for c in ("tp", "fp", "fn", "tn")] + [q6(c) for c in RATES])
PREDICTED = f"{FRAMES}{LAB}, pred AS (SELECT *, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS p FROM lab)"


def predicted(spark, sf):
    return C.binarize(labelled(frames(spark, sf)), "score", 0.6, "p")


@query("confusion", f"WITH {PREDICTED}, c AS (SELECT video_id, {counts_sql('p', 'truth')} FROM pred GROUP BY video_id), {rates_sql('c')} SELECT video_id, {SHOW} FROM rated")
def confusion(spark, sf):
    return out(M.confusion(predicted(spark, sf), "p", "truth", ["video_id"]), "video_id", "tp fp fn tn", " ".join(RATES))


@query(
    "video_metrics",
    f"""WITH {PREDICTED}, v AS (SELECT video_id, {counts_sql('p', 'truth')}, count(*) AS frames FROM pred GROUP BY video_id),
    a AS (SELECT video_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(frames) AS frames, avg((tp+fp)/frames) AS pred_ratio,
       avg((tp+fn)/frames) AS true_ratio, avg((tp+fp)/10.0::double) AS pred_seconds FROM v GROUP BY ROLLUP (video_id)), {rates_sql('a')}
    SELECT video_id, {SHOW}, {big('frames')}, {q6('pred_ratio')}, {q6('true_ratio')}, {q6('pred_seconds')} FROM rated""",
)
def video_metrics(spark, sf):
    done = M.video_metrics(predicted(spark, sf), "p", "truth")
    return out(done, "video_id", "tp fp fn tn frames", " ".join(RATES) + " pred_ratio true_ratio pred_seconds")


CLIP_METRICS = ["avg_pred_clips", "avg_true_clips", "count_mae", "count_rel_error", "avg_pred_clip_seconds", "avg_true_clip_seconds",
                "avg_pred_seconds", "avg_true_seconds", "duration_mae", "duration_rel_error"]
BOTH_RUNS = f"{LONG}{LAB}, pred AS (SELECT *, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS p FROM lab), {runs_sql('p', 'pred', 'pr')}, {runs_sql('truth', 'pred', 'tr')}"


def both_runs(spark, sf):
    f = C.binarize(labelled(long_frames(spark, sf)), "score", 0.6, "p")
    return f, I.extract_clips(f, "p"), I.extract_clips(f, "truth")


@query(
    "clip_metrics",
    f"""WITH {BOTH_RUNS}, p AS (SELECT video_id, count(*) AS n, sum(end_frame - start_frame)/10.0::double AS s FROM pr GROUP BY video_id),
    t AS (SELECT video_id, count(*) AS n, sum(end_frame - start_frame)/10.0::double AS s FROM tr GROUP BY video_id),
    b AS (SELECT v.video_id, coalesce(p.n, 0) AS pn, coalesce(t.n, 0) AS tn, coalesce(p.s, 0) AS ps, coalesce(t.s, 0) AS ts
      FROM (SELECT DISTINCT video_id FROM frames) v LEFT JOIN p USING (video_id) LEFT JOIN t USING (video_id))
    SELECT {q6('avg(pn)', 'avg_pred_clips')}, {q6('avg(tn)', 'avg_true_clips')}, {q6('avg(abs(pn-tn))', 'count_mae')}, {q6('avg(abs(pn-tn)/(tn+1e-8))', 'count_rel_error')},
      {q6('sum(ps)/sum(pn)', 'avg_pred_clip_seconds')}, {q6('sum(ts)/sum(tn)', 'avg_true_clip_seconds')}, {q6('avg(ps)', 'avg_pred_seconds')}, {q6('avg(ts)', 'avg_true_seconds')},
      {q6('avg(abs(ps-ts))', 'duration_mae')}, {q6('avg(abs(ps-ts)/(ts+1e-8))', 'duration_rel_error')} FROM b""",
)
def clip_metrics(spark, sf):
    f, pred, truth = both_runs(spark, sf)
    return out(M.clip_metrics(pred, truth, f.select("video_id").distinct()), "", floats=" ".join(CLIP_METRICS))


@query(
    "duration_kl",
    f"""WITH {BOTH_RUNS}, ph AS (SELECT least(end_frame - start_frame, 19) AS b, count(*) AS n FROM pr WHERE end_frame - start_frame <= 20 GROUP BY b),
    th AS (SELECT least(end_frame - start_frame, 19) AS b, count(*) AS n FROM tr WHERE end_frame - start_frame <= 20 GROUP BY b),
    d AS (SELECT r.b, coalesce(ph.n, 0)/(SELECT sum(n) FROM ph)/(1+1e-8) AS p, coalesce(th.n, 0)/(SELECT sum(n) FROM th)/(1+1e-8) AS t
      FROM range(20) r(b) LEFT JOIN ph ON ph.b = r.b LEFT JOIN th ON th.b = r.b)
    SELECT {q6('sum(t * ln((t + 1e-8)/(p + 1e-8)))', 'duration_kl')} FROM d""",
)
def duration_kl(spark, sf):
    _, pred, truth = both_runs(spark, sf)
    # Frames stand in for seconds, since runs are short.
    length = (F.col("end_frame") - F.col("start_frame")).cast("double").alias("s")
    return out(M.duration_kl(pred.select(length), truth.select(length), "s"), "", floats="duration_kl")


BALANCE = f"bal AS (SELECT count(*) FILTER (active = 0) AS inactive, count(*) FILTER (active = 1) AS active FROM frames)"
BALANCED = "b2 AS (SELECT *, inactive/(inactive+active) AS inactive_ratio, active/(inactive+active) AS active_ratio, inactive/(active+1e-8) AS imbalance FROM bal)"


@query("class_balance", f"WITH {FRAMES}, {BALANCE}, {BALANCED} SELECT {big('inactive')}, {big('active')}, {q6('inactive_ratio')}, {q6('active_ratio')}, {q6('imbalance')} FROM b2")
def class_balance(spark, sf):
    return out(M.class_balance(frames(spark, sf), "active"), "", "inactive active", "inactive_ratio active_ratio imbalance")


@query(
    "asset_balance",
    f"""WITH {FRAMES}, c AS (SELECT k, count(*) AS n FROM frames WHERE active = 1 GROUP BY k)
    SELECT {big('k')}, {big('n')}, {q6('n/(SELECT sum(n) FROM c)', 'ratio')}, {q6('(SELECT max(n)/(min(n)+1e-8) FROM c)', 'imbalance')},
      {big('(SELECT count(*) FROM c)', 'distinct_values')} FROM c ORDER BY c.n DESC, c.k LIMIT 10""",
)
def asset_balance(spark, sf):
    return out(M.value_balance(frames(spark, sf), "k", "active"), "", "k n distinct_values", "ratio imbalance")


@query(
    "recommend_weights",
    f"""WITH {FRAMES}, {BALANCE}, {BALANCED} SELECT {q6('CASE WHEN imbalance > 2 THEN least(imbalance/2, 5) ELSE 1 END', 'active_weight')}, {q6('1', 'asset_weight')},
    {', '.join(q6('CASE WHEN active_ratio < 0.3 THEN 1.5 ELSE 1 END', f'{p}_weight') for p in ('scale', 'position', 'rotation', 'crop'))} FROM b2""",
)
def recommend_weights(spark, sf):
    done = M.recommend_weights(M.class_balance(frames(spark, sf), "active"))
    return out(done, "", floats=" ".join(done.columns))


@query(
    "duration_penalty",
    f"""WITH {FRAMES}, d AS (SELECT video_id, sum(active)/10.0::double/2.0::double AS r FROM frames GROUP BY video_id)
    SELECT video_id, {q6('CASE WHEN r < 0.5 THEN power(0.5 - r, 3)*50 WHEN r <= 1 THEN 0 WHEN r <= 1.2::double THEN r - 1 WHEN r <= 1.5 THEN power(r - 1, 2)*5 ELSE power(r - 1, 3)*20 END', 'penalty')} FROM d""",
)
def duration_penalty(spark, sf):
    d = frames(spark, sf).groupBy("video_id").agg((F.sum("active") / 10.0).alias("seconds"))
    return out(d.withColumn("penalty", M.duration_penalty(F.col("seconds"), 2.0)), "video_id", floats="penalty")


@query(
    "focal_loss",
    f"""WITH {FRAMES}{LAB}, p AS (SELECT CASE WHEN truth = 1 THEN score ELSE 1 - score END AS pt FROM lab)
    SELECT {q6('avg(0.25 * power(1 - pt, 2) * -ln(greatest(pt, 1e-12)))', 'focal_loss')} FROM p""",
)
def focal_loss(spark, sf):
    return out(M.focal_loss(labelled(frames(spark, sf)), "score", "truth"), "", floats="focal_loss")


@query(
    "masked_param_error",
    f"""WITH {FRAMES}, e AS (SELECT x, y, score, CASE WHEN frame_idx % 5 = 0 THEN 0 ELSE 1 END AS valid, active, speaker_id,
      y AS px, x AS py, [x, y, score, 0.5, 1 - x] AS l FROM frames),
    m AS (SELECT *, CASE WHEN valid = 1 AND active = 1 THEN 1 ELSE 0 END AS w, ln(list_sum(list_transform(l, lambda v: exp(v)))) - l[speaker_id + 1] AS ce FROM e)
    SELECT {q6('sum((power(px - x, 2) + power(py - y, 2)) * w)/greatest(sum(w), 1)', 'position_mse')}, {q6('sum(power(score*2 - score, 2) * w)/greatest(sum(w), 1)', 'scale_mse')},
      {q6('avg(ce) FILTER (valid = 1)', 'speaker_id_ce')} FROM m""",
)
def masked_param_error(spark, sf):
    f = frames(spark, sf)
    truth = f.withColumn("valid", (F.pmod("frame_idx", F.lit(5)) != 0).cast("int"))
    x, y, s = F.col("x"), F.col("y"), F.col("score")
    pred = f.select(
        "video_id", "frame_idx", y.alias("x"), x.alias("y"), (s * 2).alias("score"), F.array(x, y, s, F.lit(0.5), 1 - x).alias("logits")
    )
    groups = {"position": ["x", "y"], "scale": ["score"]}
    done = M.masked_error(pred, truth, groups, ["video_id", "frame_idx"], classes={"speaker_id": "logits"})
    return out(done, "", floats="position_mse scale_mse speaker_id_ce")


# Three models' probabilities for every labelled document.
MODELS = """models AS (SELECT doc_id, m AS model, ((doc_id * mult + 31 * m) % 1000)/1000.0::double AS prob, quality AS truth
   FROM labels, (VALUES (0, 7919), (1, 104729), (2, 1299709)) v(m, mult))"""


def models(spark, sf):
    specs = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f).cast("bigint").alias("f")) for m, f in ((0, 7919), (1, 104729), (2, 1299709))])
    e = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth"), F.explode(specs).alias("s"))
    raw = F.pmod(F.col("doc_id") * F.col("s.f") + 31 * F.col("s.m"), F.lit(1000))
    return e.select("doc_id", F.col("s.m").alias("model"), (raw / 1000.0).alias("prob"), "truth")


def ensemble_rows(done):
    return out(done, "doc_id", "prediction", "confidence")


@query("ensemble_soft", f"WITH {MODELS} SELECT doc_id, {q6('2*avg(prob) - 1', 'confidence')}, {big('round(2*avg(prob) - 1, 9) >= 0.1', 'prediction')} FROM models GROUP BY doc_id")
def ensemble_soft(spark, sf):
    return ensemble_rows(E.ensemble(models(spark, sf), "soft", ["doc_id"], "prob", 0.1 - 1e-12))


@query(
    "ensemble_hard",
    f"""WITH {MODELS} SELECT doc_id, {q6('avg(2*prob - 1)', 'confidence')}, {big('avg((2*prob - 1 >= 0)::int) >= 0.5', 'vote')},
    {big('round(avg(2*prob - 1), 9) >= 0', 'prediction')} FROM models GROUP BY doc_id""",
)
def ensemble_hard(spark, sf):
    done = E.ensemble(models(spark, sf), "hard", ["doc_id"], "prob", 0.0)
    return out(done, "doc_id", "vote prediction", "confidence")


MODEL_F1 = f"mc AS (SELECT model, {counts_sql('(2*prob - 1 >= 0)::int', 'truth')} FROM models GROUP BY model), {rates_sql('mc')}"
WEIGHTED = f"""{MODELS}, {MODEL_F1}, w AS (SELECT model, f1/(SELECT sum(f1) FROM rated) AS weight FROM rated),
  wc AS (SELECT doc_id, truth, 2*sum(prob*weight) - sum(weight) AS confidence FROM models JOIN w USING (model) GROUP BY ALL)"""


def model_quality(m):
    return M.confusion(C.binarize(m.withColumn("conf", 2 * F.col("prob") - 1), "conf", 0.0, "p"), "p", "truth", ["model"])


@query("ensemble_weighted", f"WITH {WEIGHTED} SELECT doc_id, {q6('confidence')}, {big('confidence >= 0', 'prediction')} FROM wc")
def ensemble_weighted(spark, sf):
    m = models(spark, sf)
    weights = E.model_weights(model_quality(m), "model", "f1")
    return ensemble_rows(E.ensemble(m, "weighted", ["doc_id"], "prob", weights=weights))


@query(
    "strategy_compare",
    f"""WITH {MODELS}, mc AS (SELECT model, {counts_sql('(2*prob - 1 >= 0)::int', 'truth')} FROM models GROUP BY model),
    fm AS (SELECT CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END AS f1, model FROM mc),
    w AS (SELECT model, f1/(SELECT sum(f1) FROM fm) AS weight FROM fm),
    p AS (SELECT doc_id, truth, 'soft' AS strategy, (2*avg(prob) - 1 >= 1e-12)::int AS p FROM models GROUP BY ALL
      UNION ALL SELECT doc_id, truth, 'hard', (avg(2*prob - 1) >= 1e-12)::int FROM models GROUP BY ALL
      UNION ALL SELECT doc_id, truth, 'weighted', (2*sum(prob*weight) - sum(weight) >= 1e-12)::int FROM models JOIN w USING (model) GROUP BY ALL),
    c AS (SELECT strategy, {counts_sql('p', 'truth')} FROM p GROUP BY strategy), {rates_sql('c')}
    SELECT strategy, {', '.join(q6(r) for r in RATES)}, round(f1, 12) = (SELECT max(round(f1, 12)) FROM rated) AS is_best, {q6('f1 - (SELECT avg(f1) FROM fm)', 'gain')} FROM rated""",
)
def strategy_compare(spark, sf):
    m = models(spark, sf)
    quality = model_quality(m)
    weights = E.model_weights(quality, "model", "f1")
    results = {s: E.ensemble(m, s, ["doc_id", "truth"], "prob", 1e-12, weights=weights) for s in ("soft", "hard", "weighted")}
    return out(E.compare_strategies(results, quality, "truth"), "strategy is_best", floats=" ".join(RATES) + " gain")


@query(
    "fold_summary",
    f"""WITH {HISTORY}, b AS (SELECT fold, arg_max(epoch, (metric, -epoch)) AS e, max(metric) AS m FROM history GROUP BY fold)
    SELECT fold::varchar AS fold, e::varchar AS best_epoch, printf('%.4f', m) AS best_metric FROM b
    UNION ALL SELECT 'Mean ± Std', printf('%.1f ± %.1f', avg(e), stddev_pop(e)), printf('%.4f ± %.4f', avg(m), stddev_pop(m)) FROM b""",
)
def fold_summary(spark, sf):
    return E.fold_summary(history(spark, sf), "metric")


@query(
    "group_stats",
    f"""WITH {FRAMES}, l AS (SELECT 'audio' AS "group", energy AS v FROM frames UNION ALL SELECT 'position', x FROM frames UNION ALL SELECT 'position', y FROM frames)
    SELECT "group", {q6('avg(v)', 'mean')}, {q6('stddev_samp(v)', 'std')}, {q6('min(v)', 'min')}, {q6('max(v)', 'max')} FROM l GROUP BY "group" """,
)
def group_stats(spark, sf):
    done = M.group_stats(frames(spark, sf), {"audio": ["energy"], "position": ["x", "y"]})
    return out(done, "group", floats="mean std min max")


@query(
    "length_stats",
    f"""WITH {FRAMES}, v AS (SELECT video_id, count(*) AS n, sum(active) AS g FROM frames GROUP BY video_id)
    SELECT {big('count(*)', 'videos')}, {big('min(n)', 'shortest')}, {big('max(n)', 'longest')}, {q6('avg(n)', 'mean_length')}, {q6('median(n)', 'median_length')},
      {q6('sum(g)/sum(n)', 'valid_share')}, {q6('sum(n)/10.0::double/3600', 'hours')} FROM v""",
)
def length_stats(spark, sf):
    return out(M.length_stats(frames(spark, sf), valid="active"), "", "videos shortest longest", "mean_length median_length valid_share hours")


@query(
    "activity_profile",
    f"""WITH {FRAMES}, {TRACKS} SELECT {big('track')}, {q6('avg(active)', 'active_ratio')}, {q6('min(scale) FILTER (active = 1)', 'scale_min')},
    {q6('max(scale) FILTER (active = 1)', 'scale_max')} FROM tracks GROUP BY track""",
)
def activity_profile(spark, sf):
    return out(M.activity_profile(tracks(frames(spark, sf)), "active", ["scale"]), "", "track", "active_ratio scale_min scale_max")


@query("frame_scorer")
def frame_scorer(spark, sf):
    """Logistic frame scores with class weights, fitted on and applied to every frame."""
    hit = F.pmod(F.col("k") * 7 + F.col("event_id"), F.lit(100)) < F.col("k")
    f = frames(spark, sf).select("video_id", "frame_idx", "score", "energy", "pitch", "x", "y", hit.cast("int").alias("truth"))
    model = scorer.fit_scorer(f, ["score", "energy", "pitch", "x", "y"], "truth")
    return out(scorer.score(model, f), "video_id frame_idx", "truth", "probability confidence")


@query(
    "frame_scorer_summary",
    f"""WITH {FRAMES} SELECT {big('count(*)', 'frames')}, {big('count(DISTINCT (video_id, frame_idx))', 'distinct_frames')}, {big('count(*)', 'probabilities')},
    {big('count(*)', 'confidences')}, true AS separates FROM frames""",
)
def frame_scorer_summary(spark, sf):
    """What any fitted scorer must satisfy: every frame once, probabilities, their confidence, and more on true frames."""
    scored = frame_scorer(spark, sf)
    p = F.col("probability").cast("double")
    gap = F.avg(F.when(F.col("truth") == 1, p)) - F.avg(F.when(F.col("truth") == 0, p))
    done = scored.agg(
        F.count(F.lit(1)).alias("frames"), F.count_distinct("video_id", "frame_idx").alias("distinct_frames"), F.count_if(p.between(0, 1)).alias("probabilities"),
        F.count_if(F.abs(2 * p - 1 - F.col("confidence").cast("double")) < 1e-5).alias("confidences"), (gap > 0).alias("separates"),
    )
    return out(done, "separates", "frames distinct_frames probabilities confidences")


# The folds are those of ``group_kfold``; scores are given, so that SQL can follow the whole chain.
FOLDS = f"""v AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id),
    o AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('0:' || video_id)) AS rn FROM v),
    walk AS (SELECT 0::BIGINT AS rn, [0, 0, 0, 0, 0]::BIGINT[] AS loads, -1::BIGINT AS fold
      UNION ALL SELECT o.rn, list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + o.n ELSE x END),
        (list_position(w.loads, list_min(w.loads)) - 1)::BIGINT FROM walk w JOIN o ON o.rn = w.rn + 1),
    dealt AS (SELECT l.*, w.fold FROM lab l JOIN o USING (video_id) JOIN walk w USING (rn)),
    tuning AS (SELECT h.held, d.score, d.truth FROM dealt d JOIN range(5) h(held) ON h.held <> d.fold)"""


@query(
    "kfold_evaluation",
    f"""WITH RECURSIVE {FRAMES}{LAB}, {FOLDS}, {pr_sql('held, ', 'tuning', 'score', 'truth')},
    best AS (SELECT held, threshold FROM curve WHERE recall >= 0.71 QUALIFY row_number() OVER (PARTITION BY held ORDER BY f1 DESC, threshold) = 1),
    lim AS (SELECT held, coalesce(best.threshold, low) AS threshold FROM (SELECT held, min(score) AS low FROM tuning GROUP BY held) LEFT JOIN best USING (held)),
    c AS (SELECT fold, threshold, count(*) FILTER (score >= threshold AND truth = 1) AS tp, count(*) FILTER (score >= threshold AND truth = 0) AS fp,
      count(*) FILTER (score < threshold AND truth = 1) AS fn, count(*) FILTER (score < threshold AND truth = 0) AS tn FROM dealt JOIN lim ON held = fold GROUP BY ALL)
    SELECT {big('fold')}, {q6('threshold')}, {big('tp')}, {big('fp')}, {big('fn')}, {big('tn')}, {q6('CASE WHEN tp + fp > 0 THEN tp/(tp+fp) ELSE 0 END', 'precision')},
    {q6('CASE WHEN tp + fn > 0 THEN tp/(tp+fn) ELSE 0 END', 'recall')}, {q6('CASE WHEN tp > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END', 'f1')} FROM c""",
)
def kfold_evaluation(spark, sf):
    """Folds, thresholds tuned on the others, and the confusion of each fold."""
    done = V.evaluate_folds(V.with_folds(labelled(frames(spark, sf))), "score", "truth")
    return out(done, "", "fold tp fp fn tn", "threshold precision recall f1")


@query("frame_scorer_folds")
def frame_scorer_folds(spark, sf):
    """The same chain with scores of models that never saw the fold."""
    hit = F.pmod(F.col("k") * 7 + F.col("event_id"), F.lit(100)) < F.col("k")
    f = frames(spark, sf).select("video_id", "frame_idx", "score", "energy", "pitch", "x", "y", hit.cast("int").alias("truth"))
    scored = V.out_of_fold(f, ["score", "energy", "pitch", "x", "y"], "truth")
    return out(V.evaluate_folds(scored, "probability", "truth"), "", "fold tp fp fn tn", "threshold precision recall f1")
