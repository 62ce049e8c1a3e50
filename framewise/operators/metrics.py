"""Scoring analytics: confusion counts, precision-recall curves, clip and balance statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.plans import blocks


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where undefined."""
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion_counts(pred: Column, truth: Column) -> list[Column]:
    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

    return [
        n((pred == 1) & (truth == 1)).alias("tp"),
        n((pred == 1) & (truth == 0)).alias("fp"),
        n((pred == 0) & (truth == 1)).alias("fn"),
        n((pred == 0) & (truth == 0)).alias("tn"),
    ]


def confusion_rates(eps: float = 0.0) -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def share(a: Column, b: Column) -> Column:
        return a / (b + eps) if eps else ratio(a, b)

    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return {
        "accuracy": share(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": share(2 * precision * recall, precision + recall),
        "specificity": share(tn, tn + fp),
    }


def confusion(df: DataFrame, pred: str, truth: str, by: Sequence[str] = (), eps: float = 0.0) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_counts(F.col(pred), F.col(truth))).withColumns(confusion_rates(eps))


def video_metrics(df: DataFrame, pred: str, truth: str, key: str = "video_id", fps: float = 10.0) -> DataFrame:
    """Per-video counts, ratios and predicted seconds, plus one overall row (null key).

    The overall row has micro-averaged rates and the unweighted means of the per-video ratios.
    """
    per_video = (
        df.groupBy(key)
        .agg(*confusion_counts(F.col(pred), F.col(truth)), F.count(F.lit(1)).alias("frames"))
        .withColumns(
            {
                "pred_ratio": (F.col("tp") + F.col("fp")) / F.col("frames"),
                "true_ratio": (F.col("tp") + F.col("fn")) / F.col("frames"),
                "pred_seconds": (F.col("tp") + F.col("fp")) / fps,
            }
        )
    )
    totals = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "frames")]
    means = [F.avg(c).alias(c) for c in ("pred_ratio", "true_ratio", "pred_seconds")]
    return per_video.rollup(key).agg(*totals, *means).withColumns(confusion_rates())


def pr_curve(df: DataFrame, score: str, label: str, by: str | Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Precision and recall with ``score >= threshold`` for every distinct score; ``weight`` says how many rows a row is.

    Scores are counted first, then suffix sums run per range of scores, of equal size however scores crowd, so
    neither a hot video nor the global curve is sorted in one task.
    """
    keys, many = blocks.as_list(by), F.col(weight) if weight else F.lit(1).cast("bigint")
    counts = (
        df.groupBy(*keys, F.col(score).alias("threshold"))
        .agg(F.sum(many).alias("_n"), F.sum(F.col(label).cast("bigint") * many).alias("_pos"))
    )
    counts = blocks.range_blocks(counts, keys, "threshold")
    swept = blocks.two_phase(
        counts, keys, "threshold",
        backward={"n_pred": ("sum", F.col("_n")), "tp": ("sum", F.col("_pos"))},
        stats={"positives": ("sum", F.col("_pos")), "frames": ("sum", F.col("_n"))},
    )
    precision = F.col("tp") / F.col("n_pred")
    recall = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(1.0)
    return swept.select(
        *keys, "threshold", "n_pred", "tp", "positives", "frames",
        precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def duration_penalty(seconds: Column, target: float) -> Column:
    """Piecewise penalty of a selected duration against its target."""
    r = seconds / target
    return (
        F.when(r < 0.5, F.pow(0.5 - r, F.lit(3.0)) * 50)
        .when(r <= 1.0, 0.0)
        .when(r <= 1.2, r - 1.0)
        .when(r <= 1.5, F.pow(r - 1.0, F.lit(2.0)) * 5)
        .otherwise(F.pow(r - 1.0, F.lit(3.0)) * 20)
    )


def class_balance(df: DataFrame, flag: str) -> DataFrame:
    counted = df.agg(
        F.sum((F.col(flag) == 0).cast("bigint")).alias("inactive"), F.sum((F.col(flag) == 1).cast("bigint")).alias("active")
    )
    total = F.col("inactive") + F.col("active")
    return counted.withColumns(
        {
            "inactive_ratio": F.col("inactive") / total,
            "active_ratio": F.col("active") / total,
            "imbalance": F.col("inactive") / (F.col("active") + 1e-8),
        }
    )


def value_balance(df: DataFrame, value: str, flag: str, top: int = 10) -> DataFrame:
    """The ``top`` values among active rows with their share and the overall max/min imbalance."""
    counts = df.where(F.col(flag) == 1).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.agg(
        F.struct(
            F.sum("n").alias("total"), (F.max("n") / (F.min("n") + 1e-8)).alias("imbalance"),
            F.count(F.lit(1)).alias("distinct_values"),
        )
    ).scalar()
    leading = counts.orderBy(F.col("n").desc(), value).limit(top).withColumn("_all", overall)
    return leading.select(
        value, "n", (F.col("n") / F.col("_all.total")).alias("ratio"), "_all.imbalance", "_all.distinct_values"
    )


def recommend_weights(balance: DataFrame) -> DataFrame:
    """Loss weights from a class balance row."""
    regression = F.when(F.col("active_ratio") < 0.3, 1.5).otherwise(1.0)
    return balance.select(
        F.when(F.col("imbalance") > 2, F.least(F.col("imbalance") / 2, F.lit(5.0))).otherwise(1.0).alias("active_weight"),
        F.lit(1.0).alias("asset_weight"),
        *[regression.alias(f"{p}_weight") for p in ("scale", "position", "rotation", "crop")],
    )


def focal_loss(df: DataFrame, prob: str, truth: str, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Mean focal loss of the active probability against a 0/1 truth."""
    pt = F.when(F.col(truth) == 1, F.col(prob)).otherwise(1 - F.col(prob))
    safe = F.greatest(pt, F.lit(1e-12))
    return df.agg(F.avg(alpha * F.pow(1 - pt, F.lit(gamma)) * -F.log(safe)).alias("focal_loss"))


def cross_entropy(logits: Column, target: Column) -> Column:
    """``-log softmax(logits)[target]`` for an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total) - F.element_at(logits, (target + 1).cast("int"))


def masked_error(
    pred: DataFrame, truth: DataFrame, params: dict[str, Sequence[str]], on: Sequence[str], valid: str = "valid",
    active: str = "active", classes: dict[str, str] | None = None,
) -> DataFrame:
    """Mean squared error per parameter group over active, valid rows, and cross-entropy over valid rows.

    ``classes`` maps a truth column to the prediction column holding its logits.
    """
    t = truth.select(*on, valid, active, *[F.col(p).alias(f"_t_{p}") for g in params.values() for p in g],
                     *[F.col(c).alias(f"_c_{c}") for c in (classes or {})])
    j = pred.join(t, list(on))
    both = F.when((F.col(valid) == 1) & (F.col(active) == 1), 1.0).otherwise(0.0)
    rows = F.greatest(F.sum(both), F.lit(1.0))
    errors = []
    for group, names in params.items():
        squared = sum((F.pow(F.col(p) - F.col(f"_t_{p}"), F.lit(2.0)) for p in names), F.lit(0.0))
        errors.append((F.sum(squared * both) / rows).alias(f"{group}_mse"))
    for column, logits in (classes or {}).items():
        inside = F.when(F.col(valid) == 1, cross_entropy(F.col(logits), F.col(f"_c_{column}")))
        errors.append(F.avg(inside).alias(f"{column}_ce"))
    return j.agg(*errors)


def group_stats(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum over all values of each column group."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("group"), F.col(c).cast("double").alias("v")) for g, names in groups.items() for c in names
    ])).alias("p"))
    return long.groupBy("p.group").agg(
        F.avg("p.v").alias("mean"), F.coalesce(F.stddev_samp("p.v"), F.lit(0.0)).alias("std"),
        F.min("p.v").alias("min"), F.max("p.v").alias("max"),
    )


def length_stats(df: DataFrame, key: str = "video_id", fps: float = 10.0, valid: str | None = None) -> DataFrame:
    """Frames per video: minimum, maximum, mean, median, share of valid rows, total hours."""
    good = F.sum(F.col(valid).cast("bigint")) if valid else F.count(F.lit(1))
    per_video = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), good.alias("_good"))
    counted = per_video.groupBy("_n").agg(F.count(F.lit(1)).alias("_videos"), F.sum("_good").alias("_good"))
    rows = F.sum(F.col("_n") * F.col("_videos"))
    return counted.agg(
        F.sum("_videos").alias("videos"), F.min("_n").alias("shortest"), F.max("_n").alias("longest"),
        (rows / F.sum("_videos")).alias("mean_length"), F.percentile("_n", 0.5, F.col("_videos")).alias("median_length"),
        (F.sum("_good") / rows).alias("valid_share"), (rows / fps / 3600).alias("hours"),
    )


def activity_profile(tracks: DataFrame, active: str, params: Sequence[str], track: str = "track") -> DataFrame:
    """Active share per track and the range of each parameter among active rows."""
    on = F.col(active) == 1
    return tracks.groupBy(track).agg(
        F.avg(on.cast("int")).alias("active_ratio"),
        *[f(F.when(on, F.col(p))).alias(f"{p}_{n}") for p in params for n, f in (("min", F.min), ("max", F.max))],
    )


def clip_metrics(pred: DataFrame, truth: DataFrame, samples: DataFrame, key: str = "video_id", start: str = "start_frame", end: str = "end_frame", fps: float = 10.0) -> DataFrame:
    """Clip count and duration errors of predicted against true clips, averaged over ``samples``."""
    eps = 1e-8

    def per_sample(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(key).agg(
            F.count(F.lit(1)).alias(f"_{p}_n"), (F.sum(F.col(end) - F.col(start)) / fps).alias(f"_{p}_s")
        )

    both = samples.join(per_sample(pred, "p"), key, "left").join(per_sample(truth, "t"), key, "left").fillna(0)
    pn, tn, ps, ts = (F.col(c) for c in ("_p_n", "_t_n", "_p_s", "_t_s"))
    return both.agg(
        F.avg(pn).alias("avg_pred_clips"), F.avg(tn).alias("avg_true_clips"),
        F.avg(F.abs(pn - tn)).alias("count_mae"), F.avg(F.abs(pn - tn) / (tn + eps)).alias("count_rel_error"),
        F.try_divide(F.sum(ps), F.sum(pn)).alias("avg_pred_clip_seconds"), F.try_divide(F.sum(ts), F.sum(tn)).alias("avg_true_clip_seconds"),
        F.avg(ps).alias("avg_pred_seconds"), F.avg(ts).alias("avg_true_seconds"),
        F.avg(F.abs(ps - ts)).alias("duration_mae"), F.avg(F.abs(ps - ts) / (ts + eps)).alias("duration_rel_error"),
    )


def duration_kl(pred: DataFrame, truth: DataFrame, seconds: str, bins: int = 20) -> DataFrame:
    """Divergence of clip length distributions over one-second bins (the last one closed).

    Null if either side has no clip to distribute.
    """
    eps = 1e-8

    def histogram(df: DataFrame, p: str) -> DataFrame:
        inside = df.where(F.col(seconds) <= bins)
        b = F.least(F.floor(seconds), F.lit(bins - 1)).cast("int")
        counted = inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias(f"_{p}"))
        return counted

    spark = pred.sparkSession
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = axis.join(histogram(pred, "p"), "bin", "left").join(histogram(truth, "t"), "bin", "left").fillna(0)
    ps, ts = both.agg(F.sum("_p")).scalar(), both.agg(F.sum("_t")).scalar()
    # A density sums to 1, so normalising divides by 1 + eps.
    norm = both.select((F.try_divide(F.col("_p"), ps) / (1 + eps)).alias("p"), (F.try_divide(F.col("_t"), ts) / (1 + eps)).alias("t"))
    return norm.agg(F.sum(F.col("t") * F.log((F.col("t") + eps) / (F.col("p") + eps))).alias("duration_kl"))
