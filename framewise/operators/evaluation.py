"""K-fold evaluation: scores of held-out videos, thresholds from the other folds, confusion per fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators import metrics, scorer, selection
from framewise.operators.datasets import group_kfold
from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks
from framewise.session import written


def with_folds(df: DataFrame, key: str = KEY, order: str = ORDER, folds: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with the ``fold`` of its video."""
    return blocks.join_per_key(df, group_kfold(df, key, folds, seed).select(key, "fold"), key, order)


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, folds: int = 5, key: str = KEY, order: str = ORDER, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``, ``probability`` and ``confidence`` from a scorer that never saw the video's fold.

    Rows without all features are not scored. Every fold fits on the rows and scores them, so they are written before
    they are dealt to folds and afterwards.
    """
    dealt = written(with_folds(written(df, "rows"), key, order, folds, seed), "dealt")
    parts = [scorer.score(scorer.fit_scorer(dealt.where(F.col("fold") != n), features, label), dealt.where(F.col("fold") == n)) for n in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def evaluate_folds(scored: DataFrame, score: str, label: str, folds: int = 5, min_recall: float = 0.71, fold: str = "fold", order: str = ORDER) -> DataFrame:
    """Per fold: the threshold of best F1 with ``min_recall`` on all other folds, and what it yields on this one.

    Rows are counted per fold and score before they meet the folds they help to tune, so the work grows with distinct
    scores. A fold whose others have no such threshold takes their lowest score. Scores are written, as they are read
    for the thresholds and for what these yield.
    """
    scored = written(scored.select(*dict.fromkeys([fold, order, score, label])), "scored")
    counts = scored.groupBy(fold, score, label).agg(F.count(F.lit(1)).alias("_n"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))
    tuning = counts.select(F.explode(others).alias("_held"), score, label, "_n")
    curve = metrics.pr_curve(tuning, score, label, "_held", "_n")
    best = selection.best_threshold(curve, min_recall, "_held").select("_held", "threshold")
    lowest = tuning.groupBy("_held").agg(F.min(score).alias("_lowest"))
    limits = lowest.join(best, "_held", "left").select(F.col("_held").cast("bigint").alias(fold), F.coalesce("threshold", "_lowest").alias("threshold"))
    rated = blocks.join_per_key(scored.withColumn(fold, F.col(fold).cast("bigint")), limits, fold, order)
    return metrics.confusion(rated.withColumn("_pred", (F.col(score) >= F.col("threshold")).cast("int")), "_pred", label, [fold, "threshold"])
