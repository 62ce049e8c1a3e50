"""Combining several models' scores for the same frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators import metrics
from framewise.plans import blocks


def model_weights(quality: DataFrame, model: str, f1: str) -> DataFrame:
    """One weight per model, proportional to its F1; equal weights if every F1 is 0."""
    total, models = quality.agg(F.sum(f1)).scalar(), quality.agg(F.count(F.lit(1))).scalar()
    return quality.select(model, F.coalesce(F.try_divide(F.col(f1), total), 1 / models).alias("weight"))


def _soft(df: DataFrame, keys: Sequence[str], prob: str, **_) -> DataFrame:
    return df.groupBy(*keys).agg((2 * F.avg(prob) - 1).alias("confidence"))


def _hard(df: DataFrame, keys: Sequence[str], prob: str, threshold: float = 0.0, **_) -> DataFrame:
    conf = 2 * F.col(prob) - 1
    return df.groupBy(*keys).agg(
        (F.avg((conf >= threshold).cast("int")) >= 0.5).cast("int").alias("vote"), F.avg(conf).alias("confidence")
    )


def _weighted(df: DataFrame, keys: Sequence[str], prob: str, weights: DataFrame, model: str = "model", **_) -> DataFrame:
    # One row per model; Spark broadcasts it if its measured size allows.
    return (
        df.join(weights, model)
        .groupBy(*keys)
        .agg((2 * F.sum(F.col(prob) * F.col("weight")) - F.sum("weight")).alias("confidence"))
    )


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"soft": _soft, "hard": _hard, "weighted": _weighted}


def ensemble(df: DataFrame, strategy: str, keys: Sequence[str], prob: str, threshold: float = 0.0, **options) -> DataFrame:
    """Mean confidence per frame and the prediction ``confidence >= threshold``.

    ``hard`` also returns the majority ``vote``, which the final prediction does not use.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown voting strategy: {strategy}")
    combined = STRATEGIES[strategy](df, keys, prob, threshold=threshold, **options)
    return combined.withColumn("prediction", (F.col("confidence") >= threshold).cast("int"))


def compare_strategies(results: dict[str, DataFrame], individual: DataFrame, truth: str) -> DataFrame:
    """Metrics per strategy, the best by F1, and its gain over the mean single model.

    ``results`` hold ``prediction`` and ``truth`` per frame; ``individual`` holds one ``f1`` per model.
    """
    tables = [
        metrics.confusion(df, "prediction", truth).select(
            F.lit(name).alias("strategy"), "f1", "accuracy", "precision", "recall", "specificity"
        )
        for name, df in results.items()
    ]
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other)
    best, mean = table.agg(F.max("f1")).scalar(), individual.agg(F.avg("f1")).scalar()
    return table.select("*", (F.col("f1") == best).alias("is_best"), (F.col("f1") - mean).alias("gain"))


def fold_summary(history: DataFrame, metric: str, fold: str = "fold", epoch: str = "epoch") -> DataFrame:
    """Best epoch per fold (first on ties) and a closing row ``mean ± population std``."""
    best = history.groupBy(fold).agg(F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("neg"))).alias("b"))
    rows = best.select(F.col(fold).cast("string").alias("fold"), (-F.col("b.neg")).alias("_epoch"), F.col("b.m").alias("_metric"))
    shown = rows.select(
        "fold", F.col("_epoch").cast("string").alias("best_epoch"), F.format_string("%.4f", "_metric").alias("best_metric")
    )
    closing = rows.agg(
        F.lit("Mean ± Std").alias("fold"),
        F.format_string("%.1f ± %.1f", F.avg("_epoch"), F.stddev_pop("_epoch")).alias("best_epoch"),
        F.format_string("%.4f ± %.4f", F.avg("_metric"), F.stddev_pop("_metric")).alias("best_metric"),
    )
    return shown.unionByName(closing)


def mode_first(df: DataFrame, key: Sequence[str], value: str, order: str, weight: str | None = None) -> DataFrame:
    """Most frequent value per key; the value seen first wins ties. Pre-counted, no per-key sort."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*key, value).agg(n.alias("_n"), F.min(order).alias("_first"))
    rank = F.struct(F.col("_n"), (-F.col("_first")).alias("neg"), F.col(value).alias("value"))
    return counts.groupBy(*key).agg(F.max(rank).alias("_b")).select(*key, F.col("_b.value").alias(value), F.col("_b._n").alias("votes"))


def first_seen_id(df: DataFrame, key: str | Sequence[str], name: str, order: str, modulo: int | None = None, first: int = 0) -> DataFrame:
    """Number names by first appearance within ``key`` (all rows share one numbering if empty).

    Names first seen together are numbered by themselves. The order may be of any type that sorts. Numbers wrap around at ``modulo`` only if it is given; names then share numbers.
    """
    keys = blocks.as_list(key)
    seen = df.groupBy(*keys, name).agg(F.min(order).alias("first_seen"))
    numbered = blocks.positions(blocks.range_blocks(seen, keys, ["first_seen", name]), keys, ["first_seen", name], blocks.BLOCK, "asset_id")
    ident = F.col("asset_id") + first
    return numbered.withColumn("asset_id", F.pmod(ident, F.lit(modulo)) if modulo else ident)
