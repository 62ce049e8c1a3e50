"""Projection, cleaning and rule-based labelling of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from framewise.functions import vectors as V
from framewise.plans import blocks


def project_existing(df: DataFrame, groups: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Keep the requested columns that exist; a trailing ``*`` asks for a prefix.

    Resolved from the schema at plan time, so the scan reads only what is kept.
    """
    wanted: list[str] = []
    for names in groups.values():
        for name in names:
            if name.endswith("*"):
                wanted += [c for c in df.columns if c.startswith(name[:-1])]
            elif name in df.columns:
                wanted.append(name)
    return df.select(*dict.fromkeys([*keep, *wanted]))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Read text as numbers; whatever does not parse becomes 0."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in cols})


def finite(c: Column) -> Column:
    """0 for null, NaN and infinities."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(c)


def clean_nonfinite(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def validate_domains(df: DataFrame) -> DataFrame:
    """Count values outside {0, 1} in every ``*active*`` column and fractional ``*asset*`` values."""
    checks: dict[str, Column] = {}
    for f in df.schema:
        if not isinstance(f.dataType, NumericType):
            continue
        whole = F.col(f.name).cast("int")
        if "active" in f.name:
            checks[f.name] = ~whole.isin(0, 1)
        elif "asset" in f.name:
            checks[f.name] = F.col(f.name) != whole
    counts = df.agg(*[F.sum(F.coalesce(bad, F.lit(True)).cast("bigint")).alias(c) for c, bad in checks.items()])
    return counts.unpivot([], list(checks), "column", "violations")


def fit_width(df: DataFrame, vec: str, width: int) -> DataFrame:
    return df.withColumn(vec, V.fit_width(V.as_double(F.col(vec)), width))


def mask_when(df: DataFrame, cols: Sequence[str], condition: Column) -> DataFrame:
    """Zero the columns where the condition holds (e.g. face values where no face was found)."""
    return df.withColumns({c: F.when(condition, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in cols})


def binarize(df: DataFrame, score: str, threshold, out: str = "active", strict: bool = False) -> DataFrame:
    """1 where the score reaches (``strict``: exceeds) a threshold value or column."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = F.col(score) > limit if strict else F.col(score) >= limit
    return df.withColumn(out, hit.cast("int"))


def apply_thresholds(
    df: DataFrame, thresholds: DataFrame, score: str, key: str = "video_id", order: str = "frame_idx",
    out: str = "active", strict: bool = False,
) -> DataFrame:
    """Binarize with one threshold per video."""
    joined = blocks.join_per_key(df, thresholds.select(key, F.col("threshold").alias("_thr")), key, order)
    return binarize(joined, score, F.col("_thr"), out, strict).drop("_thr")


def confidence(l0: Column, l1: Column) -> Column:
    """Softmax over two logits as ``p1 - p0``, safe for large logits."""
    return F.tanh((l1 - l0) / 2)


def active_probability(l0: Column, l1: Column) -> Column:
    return (1 + confidence(l0, l1)) / 2


def vector_to_tracks(df: DataFrame, vec: str, params: int = 12, key=("video_id", "frame_idx")) -> DataFrame:
    """One row per track from a flat ``tracks * params`` vector."""
    count = F.floor(F.size(vec) / params).cast("int")
    return df.select(
        *key,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda t: F.struct(t.alias("track"), F.slice(F.col(vec), t * params + 1, F.lit(params)).alias("values")),
            )
        ).alias("_t"),
    ).select(*key, "_t.track", "_t.values")


def tracks_to_vector(df: DataFrame, key=("video_id", "frame_idx")) -> DataFrame:
    """The reverse: one flat vector per frame, tracks in order."""
    return (
        df.groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("track", "values"))).alias("_t"))
        .select(*key, F.flatten(F.transform("_t", lambda t: t["values"])).alias("vector"))
    )
