"""Data-quality reports over feature and label tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, NumericType

from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks

# Expected tables and limits of the checks.
AUDIO_COLUMNS = [
    "time", "audio_energy_rms", "audio_is_speaking", "silence_duration_ms", "speaker_id", "text_is_active", "text_word",
    "telop_active", "telop_text",
]
VISUAL_COLUMNS = [
    "scene_change", "visual_motion", "saliency_x", "saliency_y", "face_count", "face_center_x", "face_center_y", "face_size",
    "face_mouth_open", "face_eyebrow_raise",
]
LABEL_COLUMNS = [
    "time", "track", "active", "asset_id", "scale", "pos_x", "pos_y", "anchor_x", "anchor_y", "rotation", "crop_l", "crop_r",
    "crop_t", "crop_b",
]
CLIP_WIDTH, TRACKS = 512, 20
MAX_INTERPOLATED_PCT, MAX_GAP_SECONDS, STEP_TOLERANCE, DURATION_TOLERANCE, GROWTH = 50.0, 5.0, 0.05, 5.0, 1.5


def profile_nonfinite(df: DataFrame, key: str | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Null, NaN and infinite counts per numeric column (and per video if ``key`` is given)."""
    keys = [key] if key else []
    names = list(cols) if cols else [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in keys]

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))

    def counts(name: str) -> Column:
        c = F.col(name)
        floating = isinstance(df.schema[name].dataType, (DoubleType, FloatType))
        nan = count(F.isnan(c)) if floating else F.lit(0).cast("bigint")
        inf = count(F.abs(c) == float("inf")) if floating else F.lit(0).cast("bigint")
        return F.struct(F.lit(name).alias("column"), count(c.isNull()).alias("nulls"), nan.alias("nans"), inf.alias("infs"))

    packed = df.groupBy(*keys).agg(F.array(*[counts(n) for n in names]).alias("_p"), F.count(F.lit(1)).alias("rows"))
    return packed.select(*keys, "rows", F.explode("_p").alias("p")).select(*keys, "rows", "p.*")


def check_time(df: DataFrame, time: str, gap, key=KEY, order=ORDER) -> DataFrame:
    """Rows out of order, gaps above ``gap`` and the largest step, following the ingest order."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("_step", F.col(time) - F.lag(time).over(w))

    stepped = blocks.neighbourhood(df.select(*blocks.as_list(key), order, time), key, order, 1, 0, build)
    step = F.col("_step")
    return stepped.groupBy(*blocks.as_list(key)).agg(
        F.coalesce(F.max(step < 0), F.lit(False)).alias("non_monotonic"),
        F.coalesce(F.sum((step > gap).cast("bigint")), F.lit(0)).alias("gaps"),
        F.coalesce(F.max(step), F.lit(0)).alias("max_gap"),
    )


def check_schema(df: DataFrame, required: Sequence[str], widths: Mapping[str, int] | None = None) -> DataFrame:
    """Problems of a table: missing columns (read off the schema) and vectors of the wrong width."""
    spark = df.sparkSession
    missing = [(c, "missing", 0) for c in [*required, *(widths or {})] if c not in df.columns]
    problems = spark.createDataFrame(missing, "column string, problem string, rows bigint")
    for name, width in (widths or {}).items():
        if name in df.columns and isinstance(df.schema[name].dataType, ArrayType):
            wrong = df.agg(F.coalesce(F.sum((F.size(name) != width).cast("bigint")), F.lit(0)).alias("rows"))
            problems = problems.unionByName(
                wrong.where("rows > 0").select(F.lit(name).alias("column"), F.lit("width").alias("problem"), "rows")
            )
    return problems


def find_issues(
    df: DataFrame, name: str, required: Sequence[str], time: str = "time", gap: float = 1.0, key: str = KEY, order: str = ORDER
) -> DataFrame:
    """Issues of one modality as ``key, issue``: missing columns, missing values, time order, gaps.

    Missing columns are known from the schema, concern every video and end the check.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        text = f"{name} columns missing: {', '.join(absent)}"
        return df.select(key).distinct().withColumn("issue", F.lit(text))
    measured = [c for c in required if c != time and isinstance(df.schema[c].dataType, NumericType)]
    holes = profile_nonfinite(df, key, measured).groupBy(key).agg(F.sum(F.col("nulls") + F.col("nans")).alias("_holes"))
    listed = [c for c in required if isinstance(df.schema[c].dataType, ArrayType)]
    if listed:
        # A vector is missing a value if it is null itself or holds a null or NaN.
        broken = [F.col(c).isNull() | F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double"))) for c in listed]
        vectors = df.groupBy(key).agg(reduce(lambda a, b: a + b, (F.count_if(b) for b in broken)).alias("_vectors"))
        holes = blocks.join_null_safe(holes, vectors, [key]) if measured else vectors.withColumn("_holes", F.lit(0))
        holes = holes.select(key, (F.col("_holes") + F.col("_vectors")).alias("_holes"))
    found = blocks.join_null_safe(check_time(df, time, gap, key, order), holes, [key])
    issues = F.array_compact(F.array(
        F.when(F.col("non_monotonic"), f"{name} timestamps out of order"),
        F.when(F.col("gaps") > 0, f"{name} gaps in time"),
        F.when(F.col("_holes") > 0, f"{name} values missing"),
    ))
    return found.select(key, F.explode(issues).alias("issue"))


def validate_videos(
    tracks: DataFrame, audio: DataFrame | None, visual: DataFrame | None, alignment: DataFrame, findings: DataFrame | None = None,
    key: str = KEY,
) -> DataFrame:
    """Status and issue list per video of the track manifest.

    ``audio`` and ``visual`` list the videos that have such features; ``alignment`` has per video and
    modality ``interpolated_pct`` and ``max_gap`` in seconds; ``findings`` adds rows of ``find_issues``.
    """
    result = tracks.select(key).distinct()
    names = ("audio", "visual")
    measured = alignment.groupBy(key).agg(*[
        F.max(F.when(F.col("modality") == name, F.col(c).cast("double"))).alias(f"{name}_{c}")
        for name in names for c in ("interpolated_pct", "max_gap")
    ])
    result = result.join(measured, key, "left")
    issues: list[Column] = []
    for name, side in zip(names, (audio, visual), strict=True):
        has, pct, gap = f"has_{name}", f"{name}_interpolated_pct", f"{name}_max_gap"
        if side is None:
            result = result.withColumn(has, F.lit(False))
        else:
            present = side.select(key).distinct().withColumn(has, F.lit(True))
            result = result.join(present, key, "left").withColumn(has, F.coalesce(has, F.lit(False)))
        issues += [
            F.when(~F.col(has), f"{name} features not found"),
            F.when(F.col(has) & (F.col(pct) > MAX_INTERPOLATED_PCT), f"{name} high interpolation"),
            F.when(F.col(has) & (F.col(gap) > MAX_GAP_SECONDS), f"{name} large gap"),
        ]
    listed = result.withColumn("issues", F.array_compact(F.array(*issues)))
    if findings is not None:
        # A few kinds of issue per video at most.
        extra = findings.groupBy(key).agg(F.array_sort(F.collect_set("issue")).alias("_extra"))
        none = F.array().cast("array<string>")
        listed = listed.join(extra, key, "left").withColumn("issues", F.concat("issues", F.coalesce("_extra", none))).drop("_extra")
    status = (
        F.when(F.size("issues") == 0, "success")
        .when(~F.col("has_audio") | ~F.col("has_visual"), "missing_features")
        .otherwise("issues_found")
    )
    return listed.withColumn("status", status)


def validation_summary(report: DataFrame) -> DataFrame:
    """Means of coverage and interpolation, largest gaps, and counts of flagged videos."""

    def when_has(name: str, c: Column) -> Column:
        return F.when(F.col(f"has_{name}"), c)

    def flagged(limit: float, suffix: str) -> Column:
        over = [F.coalesce(F.col(f"has_{n}") & (F.col(f"{n}_{suffix}") > limit), F.lit(False)) for n in ("audio", "visual")]
        return F.sum((over[0] | over[1]).cast("bigint"))

    measures = []
    for n in ("audio", "visual"):
        pct = F.col(f"{n}_interpolated_pct")
        measures += [
            F.avg(when_has(n, 100 - pct)).alias(f"avg_{n}_coverage"), F.avg(when_has(n, pct)).alias(f"avg_{n}_interpolation"),
            F.max(when_has(n, F.col(f"{n}_max_gap"))).alias(f"max_{n}_gap"),
        ]
    return report.agg(
        F.count(F.lit(1)).alias("videos"), F.sum((F.col("status") == "success").cast("bigint")).alias("successful"), *measures,
        F.sum((F.size("issues") > 0).cast("bigint")).alias("videos_with_issues"),
        flagged(MAX_INTERPOLATED_PCT, "interpolated_pct").alias("videos_with_high_interpolation"),
        flagged(MAX_GAP_SECONDS, "max_gap").alias("videos_with_large_gaps"),
    )


def _label_side(labels: DataFrame, p: str, time: str, key: str) -> DataFrame:
    """Steps, duration and activity of long label tables; distinct times come from a pre-grouping."""
    per_time = labels.groupBy(key, time).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("active") > 0.5).cast("bigint")).alias("_a"), F.max("track").alias("_t"))
    return per_time.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{p}_steps"), F.max(time).alias(f"{p}_duration"), F.sum("_a").alias(f"{p}_active"),
        F.sum("_n").alias(f"{p}_rows"), (F.max("_t") + 1).alias(f"{p}_tracks"),
    )


def integrity(features: DataFrame, labels: DataFrame, time: str = "time", tracks: int = TRACKS, key: str = KEY) -> DataFrame:
    """Compare features with labels per video: OK, WARNING with issues, or MISSING on one side.

    A table lacking required columns makes every video an ERROR; that is known from the schema.
    """
    broken = [c for c in ("active", "track", time) if c not in labels.columns]
    labels = labels.withColumns({c: F.lit(None).cast("double") for c in broken}) if broken else labels
    f = features.groupBy(key).agg(F.count(F.lit(1)).alias("features_steps"), F.max(time).alias("features_duration"))
    both = f.join(_label_side(labels, "labels", time, key), key, "full_outer")
    step_diff = F.abs(F.col("features_steps") - F.col("labels_steps"))
    time_diff = F.abs(F.col("features_duration") - F.col("labels_duration"))
    issues = F.array_compact(F.array(
        F.when(step_diff > F.greatest("features_steps", "labels_steps") * STEP_TOLERANCE, "steps differ"),
        F.when(time_diff > DURATION_TOLERANCE, "duration differs"),
        F.when(F.col("labels_tracks") != tracks, "unexpected tracks"),
    ))
    missing = F.col("features_steps").isNull() | F.col("labels_steps").isNull()
    return both.select(
        key, "features_steps", "labels_steps", step_diff.alias("step_diff"), time_diff.alias("duration_diff"),
        (F.col("labels_active") / F.col("labels_rows")).alias("active_ratio"), issues.alias("issues"),
        F.when(missing, "MISSING").when(F.lit(bool(broken)), "ERROR").when(F.size(issues) > 0, "WARNING").otherwise("OK").alias("status"),
    )


def label_diff(old: DataFrame, new: DataFrame, time: str = "time", key: str = KEY) -> DataFrame:
    """Steps, duration and active rows of two label versions; ``grown`` beyond 1.5 times the steps."""
    a, b = _label_side(old, "old", time, key), _label_side(new, "new", time, key)
    return a.join(b, key).select(
        key, "old_steps", "new_steps", (F.col("new_steps") - F.col("old_steps")).alias("step_diff"),
        (F.col("new_duration") - F.col("old_duration")).alias("duration_diff"), "old_active", "new_active",
        (F.col("new_steps") > F.col("old_steps") * GROWTH).alias("grown"),
    )


def source_report(sources: DataFrame, path: str, recorder: str) -> DataFrame:
    """Project files by kind of source: the recorder's own files, exported output, unknown, unreadable.

    Output is an .mp4 whose name holds non-ASCII characters and not the recorder's name.
    """
    low = F.lower(F.col(path))
    part = r"(?i)(^|[\\/])(?!(?:[^\\/]*" + recorder + r"))[^\\/]*[^\x00-\x7F][^\\/]*\.mp4($|[\\/])"
    kind = (
        F.when(F.col(path).isNull(), "error").when(low.contains(recorder), "recording")
        .when(F.col(path).rlike(part), "output").otherwise("unknown")
    )
    return sources.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"))


def batch_report(results: DataFrame, ok: Column) -> DataFrame:
    """Succeeded and failed items and the rate."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("succeeded")
    ).select(
        "total", "succeeded", (F.col("total") - F.col("succeeded")).alias("failed"),
        F.when(F.col("total") > 0, F.col("succeeded") / F.col("total") * 100).otherwise(0.0).alias("success_pct"),
    )
