"""Feature and track tables: CSV scans and sinks, manifests, incremental selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from framewise.operators.windows import KEY, ORDER
from framewise.plans import blocks

D, I, S, B = DoubleType(), IntegerType(), StringType(), BooleanType()

# The layouts of the per-video tables.
FEATURES = StructType(
    [StructField("time", D)]
    + [StructField(c, D) for c in ("audio_energy_rms", "audio_is_speaking", "silence_duration_ms", "speaker_id", "text_is_active")]
    + [StructField("text_word", S), StructField("telop_active", D), StructField("telop_text", S)]
    + [StructField(c, D) for c in ("pitch_f0", "pitch_std", "spectral_centroid", "zcr")]
    + [StructField(f"mfcc_{i}", D) for i in range(13)]
)
TRACKS = StructType(
    [StructField("time", D), StructField("track", I), StructField("active", I), StructField("asset_id", I)]
    + [StructField("clip_name", S), StructField("clip_ref", S), StructField("enabled", B)]
    + [StructField("source_start", D), StructField("source_duration", D), StructField("graphics_text", S)]
    + [StructField(c, D) for c in ("scale", "pos_x", "pos_y", "anchor_x", "anchor_y", "rotation", "crop_l", "crop_r", "crop_t", "crop_b")]
)


def _file_name() -> Column:
    # File names arrive percent-encoded; '+' is literal there but not for the decoder.
    return F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _read_csv(spark: SparkSession, path: str, schema: StructType, suffix: str, key: str) -> DataFrame:
    """CSV files as one table keyed by file stem, or by the directory where the table is partitioned.

    Missing numbers are written ``nan``, ``NaN`` or left empty; all become null.
    """
    if key in schema.fieldNames():
        raise ValueError(f"{key} comes from the file name")
    if "time" not in schema.fieldNames():
        raise ValueError("a per-video table needs a time column")
    raw = spark.read.schema(schema).option("header", "true").option("pathGlobFilter", "*.csv").csv(path)
    stem = F.regexp_extract(_file_name(), rf"^(.*){suffix}\.csv$", 1)
    named = raw if key in raw.columns else raw.withColumn(key, stem)
    clean = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in schema
    ]
    return named.where(F.col(key).cast("string") != "").select(key, *clean)


def read_features(spark: SparkSession, path: str, schema: StructType = FEATURES, key: str = KEY) -> DataFrame:
    """``<video>_features.csv`` files as rows keyed by video."""
    return _read_csv(spark, path, schema, "_features", key)


def read_tracks(spark: SparkSession, path: str, schema: StructType = TRACKS, key: str = KEY) -> DataFrame:
    """``<video>_tracks.csv`` files as long rows keyed by video."""
    return _read_csv(spark, path, schema, "_tracks", key)


def list_inputs(spark: SparkSession, path: str, suffix: str, key: str = KEY) -> DataFrame:
    """File manifest: key (stem without ``suffix``), path and size, without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")
    name = F.try_url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.withColumn(key, F.regexp_extract(name, rf"^(.*){suffix}$", 1))


def write_partitioned_csv(df: DataFrame, path: str, key: str = KEY, order: str = ORDER) -> None:
    """One CSV folder per video; a long video is written by several tasks, block by block."""
    (
        blocks.with_block(df, order)
        .repartition(key, blocks.BLOCK)
        .sortWithinPartitions(key, order)
        .drop(blocks.BLOCK)
        .write.mode("overwrite")
        .option("header", "true")
        .partitionBy(key)
        .csv(path)
    )


def write_dataset(df: DataFrame, path: str, partition: str = "split") -> None:
    """Windows, masks and ids as Parquet, one folder per split."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def manifest_join(tracks: DataFrame, features: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Pairs of files with the same key, and the track files without features."""
    return tracks.join(features, key), tracks.join(features, key, "left_anti")


def skip_processed(source: DataFrame, done: DataFrame, key: str | Sequence[str] = KEY) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return source.join(done.select(*blocks.as_list(key)), blocks.as_list(key), "left_anti")
