"""The driver's tables seen as recordings: frames, clips, segments, scores, keyframes.

Each Spark adapter has a SQL twin (a chain of CTEs) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.plans import blocks

MINUTE_US = 60_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_base(spark: SparkSession, sf: str, key: Column | None = None) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") if key is None else key).alias("video_id"),
        "event_id",
        "event_type",
        "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def frames(spark: SparkSession, sf: str, key: Column | None = None, once: bool = False) -> DataFrame:
    """Events as frames: dense ``frame_idx`` per video plus feature columns (FIXTURES B1).

    ``once`` is for uses of nearly all columns: one scan of the table instead of two narrower ones.
    """
    base = event_base(spark, sf, key).withColumn("_minute", blocks.int_div("us", MINUTE_US))
    ranked = blocks.two_phase(
        base,
        "video_id",
        ["us", "event_id"],
        running={"frame_idx": ("count", F.lit(1))},
        stats={"us0": ("min", F.col("us"))},
        inclusive=False,
        block="_minute",
        once=once,
    )
    k = F.col("k")
    return ranked.select(
        "video_id",
        F.col("frame_idx").cast("bigint").alias("frame_idx"),
        (F.col("us") - F.col("us0")).alias("t_us"),
        "event_id",
        "event_type",
        "value",
        "k",
        F.col("value").alias("energy"),
        k.cast("double").alias("motion"),
        F.col("event_type").isin("click", "purchase", "view").cast("int").alias("speaking"),
        F.when(F.col("event_type") == "click", 0)
        .when(F.col("event_type") == "error", 1)
        .when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "signup", 3)
        .otherwise(4)
        .alias("speaker_id"),
        F.when(k < 20, 0.0).otherwise(50.0 + 3 * k).alias("pitch"),
        (F.pmod(k, F.lit(10)) / 10.0).alias("x"),
        (F.floor(k / 10) / 10.0).alias("y"),
        (k / 100.0).alias("score"),
        (F.col("value") > 50).cast("int").alias("active"),
    )


def long_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The same frames over ten long videos."""
    return frames(spark, sf, F.pmod(F.col("user_id"), F.lit(10)))


def frames_sql(key: str = "user_id") -> str:
    return f"""
base AS (SELECT {key} AS video_id, event_id, event_type, value, epoch_us(ts) AS us,
                CAST(props->>'$.k' AS INT) AS k FROM events),
frames AS (SELECT video_id,
    row_number() OVER (PARTITION BY video_id ORDER BY us, event_id) - 1 AS frame_idx,
    us - min(us) OVER (PARTITION BY video_id) AS t_us, event_id, event_type, value, k,
    value AS energy, k::double AS motion,
    CASE WHEN event_type IN ('click','purchase','view') THEN 1 ELSE 0 END AS speaking,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                    WHEN 'signup' THEN 3 ELSE 4 END AS speaker_id,
    CASE WHEN k < 20 THEN 0.0::double ELSE 50.0::double + 3*k END AS pitch,
    (k % 10)/10.0::double AS x, (k // 10)/10.0::double AS y, k/100.0::double AS score,
    CASE WHEN value > 50 THEN 1 ELSE 0 END AS active
  FROM base)"""


FRAMES = frames_sql()
LONG = frames_sql("user_id % 10")


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and signups as timeline clips on five tracks (FIXTURES B2)."""
    f = frames(spark, sf, once=True).where(F.col("event_type").isin("purchase", "signup"))
    k = F.col("k").cast("bigint")
    start = F.col("frame_idx")
    end = start + 1 + F.pmod(k, F.lit(12))
    return f.select(
        "video_id",
        F.col("event_id").alias("ord"),
        F.pmod(k, F.lit(5)).cast("int").alias("track"),
        start.alias("start_frame"),
        end.alias("end_frame"),
        (start + 3).alias("in_frame"),
        (end + 3).alias("out_frame"),
        F.concat(F.lit("asset_"), F.pmod(k, F.lit(7)).cast("string"), F.lit(".mp4")).alias("name"),
        F.col("value").alias("scale"),
        (F.pmod(k, F.lit(11)) != 0).alias("enabled"),
        "score",
    )


CLIPS = FRAMES + """,
clips AS (SELECT video_id, event_id AS ord, k % 5 AS track, frame_idx AS start_frame,
    frame_idx + 1 + k % 12 AS end_frame, frame_idx + 3 AS in_frame,
    frame_idx + 4 + k % 12 AS out_frame, 'asset_' || (k % 7) || '.mp4' AS name, value AS scale,
    k % 11 <> 0 AS enabled, score
  FROM frames WHERE event_type IN ('purchase','signup'))"""
