"""Rules that read meaning out of clip and file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expression and position words in image names.
EXPRESSIONS = [
    "happy", "sad", "angry", "surprised", "thinking", "confused",
    "smile", "laugh", "cry", "shock", "normal", "neutral",
    "笑顔", "悲しい", "怒り", "驚き", "考え中", "通常", "ノーマル",
    "left", "right", "center", "左", "右", "中央",
]
# File extensions by kind.
VIDEO_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv", ".m4v", ".wmv"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".psd"]
ASSET_IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp"]
# Words that mark a text graphic.
TEXT_WORDS = ["text", "title", "caption", "subtitle", "テキスト", "タイトル", "字幕"]
# Fixed value: longest plausible video in frames (one hour at 30 fps).
LONGEST_VIDEO_FRAMES = 108000
# Captions that carry no words.
EMPTY_CAPTIONS = ["!", "?", ".", "…", "、", "。", "！", "？", "・"]
# Asset classes of the dynamic speaker numbering.
BACKGROUND_WORDS, BACKGROUND_ID = ["background", "bg", "背景"], 8
OVERLAY_WORDS, OVERLAY_ID = ["logo", "ロゴ", "overlay"], 9
GRAPHIC_ID, VIDEO_ID, MAX_SPEAKER_ID = 0, 9, 7


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def speaker_base_name(name: Column) -> Column:
    """Lower-cased name without image extension, expression words and trailing number."""
    bare = F.regexp_replace(F.lower(name), r"\.(png|jpg|jpeg|bmp|tif|tiff|psd)$", "")
    for word in EXPRESSIONS:
        bare = F.regexp_replace(bare, f"[_-]{word}", "")
    return F.btrim(F.regexp_replace(bare, r"[_-]\d+$", ""), F.lit("_- "))


def classify_asset(name: Column, track: Column) -> Column:
    """Asset class from track number and clip name."""
    low = F.lower(name)
    number = F.regexp_extract(name, r"(?i)(class|id)[-_]?(\d+)", 2)
    return (
        F.when(track == 1, 0)
        .when(track == 2, 1)
        .when(track < 3, 0)
        .when(contains_any(low, ASSET_IMAGE_EXTENSIONS), 3)
        .when(contains_any(low, TEXT_WORDS), 2)
        .when(number != "", F.greatest(F.lit(2), number.try_cast("int")))
        .otherwise(2)
    )


def media_type(source: Column, categories: Column, path: Column, file_frames: Column) -> Column:
    """graphic, video or image from media source, effect categories, path and file length."""
    low = F.lower(path)
    return (
        F.when(source.contains("Graphic"), "graphic")
        .when(F.array_contains(categories, "graphic"), "graphic")
        .when(contains_any(low, VIDEO_EXTENSIONS), "video")
        .when(contains_any(low, IMAGE_EXTENSIONS), "image")
        .when(file_frames > LONGEST_VIDEO_FRAMES, "image")
        .otherwise("video")
    )


def is_real_caption(text: Column) -> Column:
    """False for blank, one-character and mark-only captions."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (F.length(bare) > 1) & ~bare.isin(EMPTY_CAPTIONS)


def is_source_clip(name: Column, stem: Column, start: Column, end: Column) -> Column:
    """Clips cut from the recording itself: its stem in the name, an .mp4, and a positive length."""
    return name.contains(stem) & name.endswith(".mp4") & (end > start)
