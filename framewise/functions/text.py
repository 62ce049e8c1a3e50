"""Character-class features of short texts and the registry of text embedders."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes as regular expressions.
CLASSES: dict[str, str] = {
    "hiragana": r"[぀-ゟ]",
    "katakana": r"[゠-ヿ]",
    "kanji": r"[一-鿿]",
    "punctuation": r"[、。！？!?,.，．]",
}
# Fixed value: length that counts as full.
FULL_LENGTH = 50


def text_features(text: Column, classes: Mapping[str, str] | None = None, full_length: int = FULL_LENGTH) -> Column:
    """``[length, one flag per class, min(length / full_length, 1)]``; zeros for null or ''."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("double")
    flags = [
        F.coalesce(text.rlike(pattern), F.lit(False)).cast("double")
        for pattern in (CLASSES if classes is None else classes).values()
    ]
    return F.array(n, *flags, F.least(n / full_length, F.lit(1.0)))


EMBEDDERS: dict[str, Callable[..., Column]] = {"simple": text_features}


def register(name: str, embedder: Callable[..., Column]) -> None:
    """Add an embedder (for example a pandas UDF) under ``name``."""
    EMBEDDERS[name] = embedder


def embed(text: Column, method: str = "simple", **options) -> Column:
    if method not in EMBEDDERS:
        raise ValueError(f"unknown text embedder: {method}")
    return EMBEDDERS[method](text, **options)
