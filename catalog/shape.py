"""Comparable output: BIGINT counts and keys, doubles rounded to six places, no negative zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def out(df: DataFrame, keep: str = "", ints: str = "", floats: str = "") -> DataFrame:
    return df.select(
        *keep.split(),
        *[F.col(c).cast("bigint").alias(c) for c in ints.split()],
        *[r6(c).alias(c) for c in floats.split()],
    )


def q6(expr: str, name: str | None = None) -> str:
    """SQL twin of ``r6``."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


def big(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"
