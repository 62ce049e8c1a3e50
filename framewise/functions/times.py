"""Time notations of edit projects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nominal timebase to real frame rate for NTSC material.
NTSC_RATES = {59: 59.94, 29: 29.97, 23: 23.976}


def parse_time(text: Column, timebase: Column | int = 30) -> Column:
    """Seconds from ``"n/ds"``, ``"xs"`` or a frame count; anything else is 0."""
    base = timebase if isinstance(timebase, Column) else F.lit(timebase)
    bare = F.regexp_replace(text, "s$", "")
    upper = F.split_part(bare, F.lit("/"), F.lit(1)).try_cast("double")
    lower = F.split_part(bare, F.lit("/"), F.lit(2)).try_cast("double")
    seconds = (
        F.when(text.contains("/"), F.try_divide(upper, lower))
        .when(text.endswith("s"), bare.try_cast("double"))
        .otherwise(F.try_divide(F.trim(text).try_cast("bigint").cast("double"), base.cast("double")))
    )
    return F.coalesce(seconds, F.lit(0.0))


def real_fps(timebase: Column, ntsc: Column) -> Column:
    """Frame rate of a timebase, corrected for NTSC."""
    rate = timebase.cast("double")
    corrected = rate
    for nominal, real in NTSC_RATES.items():
        corrected = F.when(timebase == nominal, real).otherwise(corrected)
    return F.when(ntsc, corrected).otherwise(rate)
