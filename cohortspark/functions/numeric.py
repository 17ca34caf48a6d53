"""Numeric helpers: engine-independent rounding, casts, clamps, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_dp(c: Column, dp: int) -> Column:
    """Round half away from zero on the decimal value of ``c``, as DOUBLE.

    Rounding a binary double directly differs between engines on ties such as
    1.005; rounding its DECIMAL(28,10) image is deterministic everywhere.
    """
    return F.round(c.cast("decimal(28,10)"), dp).cast("double")


def round_cast_int(c: Column) -> Column:
    """DOUBLE -> INT as a rounding cast, half to even (18.5 -> 18, 19.5 -> 20),
    which is what a SQL cast of a DOUBLE does in the original study's engine;
    Spark's own cast truncates instead."""
    return F.rint(c).cast("int")


def clamp(c: Column, low: Column, high: Column) -> Column:
    """GREATEST(low, LEAST(high, c)); NULL bounds are ignored."""
    return F.greatest(low, F.least(high, c))


def percent(part: Column, whole: Column, dp: int = 1) -> Column:
    """100 * part / whole rounded; NULL when whole is 0."""
    return round_dp(F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), dp)
