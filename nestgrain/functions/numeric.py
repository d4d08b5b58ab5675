"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_TOKENS = ("true", "1", "yes")


def stable(value: Column, digits: int) -> Column:
    """Round after a tiny nudge so that exact ties round alike in every engine."""
    return F.round(value + F.lit(0.00317 * 10 ** -digits), digits)


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def is_finite(value: Column) -> Column:
    """NULL, NaN and infinities are all not finite; never returns NULL."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def parse_flag(value: Column) -> Column:
    """Boolean from a serialised flag: true/1/yes in any case, padding ignored."""
    return F.lower(F.trim(value.cast("string"))).isin(*TRUE_TOKENS)


def number_or_zero(value: Column) -> Column:
    """Blank or unparsable text counts as zero."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def whole_number(value: Column) -> Column:
    """Text such as '12.0' to an integer by truncation; NULL when unparsable."""
    return value.try_cast("double").try_cast("bigint")


def half_even(value: Column, digits: int = 0) -> Column:
    """Banker's rounding (Spark ``round`` is half-up)."""
    return F.rint(value) if digits == 0 else F.bround(value, digits)


def clip(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def guarded_ceil(value: Column, slack: float = 1e-12) -> Column:
    return F.ceil(value - F.lit(slack))


def guarded_floor(value: Column, slack: float = 1e-12) -> Column:
    return F.floor(value + F.lit(slack))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL at zero instead of raising under ANSI mode."""
    return F.try_divide(numerator, denominator)


def circular_phase(angle: Column, fold: int = 12) -> Column:
    """Aggregate: mean direction of ``fold * angle``, folded back to one sector."""
    return F.atan2(F.avg(F.sin(angle * fold)), F.avg(F.cos(angle * fold))) / fold


def polar(x: Column, y: Column, scale: Column | None = None) -> list[Column]:
    """Eccentricity (optionally normalised), sine and cosine of the direction."""
    radius = F.hypot(x, y)
    return [
        (radius if scale is None else ratio(radius, scale)).alias("eccentricity"),
        F.coalesce(ratio(y, radius), F.lit(0.0)).alias("angle_sin"),
        F.coalesce(ratio(x, radius), F.lit(1.0)).alias("angle_cos"),
    ]
