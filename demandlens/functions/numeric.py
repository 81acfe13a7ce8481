"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x: Column | str, digits: int = 2) -> Column:
    """Scale, round to the nearest even integer, scale back (array-library rounding)."""
    scale = float(10**digits)
    return F.rint(_c(x) * scale) / scale


def round_half_away(x: Column | str, digits: int = 2) -> Column:
    """Ties away from zero, in primitive arithmetic (built-in ``round`` goes through decimals)."""
    scale = float(10**digits)
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)) * scale + 0.5) / scale


def log1p_clamped(x: Column | str) -> Column:
    """``log1p`` with negative input taken as 0."""
    return F.log1p(F.greatest(_c(x), F.lit(0.0)))


def expm1_clamped(x: Column | str) -> Column:
    """Inverse of :func:`log1p_clamped`, never negative."""
    return F.greatest(F.expm1(F.greatest(_c(x), F.lit(0.0))), F.lit(0.0))


def clip_low(x: Column | str, low: float = 0.0) -> Column:
    # greatest() skips NULL, so an absent value has to stay absent explicitly.
    return F.when(_c(x).isNotNull(), F.greatest(_c(x), F.lit(low)))


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _c(x))))


def percent_difference(a: Column | str, b: Column | str) -> Column:
    """(a - b) / b in percent; 0 when b is not positive."""
    return F.when(_c(b) > 0, F.try_divide(_c(a) - _c(b), _c(b)) * 100).otherwise(F.lit(0.0))


def to_number(x: Column | str) -> Column:
    """Double, or NULL where the text is not a number."""
    return _c(x).try_cast("double")


def currency(x: Column | str) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(_c(x), 2))


def min_max(x: Column | str, low: Column | float, high: Column | float) -> Column:
    """Scaled to the fitted range, not clipped; 0 for a constant column."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.when(hi == lo, _c(x) - lo).otherwise(F.try_divide(_c(x) - lo, hi - lo))
