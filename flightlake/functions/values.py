"""Expressions on single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names that hold a clock rather than a signal.
TIME_FIELDS = ("TimeUS", "TimeMS", "timeBootMs", "timeUsec", "timeUnixUsec")
SEARCH_TIME_FIELD = "TimeUS"


def finite(value: Column) -> Column:
    """NaN and the infinities are gaps; a gap is NULL everywhere downstream."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def round_half_up(value: Column) -> Column:
    """Halves go toward plus infinity, so -0.5 rounds to 0."""
    return F.floor(value + 0.5)


def scaled(value: Column, factor: Column | float) -> Column:
    return value * (F.lit(factor) if isinstance(factor, (int, float)) else factor)


def known(value: Column, unknown: Column | float) -> Column:
    """NULL where the value is the "unknown" marker."""
    return F.when(value.eqNullSafe(F.lit(unknown) if isinstance(unknown, (int, float)) else unknown), None).otherwise(value)


def turns(delta: Column, period: Column | float) -> Column:
    """Whole periods nearest to ``delta``, in the unit of ``period``."""
    return round_half_up(F.try_divide(delta, F.lit(period))) * F.lit(period)


def align_angle(a: Column, b: Column, period: Column | float = 360.0) -> Column:
    """``b`` moved by whole periods to lie within half a period of ``a``."""
    return a + ((b - a) - turns(b - a, period))


def field_key(message: Column, field: Column) -> Column:
    return F.concat_ws(".", message, field)


def seconds_since(ts_us: Column, start_us: Column) -> Column:
    return (ts_us - start_us) / F.lit(1e6)


def snap(value: Column, low: float, high: float, step: float) -> Column:
    """Nearest stop ``low + k*step`` inside [low, high]; past the end, the last stop."""
    inside = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
    if not step > 0:
        return inside
    stop = F.lit(low) + round_half_up((inside - low) / step) * step
    stop = F.when(stop > high, stop - step).otherwise(stop)
    return F.when(value.isNotNull(), F.least(F.greatest(stop, F.lit(low)), F.lit(high)))


def trailing_number(name: Column) -> Column:
    """Number at the end of a name, 0 when there is none."""
    return F.coalesce(F.regexp_extract(name, r"([0-9]+)$", 1).try_cast("int"), F.lit(0))


def captured_number(name: Column, pattern: str) -> Column:
    """First group of ``pattern`` as a number, NULL when the name does not match."""
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).try_cast("int"))
