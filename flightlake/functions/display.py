"""Numbers as the readouts show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightlake.functions.values import finite, round_half_up

MISSING = "—"


def _fixed(value: Column, digits: int) -> Column:
    """Decimal text with a set number of digits, rounding the value actually held.

    A number such as 1.15 is held as slightly less and reads 1.1, while 0.25 is
    held exactly and reads 0.3.  The formatter rounds the decimal text instead,
    so where that text ends in a 5 the exact product decides: both halves of
    the value times a power of ten fit a double without rounding.
    """
    size, power = F.abs(value), 10.0 ** (digits + 1)
    high = size.cast("float").cast("double")
    units = F.floor(size * power + 0.5).cast("double")
    short = ((high * power - units) + (size - high) * power) < 0
    down = (units % 10 == 5) & short & (F.abs(size * power - units) < 0.01)
    shown = F.format_string(f"%.{digits}f", F.when(down, (units - 5) / power).otherwise(size))
    return F.when(value < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def duration(us_from_start: Column) -> Column:
    """``m:ss.t``, rounded to tenths before it is split."""
    tenths = round_half_up(F.greatest(us_from_start, F.lit(0)) / F.lit(1e5)).cast("long")
    minutes = F.floor(tenths / 600).cast("long")
    return F.format_string("%d:%04.1f", minutes, (tenths - minutes * 600) / F.lit(10.0))


def fixed(value: Column, digits: int = 0) -> Column:
    return F.when(finite(value).isNotNull(), _fixed(value, digits)).otherwise(MISSING)


def percent(ratio: Column, digits: int = 1) -> Column:
    return fixed(ratio * 100, digits)


def auto(value: Column) -> Column:
    """Whole or >= 1000 plain, the rest to four significant digits."""
    size = F.abs(value)
    plain = (size >= 1000) | (value == F.floor(value))
    scientific = F.format_string("%.3e", value)
    # The exponent after rounding, so that 9.9996 reads 10.00.
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).cast("int")
    shown = F.regexp_replace(scientific, r"e([+-])0", "e$1")
    for power in range(-6, 4):
        shown = F.when(exponent == power, _fixed(value, 3 - power)).otherwise(shown)
    return F.when(finite(value).isNull(), F.lit(MISSING)).otherwise(
        F.when(plain, _fixed(value, 0)).otherwise(shown)
    )


def plot_value(value: Column) -> Column:
    """Whole or >= 1000 plain, else up to three decimals without trailing zeros."""
    plain = (F.abs(value) >= 1000) | (value == F.floor(value))
    trimmed = F.regexp_replace(F.regexp_replace(_fixed(value, 3), r"0+$", ""), r"\.$", "")
    return F.when(finite(value).isNull(), F.lit(MISSING)).otherwise(
        F.when(plain, _fixed(value, 0)).otherwise(trimmed)
    )


def distance(metres: Column) -> Column:
    """Metres below a kilometre, else kilometres; an unknown distance stays NULL."""
    return F.when(metres < 1000, F.concat(_fixed(metres, 1), F.lit(" m"))).when(
        metres.isNotNull(), F.concat(_fixed(metres / 1000, 2), F.lit(" km"))
    )
