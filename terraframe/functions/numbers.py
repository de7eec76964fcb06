"""Double to text in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(precision: int) -> int:
    return precision if 0 <= precision <= 16 else 16


def _strip(text: Column) -> Column:
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def format_double(v: Column, precision: int = 16) -> Column:
    """Fixed notation, at most ``precision`` decimals (outside 0..16: 16), half to even, no trailing zeros, no -0.

    Above 1e17 in size an exponent (``1e+20``); NaN is ``nan``; infinities spelled out.
    """
    p = clamp(precision)
    size = F.abs(v)
    rounded = F.bround(v.cast("decimal(38,20)"), p).cast("string")
    fixed = _strip(rounded) if p else rounded
    fixed = F.when(fixed == "-0", "0").otherwise(fixed)
    digits = F.split(v.cast("string"), "E")
    mantissa = F.bround(digits[0].cast("decimal(38,20)"), p).cast("string")
    power = F.concat(_strip(mantissa) if p else mantissa, F.lit("e+"), digits[1])
    infinite = F.when(v < 0, "-Infinity").otherwise("Infinity")
    return F.when(F.isnan(v), "nan").when(size == float("inf"), infinite).when(size > 1e17, power).otherwise(fixed)


def round_ordinate(v: Column, precision: float) -> Column:
    """Coordinate precision: 0 keeps, below 0 rounds to single precision, above 0 to 1/precision."""
    if precision == 0:
        return v
    if precision < 0:
        return v.cast("float").cast("double")
    return F.round(v * F.lit(float(precision))) / F.lit(float(precision))
