"""Channel arithmetic on columns: single precision, truncation, rounding and saturation to 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x) -> Column:
    """A column or number in single precision."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def div32(a: Column, b) -> Column:
    """A quotient in single precision; Spark divides floats as doubles."""
    return (a / b).cast("float")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def u8(x: Column) -> Column:
    """Truncated to a whole number and saturated; NaN becomes 0."""
    return clamp(F.nanvl(x.cast("double"), F.lit(0.0)), 0.0, 255.0).cast("int")


def u8_round(x: Column) -> Column:
    """Rounded half away from zero and saturated."""
    x = clamp(x.cast("double"), 0.0, 255.0)
    return F.floor(x + 0.5).cast("int")


def idiv(a: Column, b) -> Column:
    """Whole-number quotient, toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def wrap32(x: Column) -> Column:
    """The low 32 bits of a long, as a non-negative long."""
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def mul32(x: Column, k: int) -> Column:
    """x * k modulo 2**32 for a non-negative x below 2**32, without overflow of a long."""
    low, high = k & 0xFFFF, k >> 16
    return wrap32(wrap32(x * low) + F.shiftleft(wrap32(x * high).bitwiseAND(F.lit(0xFFFF)), 16))
