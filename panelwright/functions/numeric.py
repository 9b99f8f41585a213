"""Column helpers for rounding and division. All stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def parity_round(x: Column, digits: int) -> Column:
    """Round half away from zero on the scaled binary value.

    ``F.round`` works on the shortest decimal text and so differs from the usual
    floating-point rule. A value whose scaled size reaches 2**52 has no fraction left
    and is returned as it is, as are NaN and infinities.
    """
    scale = float(10**digits)
    size = F.abs(x) * F.lit(scale)
    rounded = F.signum(x) * F.floor(size + F.lit(0.5)) / F.lit(scale)
    return F.when(size < F.lit(float(2**52)), rounded).otherwise(x)


def scaled(x: Column, divisor: float = 1e7, digits: int = 1) -> Column:
    """A money or count column in larger units, rounded."""
    return parity_round(x / F.lit(float(divisor)), digits)


def over_nonzero(a: Column, b: Column) -> Column:
    """``a / b`` in doubles, null where ``b`` is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with floating-point rules: x/0 is infinite, 0/0 is NaN, null stays null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = (
        F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a == 0, F.lit(float("nan")))
    )
    return F.when(b == 0, by_zero).otherwise(over_nonzero(a, b))


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(None)).otherwise(x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clip_zero(x: Column) -> Column:
    """Negative values become zero; null stays null (``greatest`` would skip it)."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)
