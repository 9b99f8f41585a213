"""Quarter arithmetic: sortable key, evenly spaced ordinal, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period_key(year: Column | str = "year", quarter: Column | str = "quarter") -> Column:
    """``year * 10 + quarter``: sorts by time but is not evenly spaced."""
    return _col(year) * 10 + _col(quarter)


def period_ord(year: Column | str = "year", quarter: Column | str = "quarter") -> Column:
    """``year * 4 + quarter - 1``: evenly spaced, the axis for lags."""
    return _col(year) * 4 + (_col(quarter) - 1)


def period_label(key: Column | str = "period_key") -> Column:
    key = _col(key)
    return F.format_string("%dQ%d", F.floor(key / 10), key % 10)


def with_periods(df: DataFrame) -> DataFrame:
    return df.withColumns({"period_key": period_key(), "period_ord": period_ord()})


def from_ord(ordinal: Column) -> dict[str, Column]:
    """Year, quarter and key of an ordinal, as columns to add."""
    year, quarter = F.floor(ordinal / 4).cast("int"), (ordinal % 4 + 1).cast("int")
    return {"year": year, "quarter": quarter, "period_key": year * 10 + quarter}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
