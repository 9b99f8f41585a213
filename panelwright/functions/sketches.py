"""Approximate quantiles that merge: a sketch for each group and quarter, stored once and never read anew.

Exact quantiles need all rows of a group each time (see ``exact_quantiles``). A sketch of ``K`` keeps a few
kilobytes of a group, whatever its size; sketches of quarters merge to that of any span of them. A quantile
from a sketch is a value of the data whose rank is off by ``rank_error(K)`` of the rows at most, with
a confidence of 99 %; groups of up to ``K`` rows come out exactly. Values are not interpolated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 800
TIME = ["year", "quarter"]


def rank_error(k: int = K) -> float:
    """Largest error of a rank, as a share of the rows (the published bound of this kind of sketch)."""
    return 2.296 / k**0.9021


def sketched(value: Column | str, k: int = K) -> Column:
    """Aggregate: the sketch of a group's values. Nulls take no part."""
    return F.kll_sketch_agg_double(F.col(value) if isinstance(value, str) else value, F.lit(k))


def quantile(sketch: Column | str, share: float) -> Column:
    """The value at a share of a sketch's ranks."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def sketches(rows: DataFrame, value: str, by: Sequence[str], k: int = K) -> DataFrame:
    """``*by, year, quarter, n, sketch`` of the rows' values. One row a group leaves each task."""
    held = rows.filter(F.col(value).isNotNull())
    return held.groupBy(*by, *TIME).agg(F.count("*").alias("n"), sketched(F.col(value).cast("double"), k).alias("sketch"))


def store_sketches(rows: DataFrame, value: str, by: Sequence[str], path: str, k: int = K) -> None:
    """Write the sketches of the quarters that ``rows`` hold, in place of older ones of the same quarters.

    Other quarters stay as they are, and neither they nor the rows behind them are read.
    """
    sketches(rows, value, by, k).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TIME).parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_quantiles(held: DataFrame, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``*by, n, q0, q1, ...`` over all quarters of a frame of sketches."""
    whole = held.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select(*by, "n", *[quantile("sketch", p).alias(f"q{i}") for i, p in enumerate(shares)])
