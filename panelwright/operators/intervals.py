"""Prediction intervals from the champion's past log residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import exact_quantiles, finite_or_null
from panelwright.schemas import CHAMPION

MIN_RESIDUALS = 10


def residuals(features: DataFrame, forecast: str = CHAMPION) -> DataFrame:
    """Rows with positive actual and forecast, and the log residual ``r``."""
    pair = features.select(
        finite_or_null(F.col("txn_amount")).alias("actual"), finite_or_null(F.col(forecast)).alias("forecast")
    )
    return pair.filter((F.col("actual") > 0) & (F.col("forecast") > 0)).withColumn(
        "r", F.ln("actual") - F.ln("forecast")
    )


def residual_log_quantiles(
    features: DataFrame, forecast: str = CHAMPION, low: float = 0.1, high: float = 0.9
) -> DataFrame:
    """One row ``q_low, q_high, n``; both are zero with fewer than ten residuals."""
    quantiles = exact_quantiles(residuals(features, forecast), "r", [low, high])
    enough = F.coalesce(F.max("n"), F.lit(0)) >= MIN_RESIDUALS
    return quantiles.agg(
        F.when(enough, F.max("q0")).otherwise(F.lit(0.0)).alias("q_low"),
        F.when(enough, F.max("q1")).otherwise(F.lit(0.0)).alias("q_high"),
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
    )


def bounds(forecast: Column, quantiles: Column) -> tuple[Column, Column]:
    """Lower and upper bound from a struct with ``q_low`` and ``q_high``."""
    return forecast * F.exp(quantiles["q_low"]), forecast * F.exp(quantiles["q_high"])


def as_scalar(quantiles: DataFrame) -> Column:
    return quantiles.select(F.struct("q_low", "q_high")).scalar()


def coverage(features: DataFrame, forecast: str = CHAMPION, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Share of past actuals inside their own interval; near ``high - low`` when calibrated."""
    q = as_scalar(residual_log_quantiles(features, forecast, low, high))
    rows = residuals(features, forecast).withColumn("q", q)
    lo, hi = bounds(F.col("forecast"), F.col("q"))
    inside = F.col("actual").between(lo, hi)
    return rows.agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"))
