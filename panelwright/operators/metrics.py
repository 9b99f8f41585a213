"""Forecast errors as plain aggregates. Rows without a prediction are left out and counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import finite_or_null, nan_to_null, over_nonzero


def _error(y: str, yhat: str) -> Column:
    return F.col(yhat) - F.col(y)


def mae(y: str = "y_true", yhat: str = "y_pred") -> Column:
    return F.avg(F.abs(_error(y, yhat)))


def rmse(y: str = "y_true", yhat: str = "y_pred") -> Column:
    return F.sqrt(F.avg(_error(y, yhat) * _error(y, yhat)))


def wape(y: str = "y_true", yhat: str = "y_pred") -> Column:
    """Sum of absolute errors over sum of absolute actuals; null when the latter is zero."""
    return over_nonzero(F.sum(F.abs(_error(y, yhat))), F.sum(F.when(F.col(yhat).isNotNull(), F.abs(y))))


def smape(y: str = "y_true", yhat: str = "y_pred") -> Column:
    """Symmetric percentage error in [0, 2]; rows where both sides are zero do not count."""
    size = F.abs(y) + F.abs(yhat)
    return F.avg(over_nonzero(2 * F.abs(_error(y, yhat)), size))


def bias(y: str = "y_true", yhat: str = "y_pred") -> Column:
    """Mean signed error as a part of the mean actual; positive means over-forecast."""
    return over_nonzero(F.avg(_error(y, yhat)), F.avg(F.when(F.col(yhat).isNotNull(), F.col(y))))


def scored(predictions: DataFrame, yhat: str = "y_pred") -> DataFrame:
    """Predictions with NaN and infinite values turned into null, so that they are skipped."""
    return predictions.withColumn(yhat, nan_to_null(finite_or_null(F.col(yhat))))


def summarize(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """All five metrics per group."""
    return scored(predictions).groupBy(*by).agg(
        F.count("y_pred").alias("n_scored"),
        wape().alias("wape"), smape().alias("smape"), mae().alias("mae"),
        rmse().alias("rmse"), bias().alias("bias"),
    )


def error_by_group(predictions: DataFrame, group: str) -> DataFrame:
    """Rows, WAPE and MAE per group, worst first."""
    return (
        scored(predictions).groupBy(group)
        .agg(F.count("*").alias("n"), wape().alias("wape"), mae().alias("mae"))
        .orderBy(F.desc_nulls_last("wape"), group)
    )
