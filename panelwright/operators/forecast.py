"""Next-quarter forecasts with intervals, for a panel of any grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import finite_or_null, over_nonzero, parity_round, scaled, split_child, split_parent
from panelwright.operators import intervals
from panelwright.operators.features import features_and_next
from panelwright.operators.ridge import ALPHA, quarter_sums
from panelwright.schemas import CATEGORIES, CHAMPION, feature_columns
from panelwright.session import settle

FORECAST = [
    "entity", "period_key", "forecast_champion", "forecast_ridge", "forecast_lo", "forecast_hi",
    "last_actual", "growth_vs_last_pct",
]


def next_quarter(
    panel: DataFrame, categories: Sequence[str] = CATEGORIES, ridge: bool = True, alpha: float = ALPHA
) -> DataFrame:
    """One row per entity: champion, ridge, bounds, last actual and growth.

    The panel is settled, as adding the coming quarter reads it three times; so are the
    features, which quantiles, ridge sums and the result all read. No history, no forecast.
    """
    rows = settle(features_and_next(settle(panel), categories))
    train, ahead = rows.filter(~F.col("is_next")), rows.filter("is_next")
    ahead = ahead.filter(train.limit(1).agg(F.count("*")).scalar() > 0)
    names = list(FORECAST)
    if ridge:
        sums = quarter_sums(train, feature_columns(categories))
        ahead = (
            sums.solve(alpha=alpha).predict(ahead, "forecast_ridge")
            if sums else ahead.withColumn("forecast_ridge", F.lit(None).cast("double"))
        )
    else:
        names.remove("forecast_ridge")
    lo, hi = intervals.bounds(F.col(CHAMPION), F.col("q"))
    out = ahead.withColumn("q", intervals.as_scalar(intervals.residual_log_quantiles(train))).withColumns({
        "entity": F.col("state"),
        "forecast_champion": F.col(CHAMPION),
        "forecast_lo": lo,
        "forecast_hi": hi,
        "last_actual": F.col("naive_last"),
        "growth_vs_last_pct": 100 * (over_nonzero(F.col(CHAMPION), F.col("naive_last")) - 1),
    })
    finite = [finite_or_null(F.col(n)).alias(n) for n in names if n not in ("entity", "period_key")]
    return out.select("entity", "period_key", *finite)


def ranked(forecast: DataFrame, top: int | None = None) -> DataFrame:
    """Largest champion forecast first."""
    df = forecast.orderBy(F.desc_nulls_last("forecast_champion"), "entity")
    return df if top is None else df.limit(top)


def split(forecast: DataFrame, child: str) -> DataFrame:
    """Replace the entity id by ``state`` and a child column."""
    return forecast.withColumns({"state": split_parent(F.col("entity")), child: split_child(F.col("entity"))})


def top_children(forecast: DataFrame, child: str, top: int, state: str | None = None) -> DataFrame:
    """Largest category or district forecasts, of all states or one."""
    rows = split(forecast, child)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    return ranked(rows, top).select(
        "state", child, "period_key", "forecast_champion", "forecast_lo", "forecast_hi",
        "last_actual", "growth_vs_last_pct",
    )


def fastest(forecast: DataFrame, child: str = "category", pool: int = 60, top: int = 12) -> DataFrame:
    """Of the ``pool`` largest forecasts, the ``top`` that grow fastest."""
    return (
        top_children(forecast, child, pool)
        .orderBy(F.desc_nulls_last("growth_vs_last_pct"), "state", child).limit(top)
        .select(
            "state", child,
            scaled(F.col("forecast_champion"), 1e7, 0).alias("forecast_cr"),
            parity_round(F.col("growth_vs_last_pct"), 1).alias("growth_pct"),
        )
    )
