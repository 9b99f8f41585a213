"""Strictly lagged features: a row for quarter t reads only t-1 and earlier.

Lags follow the calendar. A range frame of exactly k quarters back, over the evenly spaced
ordinal, finds the quarter itself or nothing, so gaps need no filler rows and no join. All
frames share one partitioning and order: one shuffle and one sort, whatever the number of
features, and a window never holds more than one entity's quarters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.functions import finite_or_null, ratio
from panelwright.functions.periods import from_ord
from panelwright.schemas import BASELINES, CATEGORIES, CORE_LAGS, feature_columns, share_columns

TARGET = "txn_amount"


def _time() -> WindowSpec:
    return Window.partitionBy("state").orderBy("period_ord")


def calendar_lag(column: str, k: int) -> Column:
    """Value of the same entity exactly ``k`` quarters earlier, null if that quarter is missing."""
    return F.max(column).over(_time().rangeBetween(-k, -k))


def engineer(panel: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Every feature and baseline column, for every row of the panel."""
    shares = share_columns(categories)
    lags = {f"a{k}": calendar_lag(TARGET, k) for k in (1, 2, 4, 5)}
    lags |= {f"c{k}": calendar_lag("txn_count", k) for k in (1, 2, 4)}
    lags |= {f"u{k}": calendar_lag("registered_users", k) for k in (1, 2)}
    lags |= {"o1": calendar_lag("app_opens", 1)}
    lags |= {f"{s}_lag1": calendar_lag(s, 1) for s in shares}
    last4 = _time().rangeBetween(-4, -1)
    rolling = F.when(F.count("y_log").over(last4) >= 2, F.avg("y_log").over(last4))
    wide = panel.withColumn("y_log", F.log1p(TARGET)).withColumns({**lags, "roll4_log_amt": rolling})

    def growth(new: str, old: str) -> Column:
        return ratio(F.col(new), F.col(old)) - 1

    turn = 2 * math.pi * F.col("quarter") / 4
    derived = {f"lag{k}_log_amt": F.log1p(f"a{k}") for k in (1, 2, 4)}
    derived |= {f"lag{k}_log_cnt": F.log1p(f"c{k}") for k in (1, 2, 4)}
    derived |= {
        "qoq_amt_lag1": growth("a1", "a2"),
        "yoy_amt_lag1": growth("a1", "a5"),
        "qoq_cnt_lag1": growth("c1", "c2"),
        "lag1_log_users": F.log1p("u1"),
        "user_growth_lag1": growth("u1", "u2"),
        "txns_per_user_lag1": ratio(F.col("c1"), F.col("u1")),
        "appopens_per_user_lag1": ratio(F.col("o1"), F.col("u1")),
        "q_sin": F.sin(turn),
        "q_cos": F.cos(turn),
        "naive_last": F.col("a1"),
        "seasonal_naive": F.col("a4"),
        "seasonal_yoy": F.col("a4") * ratio(F.col("a1"), F.col("a5")),
    }
    return wide.withColumns(derived).select(
        *panel.columns, "y_log", *feature_columns(categories), *BASELINES
    )


def _usable() -> Column:
    """Core lags present. An infinite growth counts as present; NaN does not."""
    ok = F.lit(True)
    for name in CORE_LAGS:
        ok = ok & F.col(name).isNotNull() & ~F.isnan(name)
    return ok


def _fill(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Missing or non-finite ratios of kept rows become zero."""
    return df.withColumns(
        {c: F.coalesce(finite_or_null(F.col(c)), F.lit(0.0)) for c in feature_columns(categories)}
    )


def build_features(panel: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Training frame: features of every row that has a target and the core lags."""
    rows = engineer(panel, categories)
    return _fill(rows.filter(F.col(TARGET).isNotNull() & _usable()), categories)


def with_next_quarter(panel: DataFrame) -> DataFrame:
    """The panel plus, per entity, one row without figures for the quarter after the last."""
    ahead = panel.agg(F.max("period_ord") + 1).scalar()
    future = (
        panel.select("state").distinct()
        .withColumn("period_ord", ahead)
        .withColumns({**from_ord(F.col("period_ord")), "is_next": F.lit(True)})
    )
    known = panel.withColumn("is_next", F.lit(False))
    return known.unionByName(future, allowMissingColumns=True)


def features_and_next(panel: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Training rows and next-quarter rows from one pass, told apart by ``is_next``."""
    rows = engineer(with_next_quarter(panel), categories)
    return _fill(rows.filter((F.col("is_next") | F.col(TARGET).isNotNull()) & _usable()), categories)


def forecast_frame(panel: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One feature row per entity for the quarter after the panel's last."""
    return features_and_next(panel, categories).filter("is_next").drop("is_next")
