"""Panels: one row per entity and quarter, at state, category or district grain.

All grains share one layout. The entity id sits in the column ``state`` (at the finer grains
as ``parent | child``), so one set of features and forecasts serves them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import compose, over_nonzero, with_periods
from panelwright.functions.entities import district_key
from panelwright.functions.periods import from_ord
from panelwright.schemas import CATEGORIES, share_column, share_columns
from panelwright.sources.warehouse import Warehouse

PLACE_TIME = ["state", "year", "quarter"]


def panel_columns(categories: Sequence[str] = CATEGORIES) -> list[str]:
    return [
        "state", "year", "quarter", "period_key", "period_ord",
        "txn_count", "txn_amount", "registered_users", "app_opens",
        *share_columns(categories),
    ]


def _finish(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Add period columns, and zero for share columns the grain does not have."""
    blank = {c: F.lit(0.0) for c in share_columns(categories) if c not in df.columns}
    return with_periods(df.withColumns(blank)).select(*panel_columns(categories))


def _state_users(warehouse: Warehouse) -> DataFrame:
    return warehouse.agg_user.filter(F.col("level") == "state").select(
        F.col("geo").alias("state"), "year", "quarter", "registered_users", "app_opens"
    )


def state_panel(warehouse: Warehouse, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Totals, users and the share of each listed category.

    Totals and shares come from one aggregate: the pivot over the fixed category list is a
    set of conditional sums. Categories outside the list count in the total only.
    """
    amount = F.col("txn_amount")
    by_category = {
        share_column(c): over_nonzero(F.sum(F.when(F.col("category") == c, amount)), F.sum(amount))
        for c in categories
    }
    totals = (
        warehouse.agg_transaction.filter(F.col("level") == "state")
        .groupBy(F.col("geo").alias("state"), "year", "quarter")
        .agg(
            F.sum("txn_count").alias("txn_count"),
            F.sum(amount).alias("txn_amount"),
            *[share.alias(name) for name, share in by_category.items()],
        )
    )
    return _finish(totals.join(_state_users(warehouse), PLACE_TIME, "left"), categories)


def category_panel(warehouse: Warehouse, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row per state, category and quarter; users are those of the state."""
    cells = warehouse.agg_transaction.filter(F.col("level") == "state").select(
        F.col("geo").alias("state"), "year", "quarter", "category", "txn_count", "txn_amount"
    )
    rows = cells.join(_state_users(warehouse), PLACE_TIME, "left")
    return _finish(rows.withColumn("state", compose(F.col("state"), F.col("category"))), categories)


def district_panel(
    warehouse: Warehouse, min_quarters: int = 8, categories: Sequence[str] = CATEGORIES
) -> DataFrame:
    """One row per state, district and quarter, for districts with enough history.

    The user feed spells districts with a suffix, so both sides join on a normalised name.
    Should it hold both spellings, the larger figures are taken rather than doubling rows.
    """
    keys = ["state", "district_key", "year", "quarter"]
    users = (
        warehouse.map_user.withColumn("district_key", district_key(F.col("district")))
        .groupBy(*keys)
        .agg(F.max("registered_users").alias("registered_users"), F.max("app_opens").alias("app_opens"))
    )
    places = warehouse.map_transaction.withColumn("district_key", F.lower("district"))
    rows = places.join(users, keys, "left").withColumn("state", compose(F.col("state"), F.col("district")))
    history = F.count("year").over(Window.partitionBy("state"))
    kept = rows.withColumn("history", history).filter(F.col("history") >= min_quarters)
    return _finish(kept, categories)


def full_grid(panel: DataFrame) -> DataFrame:
    """The panel with an empty row for every quarter an entity lacks.

    The span is the first to the last quarter of the whole panel. Each entity's own quarters
    form a short array, so the blanks are found by array difference, without a join.
    """
    span = panel.agg(F.sequence(F.min("period_ord"), F.max("period_ord"))).scalar()
    blanks = (
        panel.groupBy("state").agg(F.collect_set("period_ord").alias("own"))
        .withColumn("span", span)
        .select("state", F.explode(F.array_except("span", "own")).alias("period_ord"))
        .withColumns(from_ord(F.col("period_ord")))
    )
    return panel.unionByName(blanks, allowMissingColumns=True)
