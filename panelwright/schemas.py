"""Fixed table layouts, category list and feature names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# Table layouts of the warehouse.
TABLES: dict[str, str] = {
    "agg_transaction": "level string, geo string, year int, quarter int, category string, "
    "txn_count bigint, txn_amount double",
    "agg_user": "level string, geo string, year int, quarter int, "
    "registered_users bigint, app_opens bigint",
    "map_transaction": "state string, district string, year int, quarter int, "
    "txn_count bigint, txn_amount double",
    "map_user": "state string, district string, year int, quarter int, "
    "registered_users bigint, app_opens bigint",
    "top_transaction": "parent_level string, parent_geo string, entity_type string, "
    "entity_name string, year int, quarter int, txn_count bigint, txn_amount double",
}

# The default category list.
CATEGORIES = (
    "Merchant payments",
    "Peer-to-peer payments",
    "Recharge & bill payments",
    "Financial Services",
    "Others",
)

# Feature names that do not depend on the category list.
LEVEL_FEATURES = (
    "lag1_log_amt", "lag2_log_amt", "lag4_log_amt",
    "lag1_log_cnt", "lag2_log_cnt", "lag4_log_cnt",
    "roll4_log_amt",
    "qoq_amt_lag1", "yoy_amt_lag1", "qoq_cnt_lag1",
    "lag1_log_users", "user_growth_lag1",
    "txns_per_user_lag1", "appopens_per_user_lag1",
)
SEASON_FEATURES = ("q_sin", "q_cos")
CORE_LAGS = ("lag1_log_amt", "lag4_log_amt", "roll4_log_amt", "qoq_amt_lag1")
BASELINES = ("naive_last", "seasonal_naive", "seasonal_yoy")
CHAMPION = "seasonal_yoy"


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def table_columns(name: str) -> list[str]:
    return table_schema(name).fieldNames()


def share_column(category: str) -> str:
    """Column holding a category's share of an entity's quarter: first word, lower case."""
    return "share_" + category.split()[0].lower()


def share_columns(categories: Sequence[str] = CATEGORIES) -> list[str]:
    return [share_column(c) for c in categories]


def feature_columns(categories: Sequence[str] = CATEGORIES) -> list[str]:
    lagged = [f"{c}_lag1" for c in share_columns(categories)]
    return [*LEVEL_FEATURES, *lagged, *SEASON_FEATURES]
