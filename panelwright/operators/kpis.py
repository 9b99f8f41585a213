"""Headline figures. Every function takes and returns frames; thresholds are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.functions import over_nonzero, parity_round, period_key, period_label, scaled

CRORE = 1e7


def latest_period(df: DataFrame) -> Column:
    """Newest period key of a frame as a scalar subquery; reads only the period columns."""
    return df.agg(F.max("period_key")).scalar()


def at_period(df: DataFrame, period: int | None = None) -> DataFrame:
    """Rows of one quarter, by default the newest."""
    return df.filter(F.col("period_key") == (latest_period(df) if period is None else F.lit(period)))


def national(agg_transaction: DataFrame) -> DataFrame:
    rows = agg_transaction.filter(F.col("level") == "country")
    return rows.withColumn("period_key", period_key())


def national_totals(agg_transaction: DataFrame) -> DataFrame:
    return national(agg_transaction).groupBy("year", "quarter", "period_key").agg(
        F.sum("txn_count").alias("txn_count"), F.sum("txn_amount").alias("txn_amount")
    )


def national_trend(agg_transaction: DataFrame, divisor: float = CRORE) -> DataFrame:
    """Count and value per quarter, value in larger units."""
    return national_totals(agg_transaction).select(
        "year", "quarter", "txn_count", scaled(F.col("txn_amount"), divisor).alias("txn_amount_cr")
    ).orderBy("year", "quarter")


def avg_ticket(agg_transaction: DataFrame) -> DataFrame:
    """Value per transaction by quarter."""
    ticket = over_nonzero(F.col("txn_amount"), F.col("txn_count"))
    return national_totals(agg_transaction).select(
        "year", "quarter", parity_round(ticket, 1).alias("avg_ticket_inr")
    ).orderBy("year", "quarter")


def category_totals(agg_transaction: DataFrame, period: int | None = None) -> DataFrame:
    """National count, value and share of value per category in one quarter.

    The window runs over the few aggregated categories of each quarter, not over facts.
    """
    totals = national(agg_transaction)
    if period is not None:
        totals = totals.filter(F.col("period_key") == period)
    totals = totals.groupBy("period_key", "category").agg(
        F.sum("txn_count").alias("txn_count"), F.sum("txn_amount").alias("txn_amount")
    )
    whole = F.sum("txn_amount").over(Window.partitionBy("period_key"))
    shares = totals.withColumn("pct_value", over_nonzero(F.lit(100.0) * F.col("txn_amount"), whole))
    return at_period(shares) if period is None else shares


def category_mix(agg_transaction: DataFrame, period: int | None = None) -> DataFrame:
    return category_totals(agg_transaction, period).select(
        "category", "txn_count", parity_round(F.col("pct_value"), 1).alias("pct_of_value")
    ).orderBy(F.desc("pct_of_value"), "category")


def top_states(state_txn_quarter: DataFrame, n: int = 10, divisor: float = CRORE) -> DataFrame:
    """Largest states by value in the newest quarter."""
    return (
        at_period(state_txn_quarter)
        .orderBy(F.desc("txn_amount"), "state").limit(n)
        .select("state", "txn_count", scaled(F.col("txn_amount"), divisor).alias("txn_amount_cr"))
    )


def txns_per_user(state_txn_quarter: DataFrame, state_user_quarter: DataFrame, n: int = 15) -> DataFrame:
    """Transactions per registered user in the newest quarter."""
    users = state_user_quarter.select("state", "period_key", "registered_users")
    return (
        at_period(state_txn_quarter)
        .join(users, ["state", "period_key"])
        .select(
            "state", "year", "quarter",
            parity_round(over_nonzero(F.col("txn_count"), F.col("registered_users")), 1)
            .alias("txns_per_registered_user"),
        )
        .orderBy(F.desc_nulls_last("txns_per_registered_user"), "state").limit(n)
    )


def quarter_tiles(agg_transaction: DataFrame, period: int | None = None) -> DataFrame:
    """One row: a quarter's value, count and ticket with the change on the quarter before.

    Picking the two rows by ``max_by`` needs no window over the whole trend.
    """
    trend = national_totals(agg_transaction)
    row = F.struct("period_key", "txn_count", "txn_amount")
    chosen = at_period(trend, period)
    own = latest_period(trend) if period is None else F.lit(period)
    before = trend.filter(F.col("period_key") < own).agg(F.max_by(row, "period_key")).scalar()

    def change(field: str) -> Column:
        old = F.col(f"prior.{field}")
        return parity_round(F.lit(100.0) * (over_nonzero(F.col(field), old) - 1), 1)

    return chosen.withColumn("prior", before).select(
        period_label().alias("quarter_label"),
        "txn_count",
        parity_round(F.col("txn_amount"), 2).alias("txn_amount"),
        parity_round(over_nonzero(F.col("txn_amount"), F.col("txn_count")), 2).alias("avg_ticket"),
        change("txn_amount").alias("value_qoq_pct"),
        change("txn_count").alias("count_qoq_pct"),
    )
