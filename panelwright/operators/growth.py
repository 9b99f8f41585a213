"""Growth, outperformance, concentration and expansion signals.

Lags here count rows, not quarters: a gap in a state's history is skipped over. The
forecasting features (see ``features``) use calendar lags instead. Windows run per state or
per state and category, so a partition holds at most one row per quarter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import over_nonzero, parity_round, period_key, scaled
from panelwright.functions.quantiles import exact_median
from panelwright.functions.sketches import quantile, sketched
from panelwright.operators.kpis import CRORE, at_period, latest_period
from panelwright.session import settle


def row_growth(value: str, by: Sequence[str] = ("state",), k: int = 1) -> Column:
    """Percent change on the entity's row ``k`` places earlier, null on a zero base."""
    before = F.lag(value, k).over(Window.partitionBy(*by).orderBy("period_key"))
    return over_nonzero(F.lit(100.0) * (F.col(value) - before), before)


def qoq(state_txn_quarter: DataFrame, divisor: float = CRORE) -> DataFrame:
    """Quarter-over-quarter growth of value and count per state."""
    return state_txn_quarter.select(
        "state", "year", "quarter",
        scaled(F.col("txn_amount"), divisor).alias("txn_amount_cr"),
        parity_round(row_growth("txn_amount"), 1).alias("qoq_value_pct"),
        parity_round(row_growth("txn_count"), 1).alias("qoq_count_pct"),
    ).orderBy("state", "year", "quarter")


def leaders(state_txn_quarter: DataFrame, n: int = 15, min_quarters: int = 3, approximate: bool = False) -> DataFrame:
    """States ranked by median growth, so that one lucky spike does not win.

    ``approximate`` takes the median of a group from a sketch of fixed size (see ``sketches``).
    """
    middle = quantile(sketched("g"), 0.5) if approximate else F.median("g")
    growth = state_txn_quarter.select("state", row_growth("txn_amount").alias("g"))
    return (
        growth.groupBy("state")
        .agg(
            parity_round(middle, 1).alias("median_qoq_pct"),
            parity_round(F.min("g"), 1).alias("worst_qoq_pct"),
            F.count("g").alias("quarters_measured"),
        )
        .filter(F.col("quarters_measured") >= min_quarters)
        .orderBy(F.desc("median_qoq_pct"), "state").limit(n)
    )


def yoy(state_txn_quarter: DataFrame, n: int = 20) -> DataFrame:
    """Growth on the row four places earlier, best quarters first."""
    return (
        state_txn_quarter.select(
            "state", "year", "quarter", parity_round(row_growth("txn_amount", k=4), 1).alias("yoy_value_pct")
        )
        .filter(F.col("yoy_value_pct").isNotNull())
        .orderBy(F.desc("yoy_value_pct"), "state", "year", "quarter").limit(n)
    )


def category_outperformance(agg_transaction: DataFrame, n: int = 20) -> DataFrame:
    """Categories that grew faster than their state in the newest quarter."""
    cells = agg_transaction.filter(F.col("level") == "state").select(
        F.col("geo").alias("state"), "category", period_key().alias("period_key"), "txn_amount"
    )
    by_category = cells.withColumn("cat", row_growth("txn_amount", ("state", "category")))
    states = cells.groupBy("state", "period_key").agg(F.sum("txn_amount").alias("txn_amount"))
    by_state = states.select("state", "period_key", row_growth("txn_amount").alias("whole"))
    newest = latest_period(cells)
    return (
        by_category.filter(F.col("cat").isNotNull() & (F.col("period_key") == newest))
        .join(by_state.filter(F.col("period_key") == newest), ["state", "period_key"])
        .select(
            "state", "category", "period_key",
            parity_round(F.col("cat"), 1).alias("cat_qoq_pct"),
            parity_round(F.col("whole"), 1).alias("state_qoq_pct"),
            parity_round(F.col("cat") - F.col("whole"), 1).alias("outperformance_pts"),
        )
        .orderBy(F.desc_nulls_last("outperformance_pts"), "state", "category").limit(n)
    )


def category_hhi(agg_transaction: DataFrame, n: int = 15) -> DataFrame:
    """Concentration of value over categories per state, newest quarter.

    Sum of squared shares = (sum of squares) / (square of the sum): one combined aggregate
    instead of a window over each state's rows.
    """
    cells = agg_transaction.filter(F.col("level") == "state").withColumn("period_key", period_key())
    total = F.sum("txn_amount")
    hhi = over_nonzero(F.sum(F.col("txn_amount") * F.col("txn_amount")), total * total)
    return (
        at_period(cells)
        .groupBy(F.col("geo").alias("state"))
        .agg(parity_round(hhi, 3).alias("hhi"))
        .orderBy(F.desc_nulls_last("hhi"), "state").limit(n)
    )


def expansion_signals(state_txn_quarter: DataFrame, state_user_quarter: DataFrame) -> DataFrame:
    """States whose yearly growth is above, and use per user below, the median of all states."""
    users = state_user_quarter.select("state", "period_key", "registered_users")
    newest = at_period(
        state_txn_quarter.select(
            "state", "period_key", "txn_count", row_growth("txn_amount", k=4).alias("yoy")
        )
    )
    use = over_nonzero(F.col("txn_count"), F.col("registered_users"))
    # one row per state; settled because both medians and the result read it
    rows = settle(
        newest.join(users.withColumn("known", F.lit(True)), ["state", "period_key"], "left")
        .select("state", "yoy", use.alias("use"), "known")
    )
    return (
        rows.filter("known")
        .filter(
            (F.col("yoy") > exact_median(rows, "yoy").scalar())
            & (F.col("use") < exact_median(rows.filter("known"), "use").scalar())
        )
        .orderBy(F.desc("yoy"), "state")
        .select(
            "state",
            parity_round(F.col("yoy"), 1).alias("yoy_value_pct"),
            parity_round(F.col("use"), 1).alias("txns_per_user"),
        )
    )
