"""Robust single-metric flags: areas to look into, not verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import exact_quantiles, over_nonzero, parity_round, period_key, scaled
from panelwright.operators.growth import row_growth
from panelwright.operators.kpis import CRORE
from panelwright.session import settle


def robust_z(state_txn_quarter: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Quarters whose growth lies far from the state's median, in units of its MAD.

    Median and MAD are window aggregates over the partitioning the lag already needs, so the
    facts are shuffled once and joined with nothing. A window holds one state's quarters.
    """
    whole = Window.partitionBy("state")
    deviation = (
        state_txn_quarter.select("state", "year", "quarter", "period_key", row_growth("txn_amount").alias("g"))
        .withColumn("off", F.col("g") - F.median("g").over(whole))
        .withColumn("mad", F.median(F.abs("off")).over(whole))
    )
    z = over_nonzero(F.lit(0.6745) * F.col("off"), F.col("mad"))
    return (
        deviation.withColumn("z", z)
        .filter(F.abs("z") >= threshold)
        .orderBy(F.desc(F.abs("z")), "state", "period_key")
        .select(
            "state", "year", "quarter",
            parity_round(F.col("g"), 1).alias("qoq_pct"),
            parity_round(F.col("z"), 2).alias("robust_z"),
            F.when(F.col("z") > 0, F.lit("spike")).otherwise(F.lit("drop")).alias("direction"),
        )
    )


def ticket_iqr(state_txn_quarter: DataFrame, fence: float = 1.5) -> DataFrame:
    """States whose value per transaction leaves their quarter's interquartile fences.

    A quarter gathers every state, so its quartiles come from ``exact_quantiles``.
    """
    tickets = settle(
        state_txn_quarter.select(
            "state", "period_key", "year", "quarter",
            over_nonzero(F.col("txn_amount"), F.col("txn_count")).alias("ticket"),
        )
    )
    quartiles = exact_quantiles(tickets, "ticket", [0.25, 0.75], by=["period_key"])
    spread = F.col("q1") - F.col("q0")
    high, low = F.col("q1") + fence * spread, F.col("q0") - fence * spread
    flag = F.when(F.col("ticket") > high, F.lit("high")).when(F.col("ticket") < low, F.lit("low"))
    return (
        tickets.join(F.broadcast(quartiles), "period_key")  # one row per calendar quarter
        .withColumn("flag", flag)
        .filter(F.col("flag").isNotNull())
        .select(
            "state", "year", "quarter",
            parity_round(F.col("ticket"), 1).alias("avg_ticket_inr"),
            parity_round(F.col("q0"), 1).alias("q1"),
            parity_round(F.col("q1"), 1).alias("q3"),
            "flag",
        )
        .orderBy(F.desc("year"), F.desc("quarter"), F.desc("avg_ticket_inr"), "state")
    )


def district_swings(
    map_transaction: DataFrame,
    threshold: float = 60.0,
    floor: float = 1e8,
    n: int = 25,
    divisor: float = CRORE,
) -> DataFrame:
    """Largest single-quarter jumps of districts whose base is not tiny."""
    places = map_transaction.withColumn("period_key", period_key())
    before = F.lag("txn_amount").over(Window.partitionBy("state", "district").orderBy("period_key"))
    return (
        places.select(
            "state", "district", "year", "quarter", "txn_amount",
            before.alias("before"), row_growth("txn_amount", ("state", "district")).alias("g"),
        )
        .filter(F.col("g").isNotNull() & (F.col("before") > floor) & (F.abs("g") >= threshold))
        .orderBy(F.desc(F.abs("g")), "state", "district", "year", "quarter").limit(n)
        .select(
            "state", "district", "year", "quarter",
            parity_round(F.col("g"), 1).alias("qoq_pct"),
            scaled(F.col("before"), divisor, 2).alias("prev_cr"),
            scaled(F.col("txn_amount"), divisor, 2).alias("curr_cr"),
        )
    )
