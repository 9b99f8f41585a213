"""Report tables over backtest predictions, anomalies and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import over_nonzero, parity_round, period_label, scaled
from panelwright.operators import metrics

CRORE = 1e7


def leaderboard(predictions: DataFrame, reference: str = "naive_last") -> DataFrame:
    """Metrics per model in report units, with the WAPE gain over a reference model, best first."""
    board = metrics.summarize(predictions)
    base = board.filter(F.col("model") == reference).agg(F.max("wape")).scalar()

    def pct(c: str, digits: int):
        return parity_round(100 * F.col(c), digits).alias(f"{c}_pct")

    return board.orderBy(F.asc_nulls_last("wape"), "model").select(
        "model", "n_scored", pct("wape", 2), pct("smape", 2),
        scaled(F.col("mae"), CRORE, 1).alias("mae_cr"),
        scaled(F.col("rmse"), CRORE, 1).alias("rmse_cr"),
        pct("bias", 1),
        parity_round(100 * (1 - over_nonzero(F.col("wape"), base)), 1).alias("lift_pct"),
    )


def best_model(predictions: DataFrame) -> DataFrame:
    """One row: the model with the lowest WAPE over all folds."""
    board = metrics.summarize(predictions)
    return board.orderBy(F.asc_nulls_last("wape"), "model").limit(1).select("model")


def wape_by_fold(predictions: DataFrame, versus: str = "seasonal_naive") -> DataFrame:
    """WAPE of the best model and of a reference model, per holdout quarter."""
    best = best_model(predictions).scalar()
    rows = predictions.withColumn("best", best).filter(F.col("model").isin(versus) | (F.col("model") == F.col("best")))
    folds = metrics.summarize(rows, ["period_key", "best", "model"])

    def of(condition):
        return parity_round(100 * F.max(F.when(condition, F.col("wape"))), 2)

    return (
        folds.groupBy("period_key", "best")
        .agg(of(F.col("model") == F.col("best")).alias("best_wape_pct"), of(F.col("model") == versus).alias("versus_wape_pct"))
        .orderBy("period_key")
        .select(period_label().alias("quarter"), F.col("best").alias("best_model"), "best_wape_pct", "versus_wape_pct")
    )


def hardest_easiest(predictions: DataFrame, hardest: int = 8, easiest: int = 5) -> DataFrame:
    """Entities the best model predicts worst and best: two top-k picks, no full ranking."""
    own = predictions.filter(F.col("model") == best_model(predictions).scalar())
    table = metrics.error_by_group(own, "state").filter(F.col("wape").isNotNull())
    worst = table.orderBy(F.desc("wape"), "state").limit(hardest).withColumn("side", F.lit("hardest"))
    finest = table.orderBy("wape", F.desc("state")).limit(easiest).withColumn("side", F.lit("easiest"))
    return worst.unionByName(finest).select(
        "side", "state", "n", parity_round(100 * F.col("wape"), 1).alias("wape_pct"),
        scaled(F.col("mae"), CRORE, 1).alias("mae_cr"),
    )


def anomaly_report(ranked: DataFrame, top: int = 20) -> DataFrame:
    """Highest scores in report units."""
    def pct(c: str):
        return parity_round(100 * F.col(c), 1)

    return ranked.orderBy(F.desc("anomaly_score"), "state", "year", "quarter").limit(top).select(
        "state", "year", "quarter",
        scaled(F.col("txn_amount"), CRORE, 0).alias("txn_cr"),
        pct("qoq_amt").alias("qoq_pct"),
        pct("user_growth").alias("user_growth_pct"),
        pct("value_user_gap").alias("value_user_gap_pct"),
        parity_round(F.col("avg_ticket"), 0).alias("ticket"),
        parity_round(F.col("anomaly_score"), 3).alias("score"),
        "is_anomaly",
    )


def segment_report(clusters: DataFrame, shares: list[str]) -> DataFrame:
    """Cluster profiles with growth and shares in percent."""
    percent = {c: parity_round(100 * F.col(c), 1) for c in ["yoy_growth", "user_growth", *shares]}
    return clusters.withColumns({
        **percent,
        "txns_per_user": parity_round(F.col("txns_per_user"), 1),
        "avg_ticket": parity_round(F.col("avg_ticket"), 0),
    }).orderBy("cluster")


def top_per_entity(ranked: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest anomaly scores of each state."""
    place = F.row_number().over(
        Window.partitionBy("state").orderBy(F.desc("anomaly_score"), "year", "quarter")
    )
    return ranked.withColumn("place", place).filter(F.col("place") <= n)
