"""Read functions for dashboards and APIs, each from a warehouse to a frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import (
    finite_or_null,
    normalize_name,
    over_nonzero,
    parity_round,
    period_key,
    period_label,
    scaled,
)
from panelwright.operators import forecast, growth, kpis, panels, segments, signals
from panelwright.operators.features import build_features
from panelwright.plans.reports import top_per_entity
from panelwright.schemas import CATEGORIES, CHAMPION
from panelwright.session import settle
from panelwright.sources.warehouse import Warehouse


def meta(w: Warehouse) -> DataFrame:
    """One row: first and last quarter, number of states, whether districts are loaded."""
    districts = w.map_transaction.limit(1).agg(F.count("*") > 0).scalar()
    return (
        w.agg_transaction.filter(F.col("level") == "state")
        .agg(
            F.min(period_key()).alias("lo"), F.max(period_key()).alias("hi"),
            F.count_distinct("geo").alias("states"),
        )
        .select(
            period_label("lo").alias("first_quarter"), period_label("hi").alias("latest_quarter"),
            "states", districts.alias("districts_available"),
        )
    )


def national_trend(w: Warehouse) -> DataFrame:
    """Unrounded count, value and ticket per quarter, with label."""
    return kpis.national_totals(w.agg_transaction).select(
        "year", "quarter", "txn_count", "txn_amount", period_label().alias("quarter_label"),
        over_nonzero(F.col("txn_amount"), F.col("txn_count")).alias("avg_ticket"),
    ).orderBy("year", "quarter")


def latest_period(w: Warehouse) -> DataFrame:
    return kpis.national(w.agg_transaction).agg(F.max("period_key").alias("period_key"))


def available_quarters(w: Warehouse) -> DataFrame:
    return (
        kpis.national(w.agg_transaction).select("year", "quarter", "period_key").distinct()
        .withColumn("label", period_label()).orderBy("period_key")
    )


def category_mix(w: Warehouse, period: int | None = None) -> DataFrame:
    return kpis.category_totals(w.agg_transaction, period).select(
        "category", "txn_count", "txn_amount", "pct_value"
    ).orderBy(F.desc("pct_value"), "category")


def top_states(w: Warehouse, n: int = 10, period: int | None = None) -> DataFrame:
    return (
        kpis.at_period(w.state_txn_quarter, period)
        .orderBy(F.desc("txn_amount"), "state").limit(n).select("state", "txn_count", "txn_amount")
    )


def growth_leaders(w: Warehouse, n: int = 15) -> DataFrame:
    """As the growth report, but asking for four measured quarters."""
    return growth.leaders(w.state_txn_quarter, n, min_quarters=4).withColumnRenamed(
        "quarters_measured", "quarters"
    )


def expansion_signals(w: Warehouse) -> DataFrame:
    return growth.expansion_signals(w.state_txn_quarter, w.state_user_quarter)


def state_history(w: Warehouse, state: str) -> DataFrame:
    """A state's quarters; the filter on the grouping key reaches the scan."""
    return w.state_txn_quarter.filter(F.col("state") == state).select(
        "year", "quarter", "txn_count", "txn_amount", period_label().alias("quarter_label")
    ).orderBy("year", "quarter")


def states(w: Warehouse) -> DataFrame:
    own = w.agg_transaction.filter(F.col("level") == "state")
    return own.select(F.col("geo").alias("state")).distinct().orderBy("state")


def state_map_metrics(w: Warehouse, period: int | None = None) -> DataFrame:
    """Value and yearly growth per state in one quarter."""
    grown = w.state_txn_quarter.select(
        "state", "period_key", "txn_amount", growth.row_growth("txn_amount", k=4).alias("yoy")
    )
    return (
        kpis.at_period(grown, period)
        .orderBy(F.desc("txn_amount"), "state")
        .select("state", "txn_amount", parity_round(F.col("yoy"), 1).alias("yoy_pct"))
    )


def map_named(metrics: DataFrame, names: DataFrame, name: str = "display_name") -> DataFrame:
    """Map rows with the display name whose normalised form equals the state's.

    Unmatched states drop out. Should several names normalise alike, one is taken, as in a
    lookup table. The planner broadcasts the names if their size allows.
    """
    lookup = names.groupBy(normalize_name(F.col(name)).alias("key")).agg(F.max(name).alias(name))
    return metrics.withColumn("key", normalize_name(F.col("state"))).join(lookup, "key").select(
        "state", name, "txn_amount", "yoy_pct"
    )


@dataclass(frozen=True)
class Insights:
    """Model-backed reads over one warehouse; results are computed once and kept."""

    warehouse: Warehouse
    categories: Sequence[str] = CATEGORIES

    @cached_property
    def state_panel(self) -> DataFrame:
        return settle(panels.state_panel(self.warehouse, self.categories))

    @cached_property
    def state_forecasts(self) -> DataFrame:
        return settle(forecast.next_quarter(self.state_panel, self.categories))

    @cached_property
    def champion_forecasts(self) -> DataFrame:
        """States' forecasts where ridge isn't asked for."""
        return settle(forecast.next_quarter(self.state_panel, self.categories, ridge=False))

    @cached_property
    def category_forecasts(self) -> DataFrame:
        return settle(forecast.next_quarter(
            panels.category_panel(self.warehouse, self.categories), self.categories, ridge=False
        ))

    @cached_property
    def district_forecasts(self) -> DataFrame:
        panel = panels.district_panel(self.warehouse, categories=self.categories)
        return settle(forecast.next_quarter(panel, self.categories, ridge=False))

    @cached_property
    def anomaly_ranking(self) -> DataFrame:
        return settle(signals.detect(build_features(self.state_panel, self.categories)))

    @cached_property
    def segmentation(self) -> segments.Segments:
        return segments.segment(self.state_panel, categories=self.categories)

    def forecast_next_quarter(self) -> DataFrame:
        """States by champion forecast, with quarter and model."""
        return forecast.ranked(self.state_forecasts).select(
            period_label().alias("quarter"), F.lit(CHAMPION).alias("champion_model"),
            F.col("entity").alias("state"), *forecast.FORECAST[2:],
        )

    def forecast_categories(self, top: int = 25) -> DataFrame:
        return self._named(forecast.top_children(self.category_forecasts, "category", top))

    def forecast_districts(self, top: int = 30, state: str | None = None) -> DataFrame:
        return self._named(forecast.top_children(self.district_forecasts, "district", top, state))

    @staticmethod
    def _named(df: DataFrame) -> DataFrame:
        """With the quarter's label and the model that made the forecast."""
        return df.withColumns({"quarter": period_label(), "champion_model": F.lit(CHAMPION)})

    def state_forecast(self, state: str) -> DataFrame:
        return self.forecast_next_quarter().filter(F.col("state") == state)

    def state_cluster(self, state: str) -> DataFrame:
        return self.segmentation.labelled.filter(F.col("state") == state).select("state", "cluster")

    def anomalies(self, top: int = 20) -> DataFrame:
        return self.anomaly_ranking.orderBy(
            F.desc("anomaly_score"), "state", "year", "quarter"
        ).limit(top).drop("is_anomaly")

    def segments(self) -> DataFrame:
        """Members with the profile of their cluster, k and silhouette."""
        found = self.segmentation
        return segments.members(found).withColumns({
            "k": F.lit(found.choice.k),
            "silhouette": F.lit(found.silhouette).cast("double"),
        })

    def with_forecast(self, state: str) -> DataFrame:
        """A state's quarters followed by its forecast, in crore, for one chart."""
        past = state_history(self.warehouse, state).select(
            "quarter_label", scaled(F.col("txn_amount")).alias("value_cr"), F.lit("actual").alias("kind")
        )
        ahead = self.champion_forecasts.filter(F.col("entity") == state).select(
            period_label().alias("quarter_label"),
            scaled(F.col("forecast_champion")).alias("value_cr"),
            scaled(F.col("forecast_lo")).alias("lo"),
            scaled(F.col("forecast_hi")).alias("hi"),
            F.lit("forecast").alias("kind"),
        )
        return past.unionByName(ahead, allowMissingColumns=True)

    def state_detail(self, state: str | None = None) -> DataFrame:
        """Per state: history, forecast, cluster and its five highest anomaly scores.

        The lists hold one state's quarters at most. All states when none is named.
        """
        def own(df: DataFrame) -> DataFrame:
            return df if state is None else df.filter(F.col("state") == state)

        def listed(df: DataFrame, name: str, order: str, *fields: str) -> DataFrame:
            entries = F.collect_list(F.struct(order, *[f for f in fields if f != order]))
            return own(df).groupBy("state").agg(F.sort_array(entries).alias(name))

        history = listed(
            self.state_panel.withColumn("quarter_label", period_label()), "history", "period_key",
            "quarter_label", "txn_count", "txn_amount",
        )
        flagged = listed(
            top_per_entity(self.anomaly_ranking), "anomalies", "place",
            "year", "quarter", "qoq_amt", "value_user_gap", "anomaly_score",
        )
        ahead = own(self.forecast_next_quarter()).select(
            "state", F.struct("quarter", *forecast.FORECAST[2:]).alias("forecast")
        )
        return (
            history.join(ahead, "state", "left")
            .join(own(self.segmentation.labelled).select("state", "cluster"), "state", "left")
            .join(flagged, "state", "left")
        )

    def snapshot(self, top: int = 10, ahead: int = 12) -> DataFrame:
        """Everything a static page needs, in report units: one JSON text per list entry.

        Rows carry the section and the values it is sorted by, so that writing needs no
        collected document. ``sinks.write_json`` stores it as JSON lines.
        """
        w = self.warehouse

        def section(df: DataFrame, name: str, rank, *fields) -> DataFrame:
            return df.select(
                F.lit(name).alias("section"), rank.cast("double").alias("rank"),
                F.to_json(F.struct(*fields)).alias("entry"),
            )

        trend = national_trend(w)
        ranked = forecast.ranked(self.champion_forecasts, ahead)
        amount = scaled(F.col("txn_amount")).alias("value_cr")
        parts = [
            section(meta(w), "meta", F.lit(0), "first_quarter", "latest_quarter", "states", "districts_available"),
            section(
                trend, "trend", period_key(), F.col("quarter_label").alias("q"), amount,
                scaled(F.col("txn_count"), 1e9, 2).alias("count_bn"),
                parity_round(F.col("avg_ticket"), 0).alias("ticket"),
            ),
            section(
                category_mix(w), "category_mix", -F.col("pct_value"), "category",
                parity_round(F.col("pct_value"), 1).alias("pct"),
            ),
            section(top_states(w, top), "top_states", -F.col("txn_amount"), "state", amount),
            section(
                ranked, "forecast", -F.col("forecast_champion"), F.col("entity").alias("state"),
                period_label().alias("quarter"), F.lit(CHAMPION).alias("model"),
                scaled(F.col("forecast_champion")).alias("champ_cr"),
                scaled(F.col("forecast_lo")).alias("lo_cr"),
                scaled(F.col("forecast_hi")).alias("hi_cr"),
                parity_round(F.col("growth_vs_last_pct"), 1).alias("growth"),
            ),
            section(
                self.segments(), "segments", F.col("cluster"), "state", "k",
                parity_round(F.col("silhouette"), 2).alias("silhouette"), "cluster",
                F.col("n_states").alias("n"),
                parity_round(100 * F.col("yoy_growth"), 0).alias("yoy"),
                parity_round(F.col("txns_per_user"), 0).alias("tpu"),
                parity_round(F.col("avg_ticket"), 0).alias("ticket"),
            ),
            section(
                state_map_metrics(w), "map", -F.col("txn_amount"), "state", amount,
                finite_or_null(F.col("yoy_pct")).alias("yoy"),
            ),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def document(self, top: int = 10, ahead: int = 12) -> DataFrame:
        """The same as one nested row: ``sinks.write_json`` makes it one JSON document.

        Its lists hold states, clusters and quarters of the calendar, never facts.
        """
        w = self.warehouse
        trend, ranked, found = national_trend(w), forecast.ranked(self.champion_forecasts, ahead), self.segmentation
        amount = scaled(F.col("txn_amount")).alias("value_cr")

        def listed(df: DataFrame, rank: Column, *fields: Column | str) -> Column:
            """Entries by rank, then by their own values."""
            rows = df.select(rank.alias("rank"), F.struct(*fields).alias("entry"))
            held = F.array_sort(F.collect_list(F.struct("rank", "entry")))
            return rows.agg(F.transform(held, lambda e: e["entry"])).scalar()

        clusters = segments.members(found).groupBy("cluster").agg(
            F.sort_array(F.collect_list("state")).alias("states"),
            *[F.first(c).alias(c) for c in ("n_states", "yoy_growth", "txns_per_user", "avg_ticket")],
        )
        forecasts = listed(
            ranked, -F.col("forecast_champion"), F.col("entity").alias("state"),
            scaled(F.col("forecast_champion")).alias("champ_cr"), scaled(F.col("forecast_lo")).alias("lo_cr"),
            scaled(F.col("forecast_hi")).alias("hi_cr"), parity_round(F.col("growth_vs_last_pct"), 1).alias("growth"),
        )
        profile = listed(
            clusters, F.col("cluster"), "cluster", F.col("n_states").alias("n"),
            parity_round(100 * F.col("yoy_growth"), 0).alias("yoy"), parity_round(F.col("txns_per_user"), 0).alias("tpu"),
            parity_round(F.col("avg_ticket"), 0).alias("ticket"), "states",
        )
        return w.agg_transaction.sparkSession.range(1).select(
            meta(w).select(F.struct("first_quarter", "latest_quarter", "states", "districts_available")).scalar().alias("meta"),
            listed(trend, period_key(), F.col("quarter_label").alias("q"), amount, scaled(F.col("txn_count"), 1e9, 2).alias("count_bn"),
                   parity_round(F.col("avg_ticket"), 0).alias("ticket")).alias("trend"),
            listed(category_mix(w), -F.col("pct_value"), "category", parity_round(F.col("pct_value"), 1).alias("pct")).alias("category_mix"),
            listed(top_states(w, top), -F.col("txn_amount"), "state", amount).alias("top_states"),
            F.struct(ranked.agg(F.max(period_label())).scalar().alias("quarter"), F.lit(CHAMPION).alias("model"), forecasts.alias("rows")).alias("forecast"),
            F.struct(F.lit(found.choice.k).alias("k"), parity_round(F.lit(found.silhouette).cast("double"), 2).alias("silhouette"),
                     profile.alias("clusters")).alias("segments"),
            listed(state_map_metrics(w), -F.col("txn_amount"), "state", amount, finite_or_null(F.col("yoy_pct")).alias("yoy")).alias("map"),
        )
