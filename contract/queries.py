"""Registered queries: each takes (spark, sf_dir) and returns a frame over the whole tables.

Figures whose last bits depend on the order of summation are rounded, so that they can be
compared with another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contract import landing
from contract.facts import CATEGORIES, CorrectedFacts, DamagedFacts, OrderFacts, StoredFacts, ThinnedFacts
from panelwright.operators import (
    backtest, features, forecast, growth, intervals, kmeans, kpis, metrics, outliers, panels, quality, ridge,
    segments, signals,
)
from panelwright.operators.boosting import Boosting
from panelwright.functions import parity_round
from panelwright.functions.sketches import merged_quantiles, store_sketches, stored_sketches
from panelwright.plans import reports, service
from panelwright.plans.ingest import ingest
from panelwright.session import scratch_path, settle
from panelwright.schemas import TABLES, feature_columns
from panelwright.sources import leaves, sinks
from panelwright.sources.warehouse import Warehouse, load_counts
from panelwright.streaming.reconcile import reconcile
from panelwright.streaming.refresh import Refreshed, refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Arguments of the parameterised reads.
PERIOD = 19983
STATE = "NATION_7"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def from_warehouse(name: str, build: Callable[[Warehouse], DataFrame], stored: bool = False) -> None:
    """Register a query; ``stored`` for those that read a fact table more than once."""
    facts = StoredFacts if stored else OrderFacts
    QUERIES[name] = lambda spark, sf_dir: build(facts(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 2, **special: int) -> DataFrame:
    """Round the double columns; ``special`` names columns with other digits."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: parity_round(F.col(f"`{c}`"), special.get(c, digits)) for c in doubles})


# -- fact tables and KPIs --------------------------------------------------------

for _name in TABLES:
    from_warehouse(_name, lambda w, n=_name: getattr(w, n))
from_warehouse("state_txn_quarter", lambda w: rounded(w.state_txn_quarter))
from_warehouse("state_user_quarter", lambda w: w.state_user_quarter)
from_warehouse("load_counts", load_counts)

from_warehouse("kpi_national_trend", lambda w: kpis.national_trend(w.agg_transaction))
from_warehouse("kpi_avg_ticket", lambda w: kpis.avg_ticket(w.agg_transaction))
from_warehouse("kpi_category_mix", lambda w: kpis.category_mix(w.agg_transaction), stored=True)
from_warehouse("kpi_top_states", lambda w: kpis.top_states(w.state_txn_quarter), stored=True)
from_warehouse("kpi_txns_per_user", lambda w: kpis.txns_per_user(w.state_txn_quarter, w.state_user_quarter), stored=True)
from_warehouse("growth_qoq", lambda w: growth.qoq(w.state_txn_quarter))
from_warehouse("growth_leaders", lambda w: growth.leaders(w.state_txn_quarter))
from_warehouse("growth_leaders_service", lambda w: service.growth_leaders(w))
from_warehouse("growth_yoy", lambda w: growth.yoy(w.state_txn_quarter))
from_warehouse("category_outperformance", lambda w: growth.category_outperformance(w.agg_transaction), stored=True)
from_warehouse("category_hhi", lambda w: growth.category_hhi(w.agg_transaction), stored=True)
from_warehouse("expansion_signals", service.expansion_signals, stored=True)
from_warehouse("anomaly_robust_z", lambda w: outliers.robust_z(w.state_txn_quarter))
from_warehouse("anomaly_ticket_iqr", lambda w: outliers.ticket_iqr(w.state_txn_quarter))
# order values are smaller than the default floor of the report
from_warehouse("anomaly_district_swings", lambda w: outliers.district_swings(w.map_transaction, floor=1e6))

# -- service reads ---------------------------------------------------------------

from_warehouse("meta", service.meta)
from_warehouse("national_trend", lambda w: rounded(service.national_trend(w)))
from_warehouse("latest_period", service.latest_period)
from_warehouse("available_quarters", service.available_quarters)
from_warehouse("category_mix_at", lambda w: rounded(service.category_mix(w, PERIOD), pct_value=9))
from_warehouse("top_states_at", lambda w: rounded(service.top_states(w, 10, PERIOD)))
from_warehouse("state_history", lambda w: rounded(service.state_history(w, STATE)))
from_warehouse("states", service.states)
from_warehouse("state_map_metrics", lambda w: rounded(service.state_map_metrics(w), yoy_pct=1), stored=True)
from_warehouse("kpi_tiles", lambda w: kpis.quarter_tiles(w.agg_transaction), stored=True)
from_warehouse("quarter_snapshot", lambda w: kpis.quarter_tiles(w.agg_transaction, PERIOD), stored=True)


@query
def map_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States spelt as slugs of region names, so that the name match has something to match."""
    facts = OrderFacts(spark, sf_dir)
    nations = facts.table("nation").join(
        facts.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("state"), F.col("r_name").alias("display_name"))
    slug = F.concat(F.replace(F.lower("display_name"), F.lit(" "), F.lit("-")), F.lit("-islands"))
    by_region = (
        service.state_map_metrics(StoredFacts(spark, sf_dir)).join(nations, "state")
        .groupBy(slug.alias("state")).agg(F.sum("txn_amount").alias("txn_amount"), F.max("yoy_pct").alias("yoy_pct"))
    )
    names = nations.select("display_name").distinct()
    return rounded(service.map_named(by_region, names), yoy_pct=1)


# -- quality ---------------------------------------------------------------------

from_warehouse("dq_report", lambda w: rounded(quality.run_checks(w), 9), stored=True)
from_warehouse("dq_summary", lambda w: quality.summary(quality.run_checks(w)), stored=True)
from_warehouse("dq_panel_gaps", lambda w: quality.panel_gaps(w.state_txn_quarter), stored=True)
from_warehouse("dq_missing_cells", lambda w: quality.missing_cells(w.state_txn_quarter), stored=True)

# -- panels, features, forecasts ---------------------------------------------------

def panel_of(w: Warehouse) -> DataFrame:
    return panels.state_panel(w, CATEGORIES)


def features_of(w: Warehouse) -> DataFrame:
    return features.build_features(panel_of(w), CATEGORIES)


SHARE_DIGITS = {c: 9 for c in panels.share_columns(CATEGORIES)}
FEATURE_DIGITS = {**{c: 9 for c in [*feature_columns(CATEGORIES), "y_log"]}, **SHARE_DIGITS}


def _panel(df: DataFrame) -> DataFrame:
    return rounded(df, **SHARE_DIGITS)


def _features(df: DataFrame) -> DataFrame:
    return rounded(df, **FEATURE_DIGITS)


from_warehouse("panel_state", lambda w: _panel(panel_of(w)))
from_warehouse("panel_category", lambda w: _panel(panels.category_panel(w, CATEGORIES)))
from_warehouse("panel_district", lambda w: _panel(panels.district_panel(w, categories=CATEGORIES)))
from_warehouse("panel_grid", lambda w: _panel(panels.full_grid(settle(panel_of(w)))))
from_warehouse("features", lambda w: _features(features_of(w)))
from_warehouse("forecast_frame", lambda w: _features(features.forecast_frame(settle(panel_of(w)), CATEGORIES)))

# the same over facts with holes and faults
for _name, _build in {
    "dq_report": lambda w: rounded(quality.run_checks(w), 9),
    "dq_summary": lambda w: quality.summary(quality.run_checks(w)),
}.items():
    QUERIES[f"{_name}_damaged"] = lambda spark, sf_dir, f=_build: f(StoredFacts(spark, sf_dir, DamagedFacts(spark, sf_dir)))
for _name, _build in {
    "dq_panel_gaps": lambda w: quality.panel_gaps(w.state_txn_quarter),
    "dq_missing_cells": lambda w: quality.missing_cells(w.state_txn_quarter),
    "panel_state": lambda w: _panel(panel_of(w)),
    "panel_grid": lambda w: _panel(panels.full_grid(settle(panel_of(w)))),
    "panel_district": lambda w: _panel(panels.district_panel(w, categories=CATEGORIES)),
    "features": lambda w: _features(features_of(w)),
}.items():
    QUERIES[f"{_name}_thinned"] = lambda spark, sf_dir, f=_build: f(StoredFacts(spark, sf_dir, ThinnedFacts(spark, sf_dir)))

from_warehouse("baseline_predictions", lambda w: rounded(backtest.baseline_predictions(features_of(w))))
from_warehouse("last_periods", lambda w: backtest.last_periods(features_of(w)))
from_warehouse("interval_quantiles", lambda w: rounded(intervals.residual_log_quantiles(settle(features_of(w))), 9))
from_warehouse("interval_coverage", lambda w: rounded(intervals.coverage(settle(features_of(w))), 9))


def _forecast(df: DataFrame) -> DataFrame:
    return rounded(df, growth_vs_last_pct=6, forecast_ridge=0)


from_warehouse(
    "forecast_state",
    lambda w: _forecast(forecast.next_quarter(panel_of(w), CATEGORIES, ridge=False)),
)
from_warehouse("forecast_state_ridge", lambda w: _forecast(service.Insights(w, CATEGORIES).forecast_next_quarter()))


def category_forecasts(w: Warehouse, top: int) -> DataFrame:
    return service.Insights(w, CATEGORIES).forecast_categories(top)


def district_forecasts(w: Warehouse, state: str | None = None) -> DataFrame:
    return service.Insights(w, CATEGORIES).forecast_districts(30, state)


from_warehouse("forecast_category", lambda w: _forecast(category_forecasts(w, 25)))
from_warehouse("forecast_district", lambda w: _forecast(district_forecasts(w)))
from_warehouse("forecast_district_of_state", lambda w: _forecast(district_forecasts(w, STATE)))
from_warehouse("fastest_categories", lambda w: forecast.fastest(service.Insights(w, CATEGORIES).category_forecasts))


# -- backtest ----------------------------------------------------------------------

def baseline_backtest(w: Warehouse) -> DataFrame:
    """Folds of the three baselines, settled for the reports on top."""
    return settle(backtest.walk_forward(settle(features_of(w)), models_factory=list))


from_warehouse("backtest_baselines", lambda w: rounded(baseline_backtest(w)))
from_warehouse(
    "metrics_by_model",
    lambda w: rounded(metrics.summarize(baseline_backtest(w)), 9, mae=2, rmse=2),
)
from_warehouse(
    "metrics_by_entity",
    lambda w: rounded(
        metrics.error_by_group(baseline_backtest(w).filter(F.col("model") == "seasonal_yoy"), "state"), 9, mae=2
    ),
)
from_warehouse("leaderboard", lambda w: reports.leaderboard(baseline_backtest(w)))
from_warehouse("wape_by_fold", lambda w: reports.wape_by_fold(baseline_backtest(w)))
from_warehouse("hardest_easiest", lambda w: reports.hardest_easiest(baseline_backtest(w)))


@query
def predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest predictions through the CSV sink and back."""
    path = scratch_path(spark, "predictions")
    predictions = baseline_backtest(OrderFacts(spark, sf_dir))
    sinks.write_csv(predictions, path)
    return rounded(spark.read.schema(predictions.schema).option("header", True).csv(path))


@query
def district_quartiles_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of districts' quarterly amounts per state, from stored sketches of single quarters."""
    path, rows = scratch_path(spark, "sketches"), StoredFacts(spark, sf_dir).map_transaction
    for half in ("year < 1995", "year >= 1995"):
        store_sketches(rows.filter(half), "txn_amount", ["state"], path)
    return rounded(merged_quantiles(stored_sketches(spark, path), [0.25, 0.5, 0.75], ["state"]))


@query
def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge alone: fitted on all history, applied to the coming quarter."""
    rows = settle(features.features_and_next(settle(panel_of(OrderFacts(spark, sf_dir))), CATEGORIES))
    model = ridge.Ridge(CATEGORIES).fit(rows.filter(~F.col("is_next")))
    return rounded(model.predict(rows.filter("is_next")).select("state", "period_key", "y_pred"), 0)


@query
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(features_of(OrderFacts(spark, sf_dir)))
    return rounded(ridge.Ridge(CATEGORIES).fit(rows).model.weights(spark), 6)


@query
def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(features.features_and_next(settle(panel_of(OrderFacts(spark, sf_dir))), CATEGORIES))
    model = Boosting(CATEGORIES).fit(rows.filter(~F.col("is_next")))
    return model.predict(rows.filter("is_next")).select("state", "period_key", "y_pred")


@query
def backtest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model with its own defaults; the folds of the boosted one are fitted side by side."""
    rows = settle(features_of(OrderFacts(spark, sf_dir)))
    return backtest.walk_forward(rows, models_factory=lambda: backtest.default_models(CATEGORIES), parallelism=8)


# -- anomalies and segments ----------------------------------------------------------

from_warehouse("behaviour_signals", lambda w: rounded(signals.behaviour_signals(features_of(w)), 9, txn_amount=2, avg_ticket=7))


@query
def signals_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the forest sees."""
    rows = settle(signals.behaviour_signals(features_of(OrderFacts(spark, sf_dir))))
    scaled = signals.standard(signals.moments(rows))
    return rounded(rows.select("state", "period_ord", *[z.alias(s) for s, z in scaled.items()]), 6)


def _scores(df: DataFrame) -> DataFrame:
    return rounded(df, 9, txn_amount=2, avg_ticket=7)


from_warehouse("anomaly_scores", lambda w: _scores(signals.detect(features_of(w))))
from_warehouse("anomalies", lambda w: _scores(service.Insights(w, CATEGORIES).anomalies()))
from_warehouse("anomaly_report", lambda w: reports.anomaly_report(signals.detect(features_of(w))))
from_warehouse(
    "state_profiles",
    lambda w: rounded(segments.state_profiles(panel_of(w), categories=CATEGORIES), 9, avg_ticket=7),
)


@query
def choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = OrderFacts(spark, sf_dir)
    profiles = settle(segments.state_profiles(panel_of(w), categories=CATEGORIES))
    points = settle(segments.standardised(profiles, segments.profile_columns(CATEGORIES)))
    return segments.choose_k_table(segments.choose_k(points, profiles.count()), spark)


@query
def segments_first_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start points drawn by name for three clusters, and the states nearest to each."""
    profiles = settle(segments.state_profiles(panel_of(OrderFacts(spark, sf_dir)), categories=CATEGORIES))
    points = settle(segments.standardised(profiles, segments.profile_columns(CATEGORIES)))
    centres = kmeans.start_points(points, 3, 1, 42, "state", "features")[0]
    cluster = kmeans.nearest(F.col("features"), centres)
    gap = F.least(*[kmeans.squared(F.col("features"), c) for c in centres])
    return rounded(points.select("state", cluster.alias("cluster"), gap.alias("gap")), 6)


@query
def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = service.Insights(OrderFacts(spark, sf_dir), CATEGORIES).segmentation
    return reports.segment_report(found.clusters, segments.profile_shares(CATEGORIES))


from_warehouse("segments", lambda w: service.Insights(w, CATEGORIES).segments())
from_warehouse("state_forecast", lambda w: _forecast(service.Insights(w, CATEGORIES).state_forecast(STATE)))
from_warehouse("state_cluster", lambda w: service.Insights(w, CATEGORIES).state_cluster(STATE))
from_warehouse("state_outlook", lambda w: service.Insights(w, CATEGORIES).with_forecast(STATE))
from_warehouse("state_detail", lambda w: service.Insights(w, CATEGORIES).state_detail(), stored=True)
from_warehouse("snapshot", lambda w: service.Insights(w, CATEGORIES).snapshot(), stored=True)


def through(sink, spark: SparkSession, df: DataFrame) -> DataFrame:
    """A frame as it comes back from a sink."""
    path = scratch_path(spark, "sink")
    sink(df, path)
    reader = spark.read.schema(df.schema)
    return reader.json(path) if sink is sinks.write_json else reader.option("header", True).csv(path)


def _sink_query(name: str, sink, build: Callable[[service.Insights], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: through(
        sink, spark, build(service.Insights(StoredFacts(spark, sf_dir), CATEGORIES))
    )


_sink_query("anomalies_csv", sinks.write_csv, lambda i: _scores(i.anomaly_ranking))
_sink_query("segments_csv", sinks.write_csv, lambda i: i.segments())
_sink_query("snapshot_json", sinks.write_json, lambda i: i.snapshot())
_sink_query("insight_document", sinks.write_json, lambda i: i.document())


@query
def segments_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation with a given number of clusters."""
    found = segments.segment(settle(panel_of(OrderFacts(spark, sf_dir))), k=3, categories=CATEGORIES)
    return segments.members(found)


# -- ingestion -------------------------------------------------------------------------

def landed(spark: SparkSession, sf_dir: str, *kinds: str, broken: Column | None = None) -> str:
    """Write the facts as leaves below the shared folder; bodies of ``broken`` leaves are cut in half."""
    bodies = landing.leaf_bodies(StoredFacts(spark, sf_dir), kinds or tuple(landing.KINDS))
    if broken is not None:
        half = F.left(F.col("body"), F.floor(F.length("body") / 2).cast("int"))
        bodies = bodies.withColumn("body", F.when(broken, half).otherwise(F.col("body")))
    root = scratch_path(spark, "landing")
    landing.write_leaves(bodies, root)
    return root


@query
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves.discover_files(spark, landed(spark, sf_dir), min_year=1996, max_year=2000)


@query
def classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of leaves the facts would land as, next to paths that are no leaves."""
    paths = settle(landing.leaf_bodies(StoredFacts(spark, sf_dir)).select("rel_path"))
    strange = F.array(
        F.col("rel_path"),
        F.replace(F.col("rel_path"), F.lit("/user/"), F.lit("/insurance/")),
        F.replace(F.col("rel_path"), F.lit(".json"), F.lit(".txt")),
        F.concat(F.lit("other/"), F.col("rel_path")),
    )
    return leaves.classify_paths(paths.select(F.explode(F.array_distinct(strange)).alias("rel_path")))


@query
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = settle(landing.leaf_bodies(StoredFacts(spark, sf_dir)).select("rel_path"))
    return leaves.route_files(leaves.classify_paths(paths)).select("rel_path", leaves.target_table().alias("table_name"))


def _parse_query(table: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bodies = leaves.read_bodies(spark, landed(spark, sf_dir, table))
        return leaves.PARSERS[table](bodies)

    QUERIES[f"parse_{table}"] = run


for _name in TABLES:
    _parse_query(_name)


@query
def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of leaves land; those of first quarters arrive cut in half."""
    root = landed(spark, sf_dir, broken=F.col("rel_path").rlike(r"/1\.json$"))
    return leaves.quarantine(leaves.read_bodies(spark, root))


@query
def ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole job: leaves to stored tables; the totals of every table as it is read back."""
    done = ingest(spark, landed(spark, sf_dir), scratch_path(spark, "warehouse"))
    return table_totals(done.warehouse)


@query
def ingest_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a whole job, most of it observed while the tables are written."""
    return rounded(ingest(spark, landed(spark, sf_dir), scratch_path(spark, "warehouse")).checks, 9)


@query
def ingest_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated leaves only: the other tables exist and are empty."""
    done = ingest(spark, landed(spark, sf_dir), scratch_path(spark, "warehouse"), datasets=["aggregated"])
    return load_counts(done.warehouse)


def refreshed(spark: SparkSession, sf_dir: str) -> Refreshed:
    """Two arrivals, odd quarters first, each followed by a refresh.

    Of the second one, a year's leaves carry file times of long before the first, and the user
    leaves of second quarters are cut in half.
    """
    root, out, state = (scratch_path(spark, label) for label in ("landing", "tables", "progress"))
    bodies = settle(landing.leaf_bodies(StoredFacts(spark, sf_dir)))
    odd = F.col("rel_path").rlike(r"/[13]\.json$")
    broken = F.col("rel_path").rlike(r"^aggregated/user/.*/2\.json$")
    half = F.left(F.col("body"), F.floor(F.length("body") / 2).cast("int"))
    landing.write_leaves(bodies.filter(odd), root)
    refresh(spark, root, out, state)
    landing.write_leaves(bodies.filter(~odd).withColumn("body", F.when(broken, half).otherwise(F.col("body"))), root)
    landing.backdate(spark, root, "map/user/hover/country/*/state/*/1996/[24].json", 400)
    return refresh(spark, root, out, state)


@query
def refresh_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_totals(refreshed(spark, sf_dir).warehouse)


@query
def refresh_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refreshed(spark, sf_dir).quarantine


@query
def refresh_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything lands and is loaded; then one quarter is corrected and user leaves of another are withdrawn."""
    root, out = landed(spark, sf_dir), scratch_path(spark, "tables")
    reconcile(spark, root, out)
    landing.write_leaves(landing.leaf_bodies(CorrectedFacts(spark, sf_dir), ["agg_transaction"]), root)
    landing.withdraw(spark, root, "map/user/hover/country/*/state/*/1996/1.json")
    return table_totals(reconcile(spark, root, out).warehouse)


def table_totals(w: Warehouse) -> DataFrame:
    """Rows and summed figures of each table, exact to the cent."""
    out = None
    for name in TABLES:
        df = getattr(w, name)
        count, money = ("txn_count", "txn_amount") if "txn_count" in df.columns else ("registered_users", "app_opens")
        part = df.agg(
            F.count("*").alias("n_rows"), F.sum(count).alias("first_sum"),
            F.sum(F.col(money).cast("decimal(18,2)")).cast("double").alias("second_sum"),
        ).select(F.lit(name).alias("table_name"), "n_rows", "first_sum", "second_sum")
        out = part if out is None else out.unionByName(part)
    return out
