"""Segmentation of states by recent behaviour: profiles, choice of k, clusters."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import finite_or_null, nan_to_null, over_nonzero, ratio
from panelwright.operators import kmeans
from panelwright.schemas import CATEGORIES, share_columns
from panelwright.session import settle

# Behaviour metrics of a profile, range of k, number of starts.
BEHAVIOUR = ["yoy_growth", "txns_per_user", "avg_ticket", "user_growth"]
K_RANGE = range(2, 7)
STARTS = 10


def profile_shares(categories: Sequence[str] = CATEGORIES) -> list[str]:
    """A profile uses the shares of the first three categories."""
    return share_columns(categories)[:3]


def profile_columns(categories: Sequence[str] = CATEGORIES) -> list[str]:
    return [*BEHAVIOUR, *profile_shares(categories)]


def state_profiles(panel: DataFrame, recent: int = 4, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row per state: means over its last ``recent`` quarters.

    A row is recent when no row lies ``recent`` places ahead of it, which needs no second sort.
    """
    time = Window.partitionBy("state").orderBy("period_ord")

    def yearly(column: str) -> Column:
        return nan_to_null(ratio(F.col(column), F.lag(column, 4).over(time)) - 1)

    shares = profile_shares(categories)
    rows = panel.select(
        "state",
        yearly("txn_amount").alias("yoy_growth"),
        over_nonzero(F.col("txn_count"), F.col("registered_users")).alias("txns_per_user"),
        over_nonzero(F.col("txn_amount"), F.col("txn_count")).alias("avg_ticket"),
        yearly("registered_users").alias("user_growth"),
        *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in shares],
        F.lead("period_ord", recent).over(time).isNull().alias("is_recent"),
    )
    means = rows.filter("is_recent").groupBy("state").agg(
        *[finite_or_null(F.avg(c)).alias(c) for c in [*BEHAVIOUR, *shares]]
    )
    return means.dropna(subset=BEHAVIOUR)


def standardised(profiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Profiles with an array ``features`` of columns scaled by population mean and deviation."""
    stats = profiles.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = [(F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)]
    return profiles.withColumn("features", F.array(*scaled))


def squared_silhouette(labelled: DataFrame) -> float:
    """Mean silhouette of ``features`` / ``prediction`` under squared Euclidean distance.

    The evaluator's closed form needs the sums of each cluster only.
    """
    return ClusteringEvaluator(metricName="silhouette").evaluate(labelled.withColumn("features", array_to_vector("features")))


@dataclass(frozen=True)
class Choice:
    """Chosen number of clusters; silhouette of every candidate, by distance and by its square."""

    k: int
    scores: dict[int, float] = field(default_factory=dict)
    squared: dict[int, float] = field(default_factory=dict)
    model: kmeans.Model | None = None


def choose_k(points: DataFrame, n: int, k_range: Sequence[int] = K_RANGE, seed: int = 42) -> Choice:
    """k with the best Euclidean silhouette; min(2, n) when no candidate is below ``n``."""
    candidates = [k for k in k_range if k < n]
    if not candidates:
        return Choice(min(2, n))

    models = kmeans.fit_all(points, candidates, STARTS, seed)
    # every model's labels next to each other: the points are read once for all of them
    found = settle(points.select("features", *[kmeans.nearest(F.col("features"), m.centres).alias(f"k{k}") for k, m in models.items()]))
    with ThreadPoolExecutor(2 * len(candidates)) as pool:
        widths = pool.map(lambda k: kmeans.silhouette(found, label=f"k{k}"), candidates)
        squares = pool.map(lambda k: squared_silhouette(found.withColumnRenamed(f"k{k}", "prediction")), candidates)
        scores, squared = dict(zip(candidates, widths)), dict(zip(candidates, squares))
    scores = {k: -1.0 if v is None else v for k, v in scores.items()}  # a fit that left one cluster
    best = max(scores, key=scores.get)
    return Choice(best, scores, squared, models[best])


def choose_k_table(choice: Choice, spark) -> DataFrame:
    rows = [(k, float(s), float(choice.squared[k]), k == choice.k) for k, s in choice.scores.items()]
    return spark.createDataFrame(rows, "k int, silhouette double, silhouette_squared double, chosen boolean")


@dataclass(frozen=True)
class Segments:
    """Labelled profiles, one profile row per cluster, and how they came about."""

    labelled: DataFrame
    clusters: DataFrame
    choice: Choice
    silhouette: float | None
    n: int


def _stable_labels(labelled: DataFrame) -> DataFrame:
    """Number clusters by size, then by smallest member, so that reruns agree."""
    sizes = labelled.groupBy("prediction").agg(F.count("*").alias("n"), F.min("state").alias("first"))
    order = F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1  # one row per cluster
    names = sizes.select("prediction", order.alias("cluster"))
    return labelled.join(F.broadcast(names), "prediction").drop("prediction", "features")


def segment(
    panel: DataFrame, k: int | None = None, categories: Sequence[str] = CATEGORIES, seed: int = 42
) -> Segments:
    """Cluster states by profile. Fewer than two states form one bucket, with k = 0."""
    columns = profile_columns(categories)
    profiles = settle(state_profiles(panel, categories=categories))
    n = profiles.count()
    if n < 2:
        labelled = profiles.withColumn("cluster", F.lit(0))
        return Segments(labelled, _cluster_profile(labelled, columns), Choice(0), None, n)
    points = standardised(profiles, columns).persist()
    try:
        choice = choose_k(points, n, seed=seed) if k is None else Choice(k)
        model = choice.model or kmeans.fit_all(points, [choice.k], STARTS, seed)[choice.k]
        found = model.predict(points)
        width = choice.scores.get(choice.k)
        if width is None and 1 < choice.k < n:
            width = kmeans.silhouette(found)
        labelled = settle(_stable_labels(found))
    finally:
        points.unpersist()
    return Segments(labelled, _cluster_profile(labelled, columns), choice, width, n)


def _cluster_profile(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    return labelled.groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in columns], F.count("*").alias("n_states")
    )


def members(segments: Segments) -> DataFrame:
    """One row per member, next to the profile of its cluster."""
    rows = segments.labelled.select("cluster", "state")
    return rows.join(F.broadcast(segments.clusters), "cluster").orderBy("cluster", "state")
