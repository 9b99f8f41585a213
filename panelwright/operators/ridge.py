"""Ridge regression on the log target, for any number of expanding windows in one scan.

Only per-quarter sums of products leave the executors: (features + 2)^2 numbers for each
calendar quarter, however many rows there are. The training window of every backtest fold is
a prefix of the quarters, so all folds are solved from running totals of the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.schemas import CATEGORIES, feature_columns

# Fixed value: strength of the penalty.
ALPHA = 5.0
LOG_TARGET = "y_log"


@dataclass(frozen=True)
class RidgeModel:
    """Weights for standardised features; ``predict`` is a plain column expression."""

    features: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray
    intercept: float

    @property
    def slopes(self) -> np.ndarray:
        return self.weight / self.std

    @property
    def constant(self) -> float:
        return float(self.intercept - self.mean @ self.slopes)

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        """Prediction in the units of the target."""
        terms = F.lit(self.constant)
        for feature, slope in zip(self.features, self.slopes):
            terms = terms + F.col(feature) * float(slope)
        return df.withColumn(name, F.expm1(terms))

    def weights(self, spark: SparkSession) -> DataFrame:
        """Feature weights, strongest first."""
        rows = [(f, float(w), abs(float(w))) for f, w in zip(self.features, self.weight)]
        return spark.createDataFrame(rows, "feature string, weight double, abs_weight double").orderBy(
            F.desc("abs_weight"), "feature"
        )


@dataclass(frozen=True)
class QuarterSums:
    """Sums of products of (1, features, target) per quarter, about a common centre."""

    features: tuple[str, ...]
    centre: np.ndarray
    quarters: np.ndarray
    sums: np.ndarray

    def _total(self, quarter: int | None) -> np.ndarray:
        use = self.quarters < quarter if quarter is not None else np.ones(len(self.quarters), bool)
        return self.sums[use].sum(axis=0)

    def solve(self, before: int | None = None, alpha: float = ALPHA) -> RidgeModel:
        """Model fitted on the quarters before the given one, or on all of them."""
        total = self._total(before)
        n = total[0, 0]
        shift = total[0, 1:] / n
        moments = total[1:, 1:] - n * np.outer(shift, shift)
        mean = self.centre + shift
        var = np.maximum(np.diag(moments)[:-1] / n, 0.0)
        eps = np.finfo(float).eps
        constant = var <= n * eps * var + (n * mean[:-1] * eps) ** 2
        std = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, var)))
        xx = moments[:-1, :-1] / np.outer(std, std)
        xx[constant, :] = 0.0
        xx[:, constant] = 0.0
        xy = np.where(constant, 0.0, moments[:-1, -1] / std)
        weight = np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)
        return RidgeModel(self.features, mean[:-1], std, weight, float(mean[-1]))


def quarter_sums(df: DataFrame, features: Sequence[str]) -> QuarterSums | None:
    """Scan ``df`` (features, ``y_log``, ``period_ord``) once; None when it has no rows.

    A first small aggregate finds the means. Products about them lose no digits when the
    window totals are centred later.
    """
    features = tuple(features)
    columns = [*features, LOG_TARGET]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if means[0] is None:
        return None
    centre = np.array(list(means), dtype=float)
    width = len(columns) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.ones((len(pdf), width))
            z[:, 1:] = pdf[columns].to_numpy(dtype=float) - centre
            quarter = pdf["period_ord"].to_numpy()
            for q in np.unique(quarter):
                part = z[quarter == q]
                held[int(q)] = held.get(int(q), 0.0) + part.T @ part
        if held:
            yield pd.DataFrame({"period_ord": list(held), "products": [g.ravel() for g in held.values()]})

    parts = df.select("period_ord", *columns).mapInPandas(
        partial, "period_ord int, products array<double>"
    )
    cells = (
        parts.select("period_ord", F.posexplode("products").alias("cell", "v"))
        .groupBy("period_ord", "cell").agg(F.sum("v").alias("v"))
        .collect()  # quarters x width^2 numbers
    )
    quarters = np.array(sorted({r.period_ord for r in cells}))
    place = {q: i for i, q in enumerate(quarters)}
    sums = np.zeros((len(quarters), width, width))
    for r in cells:
        sums[place[r.period_ord]].flat[r.cell] = r.v
    return QuarterSums(features, centre, quarters, sums)


class Ridge:
    """Forecaster with the ``name`` / ``fit`` / ``predict`` protocol of the backtest."""

    name = "ridge"

    def __init__(self, categories: Sequence[str] = CATEGORIES, alpha: float = ALPHA):
        self.features, self.alpha, self.model = feature_columns(categories), alpha, None

    def fit(self, train: DataFrame) -> "Ridge":
        sums = quarter_sums(train, self.features)
        if sums is None:
            raise ValueError("no training rows")
        self.model = sums.solve(alpha=self.alpha)
        return self

    def predict(self, test: DataFrame) -> DataFrame:
        return self.model.predict(test)

    def predict_folds(self, df: DataFrame, periods: Sequence[int]) -> DataFrame:
        """Predictions of every fold, each from the quarters before it, in one fit pass.

        The fold models form a lookup of one short array per fold.
        """
        sums = quarter_sums(df, self.features)
        models = {p: sums.solve(p, self.alpha) for p in periods}
        rows = [(int(p), [float(s) for s in m.slopes], m.constant) for p, m in models.items()]
        folds = df.sparkSession.createDataFrame(rows, "period_ord int, slopes array<double>, constant double")
        inputs = F.array(*[F.col(f) for f in self.features])
        linear = F.aggregate(
            F.zip_with("slopes", inputs, lambda s, x: s * x), F.col("constant"), lambda total, v: total + v
        )
        return (
            df.join(F.broadcast(folds), "period_ord")
            .withColumn("y_pred", F.expm1(linear))
            .drop("slopes", "constant")
        )
