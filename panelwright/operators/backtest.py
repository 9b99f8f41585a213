"""Walk-forward backtest: each holdout quarter is predicted from the quarters before it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import clip_zero
from panelwright.schemas import BASELINES, CATEGORIES
from panelwright.operators.boosting import Boosting
from panelwright.operators.ridge import Ridge

PREDICTION = ["state", "period_key", "period_ord", "y_true", "model", "y_pred"]


class Forecaster(Protocol):
    """What ``walk_forward`` needs of a model. ``predict`` adds ``y_pred`` to the rows.

    A model may also offer ``predict_folds(df, periods)`` to serve all folds at once.
    """

    name: str

    def fit(self, train: DataFrame) -> "Forecaster": ...

    def predict(self, test: DataFrame) -> DataFrame: ...


def default_models(categories: Sequence[str] = CATEGORIES, rounds: int = 300) -> list[Forecaster]:
    return [Ridge(categories), Boosting(categories, rounds)]


def baseline_predictions(features: DataFrame) -> DataFrame:
    """Melt the baseline columns: one row per entity, quarter and baseline."""
    pairs = F.array(*[F.struct(F.lit(b).alias("model"), F.col(b).alias("y_pred")) for b in BASELINES])
    return features.select(
        "state", "period_key", "period_ord", F.col("txn_amount").alias("y_true"), F.inline(pairs)
    ).withColumn("y_pred", clip_zero(F.col("y_pred")))


def last_periods(features: DataFrame, n_holdout: int = 8) -> DataFrame:
    """The newest quarters of the frame."""
    return features.select("period_ord").distinct().orderBy(F.desc("period_ord")).limit(n_holdout)


def fold_periods(
    features: DataFrame,
    test_periods: Sequence[int] | None = None,
    n_holdout: int = 8,
    min_train: int = 100,
) -> list[int]:
    """Holdout quarters that have rows and enough training rows before them.

    Decided from one count per calendar quarter.
    """
    sizes = sorted((r.period_ord, r["count"]) for r in features.groupBy("period_ord").count().collect())
    wanted = [p for p, _ in sizes][-n_holdout:] if test_periods is None else list(test_periods)
    present = {p for p, _ in sizes}
    return [p for p in wanted if p in present and sum(n for q, n in sizes if q < p) >= min_train]


def walk_forward(
    features: DataFrame,
    test_periods: Sequence[int] | None = None,
    models_factory: Callable[[], Sequence[Forecaster]] = default_models,
    min_train: int = 100,
    n_holdout: int = 8,
    parallelism: int = 4,
) -> DataFrame:
    """Predictions of every model and baseline for every fold, in long form.

    Pass a frame that is cheap to read again (see ``session.settle``); models that fit per
    fold are trained ``parallelism`` folds at a time, as Spark's cross-validation does.
    """
    folds = fold_periods(features, test_periods, n_holdout, min_train)
    if not folds:
        raise ValueError("no backtest fold has enough rows; check min_train and test_periods")
    held_out = features.filter(F.col("period_ord").isin(folds))
    parts = [baseline_predictions(held_out)]

    def one_fold(job: tuple[int, int]) -> DataFrame:
        index, period = job
        model = models_factory()[index].fit(features.filter(F.col("period_ord") < period))
        return _long(model.predict(features.filter(F.col("period_ord") == period)), model.name)

    jobs = []
    for index, model in enumerate(models_factory()):
        if hasattr(model, "predict_folds"):
            predicted = model.predict_folds(features, folds).filter(F.col("period_ord").isin(folds))
            parts.append(_long(predicted, model.name))
        else:
            jobs += [(index, period) for period in folds]
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        parts += list(pool.map(one_fold, jobs))
    return reduce(DataFrame.unionByName, parts)


def _long(predicted: DataFrame, model: str) -> DataFrame:
    return predicted.select(
        "state", "period_key", "period_ord", F.col("txn_amount").alias("y_true"),
        F.lit(model).alias("model"), clip_zero(F.col("y_pred")).alias("y_pred"),
    )
