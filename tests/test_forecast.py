from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import backtest, features, forecast, intervals, metrics, panels
from panelwright.operators.boosting import Boosting
from panelwright.operators.ridge import ALPHA, Ridge, quarter_sums
from panelwright.plans import reports
from panelwright.schemas import feature_columns
from panelwright.session import settle
from tests import fixtures


@pytest.fixture(scope="module")
def rows(spark):
    return settle(features.build_features(fixtures.panel(spark, states=12, n=16)))


def closed_form(x, y, alpha=ALPHA):
    """Standardise by population deviation, centre the target, solve the penalised equations."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std < 1e-12] = 1.0
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda new: np.expm1(((new - mean) / std) @ w + y.mean())


def test_ridge_equals_the_closed_form_for_every_fold(rows):
    pdf = rows.toPandas()
    names = feature_columns()
    folds = sorted(pdf.period_ord.unique())[-3:]
    got = Ridge().predict_folds(rows, folds).toPandas().set_index(["state", "period_ord"])["y_pred"]
    for t in folds:
        train, test = pdf[pdf.period_ord < t], pdf[pdf.period_ord == t]
        want = closed_form(train[names].to_numpy(), train["y_log"].to_numpy())(test[names].to_numpy())
        assert np.allclose(got.loc[list(zip(test.state, test.period_ord))], want, rtol=1e-8)
    alone = Ridge().fit(rows.filter(F.col("period_ord") < folds[-1]))
    last = alone.predict(rows.filter(F.col("period_ord") == folds[-1])).toPandas().set_index(["state", "period_ord"])["y_pred"]
    assert np.allclose(last.sort_index(), got.xs(folds[-1], level="period_ord", drop_level=False).sort_index(), rtol=1e-8)


def test_ridge_ignores_constants_and_partitioning(spark, rows):
    model = Ridge().fit(rows).model
    weights = {r.feature: r.weight for r in model.weights(spark).collect()}
    assert all(weights[f"{c}_lag1"] == 0.0 for c in ("share_merchant", "share_others"))
    other = Ridge().fit(rows.repartition(7)).model
    assert np.allclose(model.weight, other.weight, rtol=1e-9, atol=1e-12)
    listed = [abs(r.weight) for r in model.weights(spark).collect()]
    assert listed == sorted(listed, reverse=True)
    assert quarter_sums(rows.limit(0), feature_columns()) is None


class Spy:
    """Records how far each training window reaches."""

    name = "spy"
    seen: list[tuple[int, int]] = []

    def fit(self, train):
        self.newest = train.agg(F.max("period_ord")).first()[0]
        return self

    def predict(self, test):
        self.seen.append((self.newest, test.agg(F.min("period_ord")).first()[0]))
        return test.withColumn("y_pred", F.lit(-1.0))


def test_training_ends_before_the_test_quarter(rows):
    Spy.seen = []
    out = backtest.walk_forward(rows, models_factory=lambda: [Spy()], n_holdout=3, min_train=20)
    assert len(Spy.seen) == 3 and all(newest < tested for newest, tested in Spy.seen)
    assert {r[0] for r in out.select("model").distinct().collect()} == {"spy", "naive_last", "seasonal_naive", "seasonal_yoy"}
    assert out.filter(F.col("model") == "spy").agg(F.min("y_pred"), F.max("y_pred")).first()[:] == (0.0, 0.0)


def test_all_models_and_reports(rows):
    out = settle(backtest.walk_forward(
        rows, models_factory=lambda: [Ridge(), Boosting(rounds=3)], n_holdout=2, min_train=50
    ))
    assert {r[0]: r[1] for r in out.groupBy("model").count().collect()} == dict.fromkeys(
        ["naive_last", "seasonal_naive", "seasonal_yoy", "ridge", "gbm"], 24)
    assert out.filter((F.col("y_pred") < 0) | F.col("y_pred").isNull()).isEmpty()
    board = reports.leaderboard(out).toPandas()
    assert board.wape_pct.is_monotonic_increasing
    assert board[board.model == "naive_last"].lift_pct.iloc[0] == 0.0
    folds = reports.wape_by_fold(out).collect()
    assert len(folds) == 2 and {r.best_model for r in folds} == {board.model.iloc[0]}
    ends = reports.hardest_easiest(out, 3, 2).toPandas()
    assert list(ends.side.value_counts().sort_index()) == [2, 3]


def test_too_little_history_is_an_error(rows):
    with pytest.raises(ValueError):
        backtest.walk_forward(rows, models_factory=list, min_train=10**6)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [("a", 50.0, 62.0), ("a", 150.0, 147.0), ("a", 40.0, 40.0), ("b", 8.0, 12.0), ("c", 0.0, 0.0), ("d", 5.0, None)],
        "model string, y_true double, y_pred double",
    )
    got = {r.model: r for r in metrics.summarize(df).collect()}
    a = got["a"]
    assert a.mae == 5.0 and math.isclose(a.rmse, math.sqrt(153 / 3)) and math.isclose(a.wape, 15 / 240)
    assert math.isclose(a.bias, 3.0 / 80) and 0 <= a.smape <= 2
    assert got["b"].bias == 0.5 and got["c"].wape is None and got["c"].smape is None
    assert got["d"].n_scored == 0 and got["d"].mae is None
    worst = metrics.error_by_group(df.withColumnRenamed("model", "state"), "state").collect()
    assert [r.state for r in worst][:2] == ["b", "a"] and worst[0].n == 1


def test_intervals(spark):
    perfect = spark.range(20).select((F.col("id") + 1.0).alias("txn_amount"), (F.col("id") + 1.0).alias("seasonal_yoy"))
    assert list(intervals.residual_log_quantiles(perfect).first())[:2] == [0.0, 0.0]
    assert list(intervals.residual_log_quantiles(perfect.limit(9)).first()) == [0.0, 0.0, 9]
    assert list(intervals.residual_log_quantiles(perfect.limit(0)).first()) == [0.0, 0.0, 0]
    noisy = spark.range(2000).select(
        (F.exp(F.randn(7) * 0.3) * 1000).alias("txn_amount"), F.lit(1000.0).alias("seasonal_yoy"))
    noisy = settle(noisy)
    q = intervals.residual_log_quantiles(noisy).first()
    assert q.q_low < 0 < q.q_high
    assert abs(intervals.coverage(noisy).first().coverage - 0.8) < 0.01


@pytest.mark.parametrize("grain", ["state", "category", "district"])
def test_next_quarter_of_every_grain(spark, grain):
    w = fixtures.warehouse(spark)
    out = settle(forecast.next_quarter(getattr(panels, f"{grain}_panel")(w)))
    assert out.columns == forecast.FORECAST
    got = out.collect()
    assert len(got) == {"state": 3, "category": 9, "district": 6}[grain]
    for r in got:
        assert r.forecast_lo <= r.forecast_champion * (1 + 1e-9) and r.forecast_champion <= r.forecast_hi * (1 + 1e-9)
        # constant growth: the champion continues it
        assert math.isclose(r.growth_vs_last_pct, 100 * (fixtures.GROWTH - 1), rel_tol=1e-6) and r.forecast_ridge > 0
    if grain == "category":
        top = forecast.top_children(out, "category", 4).collect()
        assert [r.state for r in top][0] == "northland" and len(top) == 4
        assert forecast.fastest(out, pool=3, top=2).count() == 2
    if grain == "district":
        assert {r.state for r in forecast.top_children(out, "district", 30, "westland").collect()} == {"westland"}


def test_no_panel_no_forecast(spark):
    w = fixtures.warehouse(spark, districts=False)
    assert forecast.next_quarter(panels.district_panel(w)).count() == 0
    short = panels.state_panel(fixtures.warehouse(spark, n=4))
    assert forecast.next_quarter(short).count() == 0
