from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import features, panels
from panelwright.schemas import feature_columns
from tests import fixtures


@pytest.fixture(scope="module")
def panel(spark):
    return fixtures.panel(spark).persist()


def test_lags_are_the_previous_quarters(panel):
    rows = features.build_features(panel).toPandas()
    known = panel.toPandas().set_index(["state", "period_ord"])["txn_amount"]
    for _, r in rows.iterrows():
        for k in (1, 2, 4):
            assert math.isclose(r[f"lag{k}_log_amt"], math.log1p(known[(r.state, r.period_ord - k)]))
        last4 = [math.log1p(known[(r.state, r.period_ord - k)]) for k in (1, 2, 3, 4)]
        assert math.isclose(r.roll4_log_amt, np.mean(last4))
        assert r.naive_last == known[(r.state, r.period_ord - 1)]


def test_own_target_does_not_leak(panel):
    at = (F.col("state") == "s1") & (F.col("period_key") == 20203)
    bumped = panel.withColumn("txn_amount", F.when(at, F.col("txn_amount") * 1000).otherwise(F.col("txn_amount")))
    before, after = (features.build_features(p).filter(at).select(feature_columns()).first() for p in (panel, bumped))
    assert np.allclose(list(before), list(after))


def test_gaps_are_kept_apart_by_calendar_lags(panel):
    gappy = panel.filter(~((F.col("state") == "s1") & (F.col("period_key") == 20203)))
    grid = panels.full_grid(gappy)
    hole = grid.filter((F.col("state") == "s1") & (F.col("period_key") == 20203)).collect()
    assert len(hole) == 1 and hole[0].txn_amount is None and hole[0].year == 2020
    assert grid.count() == panel.count()
    # lags over the filled grid by row and lags over the gappy panel by range are the same
    a, b = (
        features.build_features(p).orderBy("state", "period_ord").select("state", "period_ord", *feature_columns()).toPandas()
        for p in (gappy, grid)
    )
    pd.testing.assert_frame_equal(a, b)
    following = a[(a.state == "s1") & (a.period_ord == 2020 * 4 + 3)]
    assert following.empty  # no previous quarter, so the row cannot be used


def test_features_are_finite(panel):
    wild = panel.withColumns({
        "registered_users": F.when(F.col("quarter") == 2, F.lit(0)).otherwise(F.col("registered_users")),
        "txn_amount": F.when(F.col("period_key") == 20194, F.lit(0.0)).otherwise(F.col("txn_amount")),
    })
    x = features.build_features(wild).select(feature_columns()).toPandas().to_numpy()
    assert len(x) and np.isfinite(x).all()


def test_infinite_core_growth_is_kept_as_zero_and_undefined_is_dropped(panel):
    zero = panel.withColumn("txn_amount", F.when(F.col("period_key").isin(20193, 20194), 0.0).otherwise(F.col("txn_amount")))
    rows = features.build_features(zero).filter(F.col("state") == "s1").toPandas().set_index("period_key")
    assert 20201 not in rows.index  # 0 / 0
    assert rows.loc[20202, "qoq_amt_lag1"] == 0.0  # x / 0


def test_next_quarter_frame(panel):
    ahead = features.forecast_frame(panel).toPandas()
    last = panel.agg(F.max("period_ord")).first()[0]
    assert set(ahead.state) == {"s1", "s2", "s3"} and set(ahead.period_ord) == {last + 1}
    assert np.isfinite(ahead[feature_columns()].to_numpy()).all()
    assert features.forecast_frame(panel.limit(0)).count() == 0


def test_one_shuffle_serves_all_features(panel):
    stored = features.build_features(panel)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Window") == 1


def test_panels_of_all_grains(spark):
    w = fixtures.warehouse(spark)
    state, category, district = panels.state_panel(w), panels.category_panel(w), panels.district_panel(w)
    assert state.select("state").distinct().count() == 3
    assert category.select("state").distinct().count() == 9
    assert district.select("state").distinct().count() == 6
    assert district.filter(F.col("registered_users").isNull()).count() == 0
    assert {r[0] for r in category.select("share_others").distinct().collect()} == {0.0}
    row = state.select("share_merchant", "share_peer-to-peer", "share_others").first()
    assert math.isclose(row[0], 2 / 7.5) and math.isclose(row[1], 5 / 7.5) and row[2] is None
    for grain in (state, category, district):
        assert features.build_features(grain).count() > 0
    assert panels.district_panel(w, min_quarters=16).count() == 0


def test_both_spellings_of_a_district_do_not_double_rows(spark):
    from panelwright.sources.warehouse import from_tables

    w = fixtures.warehouse(spark)
    plain = w.map_user.withColumn("district", F.regexp_replace("district", " district$", ""))
    both = from_tables(spark, {
        "map_transaction": w.map_transaction, "map_user": w.map_user.unionByName(plain), "agg_user": w.agg_user,
    })
    assert panels.district_panel(both).count() == panels.district_panel(w).count()
