"""Merged sketches against exact ranks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.sketches import merged_quantiles, quantile, rank_error, sketched, sketches, store_sketches, stored_sketches
from panelwright.operators import growth
from tests import fixtures

SHARES = [0.01, 0.25, 0.5, 0.9]


@pytest.fixture(scope="module")
def rows(spark):
    """Two groups over eight quarters: one large and skewed, one small with nulls."""
    large = spark.range(160_000).select(
        F.lit("large").alias("state"), (2020 + F.floor(F.col("id") / 4) % 2).cast("int").alias("year"), (1 + F.col("id") % 4).cast("int").alias("quarter"),
        F.exp(F.randn(3) * 2).alias("v"))
    small = spark.range(40).select(
        F.lit("small").alias("state"), F.lit(2020).alias("year"), (1 + F.col("id") % 4).cast("int").alias("quarter"),
        F.when(F.col("id") % 4 != 3, F.col("id").cast("double")).alias("v"))
    return large.unionByName(small).persist()


def check(got, rows, error):
    for r in got.collect():
        own = np.sort([x.v for x in rows.filter((F.col("state") == r.state) & F.col("v").isNotNull()).select("v").collect()])
        assert r.n == len(own)
        for i, p in enumerate(SHARES):
            low, high = np.searchsorted(own, r[f"q{i}"], "left") / len(own), np.searchsorted(own, r[f"q{i}"], "right") / len(own)
            assert low - error <= p <= high + error, (r.state, p)
            assert r[f"q{i}"] in own


def test_merged_quarters_keep_the_stated_error(rows):
    assert 0.004 < rank_error() < 0.006
    held = sketches(rows, "v", ["state"])
    assert held.count() == 11  # the small group lacks a quarter's values
    check(merged_quantiles(held, SHARES, ["state"]), rows, rank_error())
    small = merged_quantiles(held.filter("state = 'small'"), [0.5], ["state"]).first()
    assert (small.n, small.q0) == (30, 18.0)  # exact
    assert merged_quantiles(held.limit(0), [0.5], ["state"]).collect() == []


def test_refresh_reads_new_quarters_only(spark, rows, tmp_path):
    path = str(tmp_path / "sketches")
    old, new = rows.filter("year = 2020"), rows.filter("year = 2021")
    store_sketches(old, "v", ["state"], path)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("year=2020/**/*.parquet")}
    store_sketches(new, "v", ["state"], path)  # the old rows are not given
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items())
    check(merged_quantiles(stored_sketches(spark, path), SHARES, ["state"]), rows, rank_error())
    corrected = new.filter("quarter = 2").withColumn("v", F.lit(1e9))
    store_sketches(corrected, "v", ["state"], path)
    large = stored_sketches(spark, path).filter("state = 'large' and year = 2021 and quarter = 2")
    assert merged_quantiles(large, [0.5], ["state"]).first().q0 == 1e9


def test_flag_of_the_growth_report(spark):
    s = fixtures.warehouse(spark).state_txn_quarter
    exact, near = (growth.leaders(s, approximate=flag).collect() for flag in (False, True))
    assert [r.state for r in exact] == [r.state for r in near]
    assert all(abs(a.median_qoq_pct - b.median_qoq_pct) <= 0.2 for a, b in zip(exact, near))
    assert rows_of(s.groupBy().agg(quantile(sketched("txn_amount"), 0.5).alias("q"))) in {r.txn_amount for r in s.collect()}


def rows_of(df):
    return df.first()[0]
