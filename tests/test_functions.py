from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import (
    compose, exact_quantiles, finite_or_null, normalize_name, parity_round, period_label, ratio, split_child, split_parent,
)
from panelwright.functions.entities import district_key


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_round_follows_the_binary_value(spark):
    row = one(spark, *[parity_round(F.lit(x), 2).alias(str(i)) for i, x in enumerate([0.285, 1.005, -2.5, 2.675])])
    assert list(row) == [0.28, 1.0, -2.5, 2.68]
    assert one(spark, parity_round(F.lit(-0.25), 1))[0] == -0.3
    assert one(spark, parity_round(F.lit(1e17), 2))[0] == 1e17
    assert one(spark, parity_round(F.lit(None).cast("double"), 2))[0] is None
    assert math.isnan(one(spark, parity_round(F.lit(float("nan")), 2))[0])


def test_ratio_by_zero_is_infinite_or_nan(spark):
    a, b = F.lit(1.0), F.lit(0.0)
    row = one(spark, ratio(a, b), ratio(-a, b), ratio(b, b), ratio(a, F.lit(None)), ratio(F.lit(3), F.lit(2)))
    assert row[0] == math.inf and row[1] == -math.inf and math.isnan(row[2]) and row[3] is None and row[4] == 1.5
    assert one(spark, finite_or_null(ratio(a, b)), finite_or_null(ratio(b, b)))[:] == (None, None)


def test_entities_round_trip(spark):
    row = one(
        spark, compose(F.lit("westland"), F.lit("Bills")).alias("e"),
        split_parent(F.lit("a | b | c")), split_child(F.lit("a | b | c")),
        split_parent(F.lit("solo")), split_child(F.lit("solo")), compose(F.lit("a"), F.lit(None)),
    )
    assert list(row) == ["westland | Bills", "a", "b | c", "solo", "", None]


@pytest.mark.parametrize("slug,name", [
    ("upper-westland", "Upper Westland"),
    ("salt-&-pepper", "Salt and Pepper"),
    ("reef-&-bay-islands", "Reef and Bay"),
])
def test_names_match(spark, slug, name):
    assert len(set(one(spark, normalize_name(F.lit(slug)), normalize_name(F.lit(name))))) == 1


def test_labels_and_district_keys(spark):
    assert list(one(spark, period_label(F.lit(20243)), district_key(F.lit("Harbour District")))) == ["2024Q3", "harbour"]


@pytest.mark.parametrize("n,accuracy", [(1, 100), (7, 100), (5000, 100), (5000, 10_000)])
def test_quantiles_are_exact_whatever_the_sketch(spark, n, accuracy):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.lognormal(0, 3, n), np.full(n // 3, 1.5)])
    group = np.where(np.arange(len(values)) % 3 == 0, "b", "a")
    pdf = pd.DataFrame({"g": group, "v": values})
    df = spark.createDataFrame(pdf)
    probs = [0.1, 0.5, 0.99]
    got = {r.g: r for r in exact_quantiles(df, "v", probs, by=["g"], accuracy=accuracy).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g].n == len(part)
        assert np.allclose([got[g].q0, got[g].q1, got[g].q2], part["v"].quantile(probs), rtol=1e-12)
    whole = exact_quantiles(df, "v", [0.0, 1.0], accuracy=accuracy).first()
    assert (whole.q0, whole.q1) == (values.min(), values.max())
