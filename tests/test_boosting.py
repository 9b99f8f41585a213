"""Boosted trees against a plain version that looks at every row and every cut."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import boosting
from panelwright.operators.boosting import Boosting, best_splits, fit_folds, quantile_bins
from panelwright.operators.features import build_features
from panelwright.schemas import feature_columns
from panelwright.session import settle
from tests import fixtures


@pytest.fixture(scope="module")
def rows(spark):
    df = build_features(fixtures.panel(spark, states=12))
    noise = 1 + (F.abs(F.hash("state", "period_ord")) % 1000) / 2000
    return settle(df.withColumns({c: F.col(c) * noise for c in ("lag1_log_amt", "roll4_log_amt", "y_log")}))


def grow(x, rest, cuts, depth):
    """(residuals, counts) leaf values of one tree as a function; splits by the largest gain over all cuts."""
    lam, least = boosting.PENALTY, boosting.LEAST

    def node(own, d):
        g, n = rest[own].sum(), len(own)
        best = (0.0, None)
        if d < depth:
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left = x[own, f] <= c
                    nl = left.sum()
                    if nl < least or n - nl < least:
                        continue
                    gl = rest[own][left].sum()
                    gain = gl**2 / (nl + lam) + (g - gl) ** 2 / (n - nl + lam) - g**2 / (n + lam)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, c))
        if best[1] is None:
            return boosting.STEP * g / (n + lam)
        f, c = best[1]
        return f, c, node(own[x[own, f] <= c], d + 1), node(own[x[own, f] > c], d + 1)

    return node(np.arange(len(x)), 0)


def walk(tree, row):
    while isinstance(tree, tuple):
        f, c, left, right = tree
        tree = left if row[f] <= c else right
    return tree


def plain(train, test, features, cuts, rounds):
    x, y = train[features].to_numpy(float), train["y_log"].to_numpy(float)
    score, out = np.full(len(y), y.mean()), np.full(len(test), y.mean())
    for _ in range(rounds):
        tree = grow(x, y - score, cuts, boosting.DEPTH)
        score = score + np.array([walk(tree, r) for r in x])
        out = out + np.array([walk(tree, r) for r in test[features].to_numpy(float)])
    return np.expm1(out)


def test_folds_against_a_plain_version(rows):
    features = feature_columns()
    table = rows.toPandas()
    last = sorted(table.period_ord.unique())[-2:]
    got = Boosting(rounds=12).predict_folds(rows, last).toPandas()
    assert set(got.period_ord) == set(last) and list(got.columns) == [*rows.columns, "y_pred"]
    for p in last:
        cuts = quantile_bins(rows, features, [int(p)])[0][0]
        test = table[table.period_ord == p].sort_values("state")
        want = plain(table[table.period_ord < p], test, features, cuts, 12)
        own = got[got.period_ord == p].sort_values("state")
        assert np.allclose(own.y_pred, want, rtol=1e-9)


def test_one_fit_equals_its_fold_and_learns(rows):
    table = rows.toPandas()
    last = int(table.period_ord.max())
    before = settle(rows.filter(F.col("period_ord") < last))
    alone = Boosting(rounds=23).fit(before).predict(rows.filter(F.col("period_ord") == last)).toPandas()
    folds = Boosting(rounds=23).predict_folds(rows, [last - 1, last]).toPandas()
    a = alone.sort_values("state").y_pred
    b = folds[folds.period_ord == last].sort_values("state").y_pred
    assert np.allclose(a, b)  # across the renewal of the blocks
    own = Boosting(rounds=40).fit(rows).predict(rows).toPandas()
    assert ((own.y_log - np.log1p(own.y_pred)) ** 2).mean() < 0.3 * own.y_log.var()


def test_partitioning_does_not_matter(rows, monkeypatch):
    features = feature_columns()
    one = fit_folds(rows, features, [None], 5)
    monkeypatch.setattr(boosting, "ROWS", 7)
    many = fit_folds(rows.repartition(9), features, [None], 5)
    assert (one.split == many.split).all() and np.allclose(one.leaf, many.leaf)


def test_leaves_keep_their_least_size_and_penalty():
    sums = np.zeros((2, 1, 1, 1, boosting.BINS))
    sums[0, 0, 0, 0, :3], sums[1, 0, 0, 0, :3] = [30.0, -5.0, -10.0], [30, 5, 10]
    feature, cut, sides = best_splits(sums)
    assert feature[0, 0] == -1 and sides[:, 0, 0, 0].tolist() == [15.0, 45.0]  # no side of 20 on the right
    sums[1, 0, 0, 0, 2] = 20
    feature, cut, sides = best_splits(sums)
    assert (feature[0, 0], cut[0, 0]) == (0, 0) and sides[0, 0, 0].tolist() == [30.0, -15.0]


def test_no_rows(rows):
    with pytest.raises(ValueError):
        Boosting(rounds=2).fit(rows.limit(0))
    assert Boosting(rounds=0).fit(rows).predict(rows.limit(3)).count() == 3


@pytest.mark.parametrize("parts", [1, 3])
def test_splits_are_decided_on_the_executors(spark, parts, monkeypatch):
    """The driver gets the splits of all rows, and none of the sums."""
    rng = np.random.default_rng(6)
    blocks = [(rng.integers(0, boosting.BINS, (2, 500, 4)), rng.normal(size=500), rng.random((2, 500)) < 0.8, np.zeros((2, 500)))
              for _ in range(3)]
    blocks = [(b, y + b[0, :, 1] / 100, trains, score) for b, y, trains, score in blocks]
    split, cut = np.full((2, 7), -1), np.zeros((2, 7), np.int64)
    rdd = spark.sparkContext.parallelize(blocks, parts)
    monkeypatch.setattr(type(rdd), "treeReduce", None)
    for depth in range(3):
        whole = sum(boosting.level_sums(b, split, cut, depth) for b in blocks)
        found, want = boosting._level(rdd, (), split, cut, depth), boosting.best_splits(whole)
        assert all(a.shape == b.shape and np.allclose(a, b) for a, b in zip(found, want))
        split[:, (1 << depth) - 1 : (2 << depth) - 1], cut[:, (1 << depth) - 1 : (2 << depth) - 1], _ = found
    assert (split[:, 0] >= 0).all()
