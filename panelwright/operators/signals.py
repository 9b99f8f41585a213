"""Same-quarter behaviour signals and multivariate anomaly scores.

Scores follow Liu, Ting and Zhou, "Isolation Forest", ICDM 2008. Trees are grown on samples
of fixed size, so their cost does not depend on the data; all rows are scored in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import exact_quantiles, finite_or_null, over_nonzero, ratio
from panelwright.session import settle

# Signal names, forest size, sample size and share of flagged rows.
SIGNALS = [
    "qoq_amt", "qoq_cnt", "avg_ticket", "ticket_chg", "user_growth", "txns_per_user", "value_user_gap",
]
TREES, SAMPLE, CONTAMINATION = 300, 256, 0.03
REPORT = [
    "state", "year", "quarter", "txn_amount", "qoq_amt", "user_growth", "value_user_gap", "avg_ticket",
    "anomaly_score", "is_anomaly",
]
_NODE = "struct<node: int, feature: int, cut: double, n: int>"


def behaviour_signals(rows: DataFrame) -> DataFrame:
    """Seven signals per entity and quarter; rows where any is missing drop out.

    Changes are on the entity's previous row. One window, shared by all.
    """
    time = Window.partitionBy("state").orderBy("period_ord")

    def change(column: str) -> Column:
        return ratio(F.col(column), F.lag(column).over(time)) - 1

    ticket = over_nonzero(F.col("txn_amount"), F.col("txn_count"))
    signals = (
        rows.select(
            "state", "year", "quarter", "period_ord", "txn_count", "txn_amount", "registered_users"
        )
        .withColumn("avg_ticket", ticket)
        .withColumns({
            "qoq_amt": change("txn_amount"),
            "qoq_cnt": change("txn_count"),
            "ticket_chg": change("avg_ticket"),
            "user_growth": change("registered_users"),
            "txns_per_user": over_nonzero(F.col("txn_count"), F.col("registered_users")),
        })
        .withColumn("value_user_gap", F.col("qoq_amt") - F.col("user_growth"))
    )
    return signals.withColumns({s: finite_or_null(F.col(s)) for s in SIGNALS}).dropna(subset=SIGNALS)


def moments(rows: DataFrame) -> dict[str, float]:
    """Count, and mean and population deviation of every signal, from one pass."""
    return rows.agg(
        F.count("*").alias("n"),
        *[F.avg(s).alias(f"m_{s}") for s in SIGNALS],
        *[F.stddev_pop(s).alias(f"s_{s}") for s in SIGNALS],
    ).first().asDict()


def standard(spread: dict[str, float]) -> dict[str, Column]:
    """Signals in deviations from their mean; one that never varies is only centred."""
    return {s: (F.col(s) - spread[f"m_{s}"]) / (spread[f"s_{s}"] or 1.0) for s in SIGNALS}


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its arguments, whatever the partitioning, and the same in any engine with md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _binomial(n: int, p: float) -> list[float]:
    """Distribution function of the number of successes in ``n`` draws, up to where it is one."""
    out, total = [], 0.0
    for k in range(n + 1):
        log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        total += math.exp(log + k * math.log(p) + (n - k) * math.log1p(-p)) if p < 1.0 else float(k == n)
        out.append(total)
        if total > 1.0 - 1e-15:
            break
    return out


def _samples(rows: DataFrame, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """About ``sample`` rows for each tree, with the tree number.

    One law at every size: a hash of the row draws how many trees it serves (binomial), another
    which ones (distinct), so the cost follows the draws. A small surplus is drawn and cut to the
    exact size afterwards; a tree that has drawn fewer is grown on what it has.
    """
    share = min(1.0, 1.3 * sample / n)
    row = (F.col("state"), F.col("period_ord"))

    def draw(name: str) -> Column:
        return _uniform(F.lit(f"{name} {seed}"), *row)

    law = F.array(*[F.lit(x) for x in _binomial(trees, share)])
    many = F.least(F.lit(trees), F.size(F.filter(law, lambda x: x < draw("many"))))
    strides = [k for k in range(1, trees + 1) if math.gcd(k, trees) == 1]
    stride = F.array(*map(F.lit, strides))[F.floor(draw("stride") * len(strides)).cast("int")]
    first = F.floor(draw("first") * trees).cast("int")
    picks = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.pmod(first + i * stride, F.lit(trees)))
    drawn = rows.withColumn("_many", many).filter("_many > 0").withColumn("tree", F.explode(picks)).drop("_many")
    order = _uniform(F.lit(f"place {seed}"), F.col("tree"), *row)
    place = F.row_number().over(Window.partitionBy("tree").orderBy(order, "state", "period_ord"))
    return drawn.withColumn("place", place).filter(F.col("place") <= sample)


def _mean_depth(m: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among ``m`` points."""
    m = np.asarray(m, dtype=float)
    big = np.maximum(m, 3.0)
    full = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(m <= 1, 0.0, np.where(m == 2, 1.0, full))


def _grow(sampled: DataFrame, seed: int, limit: int) -> DataFrame:
    """``tree, node, feature, cut, n``: all trees, grown level by level. Leaves have ``feature`` -1.

    The children of node ``i`` are ``2 i`` and ``2 i + 1``. A hash of (tree, node) draws the feature, among those
    that vary in the node, and the cut, between its least and largest value there. Windows over the
    nodes of a tree find these; a tree's sample lies in one partition and is of fixed size.
    """
    node = Window.partitionBy("tree", "node")
    places = range(len(SIGNALS))
    rows = sampled.select("tree", F.array(*SIGNALS).alias("x"), F.lit(1).alias("node"), F.lit(False).alias("done"), F.array().cast(f"array<{_NODE}>").alias("trail"))
    for depth in range(limit + 1):
        rows = rows.withColumns({
            "n": F.count("*").over(node).cast("int"),
            "low": F.array(*[F.min(F.col("x")[i]).over(node) for i in places]),
            "high": F.array(*[F.max(F.col("x")[i]).over(node) for i in places]),
        })
        varied = F.filter(F.array(*map(F.lit, places)), lambda i: F.get("high", i) > F.get("low", i))
        pick = F.floor(_uniform(F.lit(f"feature {seed}"), F.col("tree"), F.col("node")) * F.size("varied")).cast("int")
        rows = rows.withColumn("varied", varied if depth < limit else F.array().cast("array<int>")).withColumn(
            "feature", F.when(F.size("varied") > 0, F.get("varied", pick)).otherwise(-1))
        low, high = F.get("low", F.col("feature")), F.get("high", F.col("feature"))
        cut = low + _uniform(F.lit(f"cut {seed}"), F.col("tree"), F.col("node")) * (high - low)
        # neighbouring doubles
        rows = rows.withColumn("cut", F.when(F.col("feature") >= 0, F.when(cut >= high, low).otherwise(cut)).otherwise(0.0))
        own = F.array(F.struct("node", "feature", "cut", "n"))
        right = (F.get("x", F.col("feature")) > F.col("cut")).cast("int")
        split = (F.col("feature") >= 0) & ~F.col("done")
        rows = rows.select(
            "tree", "x", F.when(split, 2 * F.col("node") + right).otherwise(F.col("node")).alias("node"),
            (F.col("done") | (F.col("feature") < 0)).alias("done"),
            F.when(F.col("done"), F.col("trail")).otherwise(F.concat("trail", own)).alias("trail"),
        )
    return rows.select("tree", F.inline("trail")).distinct()


def anomaly_scores(
    signals: DataFrame,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """Signals with ``anomaly_score`` in (0, 1) and ``is_anomaly`` for the top share of rows."""
    rows = settle(signals)
    spread = moments(rows)
    n = spread["n"]
    blank = {"anomaly_score": F.lit(None).cast("double"), "is_anomaly": F.lit(None).cast("boolean")}
    if n == 0:
        return rows.withColumns(blank)
    scaled = standard(spread)
    size = min(sample, n)
    limit = math.ceil(math.log2(max(size, 2)))
    points = rows.select("state", "period_ord", *[z.alias(s) for s, z in scaled.items()])
    sampled = _samples(points, n, trees, size, seed)
    nodes = _grow(sampled, seed, limit).toPandas()  # at most trees x (2 x sample - 1) nodes
    names = {t: i for i, t in enumerate(sorted(nodes["tree"].unique()))}
    at = (nodes["tree"].map(names).to_numpy(), nodes["node"].to_numpy())
    feature, cut, length = (np.full((len(names), 2 << limit), x) for x in (-1, 0.0, 0.0))
    feature[at], cut[at] = nodes["feature"], nodes["cut"]
    length[at] = np.floor(np.log2(nodes["node"])) + _mean_depth(nodes["n"])
    shared = signals.sparkSession.sparkContext.broadcast((feature, cut, length))
    scale = float(_mean_depth(size)) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total = np.zeros(len(points))
            line = np.arange(len(points))
            for feature, cut, length in zip(*shared.value):
                at = np.ones(len(points), dtype=int)
                for _ in range(limit):
                    f = feature[at]
                    at = np.where(f >= 0, 2 * at + (points[line, f] > cut[at]), at)
                total += length[at]
            yield pd.Series(np.exp2(-total / len(shared.value[0]) / scale))

    scored = settle(rows.withColumn("anomaly_score", score(*scaled.values())))
    edge = exact_quantiles(scored, "anomaly_score", [1.0 - contamination]).select("q0").scalar()
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > edge)


def detect(rows: DataFrame, contamination: float = CONTAMINATION, **options) -> DataFrame:
    """Rows ranked by how unusual their combination of signals is."""
    scored = anomaly_scores(behaviour_signals(rows), contamination, **options)
    return scored.orderBy(F.desc("anomaly_score"), "state", "year", "quarter").select(*REPORT)
