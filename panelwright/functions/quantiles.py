"""Exact quantiles of few but large groups, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ALL = "_all"
#: Ranges that a band of values is cut into.
RANGES = 1024


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ...`` and the count ``n``, one row per group.

    ``F.median``/``F.percentile`` keep every distinct value of a group in one task's
    memory. That suits many small groups; here a group (a calendar quarter, or the whole
    frame) may hold most of the rows. Three map-side combined passes are used instead:

    1. a mergeable sketch proposes a narrow value band around every wanted rank,
    2. exact counts below and inside each band are taken,
    3. equal values inside the bands are folded, each band is cut into ``RANGES`` ranges of
       values that are counted, and only the range that holds the rank is ranked.

    The result does not depend on how good the sketch is: a band that misses its rank is
    replaced by the whole span of the group, and cut into ranges like any other.
    """
    keys = list(by) or [_ALL]
    rows = df if by else df.withColumn(_ALL, F.lit(0))
    rows = rows.select(*keys, F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull())
    half = 2.0 / accuracy
    edges = [e for p in probs for e in (max(p - half, 0.0), min(p + half, 1.0))]

    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("x", edges, accuracy).alias("edge")
    )
    counts = (
        rows.join(sketch, keys)
        .groupBy(*keys, "edge")
        .agg(
            F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"),
            *[F.count_if(F.col("x") < F.col("edge")[2 * i]).alias(f"below{i}") for i in range(len(probs))],
            *[
                F.count_if(F.col("x").between(F.col("edge")[2 * i], F.col("edge")[2 * i + 1])).alias(f"in{i}")
                for i in range(len(probs))
            ],
        )
    )

    def band(i: int, p: float):
        pos = (F.col("n") - 1) * F.lit(float(p))
        first, last = F.floor(pos), F.ceil(pos)
        held = (F.col(f"below{i}") <= first) & (last < F.col(f"below{i}") + F.col(f"in{i}"))
        return F.struct(
            F.lit(i).alias("i"),
            F.when(held, F.col("edge")[2 * i]).otherwise(F.col("least")).alias("lo"),
            F.when(held, F.col("edge")[2 * i + 1]).otherwise(F.col("most")).alias("hi"),
            F.when(held, F.col(f"below{i}")).otherwise(F.lit(0)).alias("skipped"),
            first.alias("first"),
            last.alias("last"),
            (pos - first).alias("part"),
        )

    bands = counts.select(*keys, "n", F.array(*[band(i, p) for i, p in enumerate(probs)]).alias("bands"))
    hit = (
        rows.join(bands, keys)
        .select(
            *keys, "n", "x",
            F.explode(
                F.filter("bands", lambda b: F.col("x").between(b["lo"], b["hi"]))
            ).alias("b"),
        )
        .groupBy(*keys, "n", "b", "x")
        .agg(F.count("*").alias("c"))
    )
    wide = F.col("b.hi") - F.col("b.lo")
    cut = F.when(wide > 0, F.floor((F.col("x") - F.col("b.lo")) / wide * (RANGES - 1))).otherwise(0)
    cells = hit.withColumns({"i": F.col("b.i"), "cell": F.coalesce(cut, F.lit(0)).cast("int")})
    so_far = Window.partitionBy(*keys, "i").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        cells.groupBy(*keys, "i", "cell").agg(F.sum("c").alias("held"), F.first("b").alias("b"))
        .withColumn("end", F.col("b.skipped") + F.sum("held").over(so_far))
        .withColumn("start", F.col("end") - F.col("held"))
        .filter((F.col("start") <= F.col("b.last")) & (F.col("end") > F.col("b.first")))
        .select(*keys, "i", "cell", "start")
    )
    inside = Window.partitionBy(*keys, "i", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        cells.join(counted, [*keys, "i", "cell"])
        .withColumn("upto", F.col("start") + F.sum("c").over(inside))
        .groupBy(*keys, "n", F.col("b.i").alias("i"), F.col("b.part").alias("part"))
        .agg(
            F.min(F.when(F.col("upto") > F.col("b.first"), F.col("x"))).alias("a"),
            F.min(F.when(F.col("upto") > F.col("b.last"), F.col("x"))).alias("z"),
        )
        .withColumn("q", F.col("a") + (F.col("z") - F.col("a")) * F.col("part"))
    )
    out = ends.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))]
    )
    return out if by else out.drop(_ALL)


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row, one column: the exact median of the whole frame, for use as a scalar."""
    return exact_quantiles(df, value, [0.5]).select("q0")
