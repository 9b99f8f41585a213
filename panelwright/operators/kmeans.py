"""Many k-means fits in the same passes over the points, and the Euclidean silhouette.

All (k, start) models take their Lloyd step together: one scan gives each point its centre in every model, and
one aggregate sums the points of every centre. Start points are drawn by a hash of the entity's name, each
with a chance in proportion to its squared distance from the points drawn before, so that a fit
does not depend on how the rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import settle

# Longest run of steps, and how far (squared, as a share of the points' variance) centres that stand still may move.
STEPS, STILL = 300, 1e-4
#: Points that are compared with each other at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Model:
    """Centres of one fit, and the sum of squared distances to them."""

    centres: np.ndarray
    cost: float

    def predict(self, points: DataFrame, features: str = "features", name: str = "prediction") -> DataFrame:
        """The points with the number of their nearest centre; a plain column expression."""
        return points.withColumn(name, nearest(F.col(features), self.centres))


def squared(point: Column, centre: Sequence[float]) -> Column:
    """Squared distance of an array column from given coordinates."""
    out = F.lit(0.0)
    for i, c in enumerate(centre):
        gap = point[i] - F.lit(float(c))
        out = out + gap * gap
    return out


def nearest(point: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre; of equally near ones the first."""
    options = F.array(*[F.struct(squared(point, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(options)["i"]


def draw(name: Column, *salt: object) -> Column:
    """A number in (0, 1] from a name, the same in any engine with md5."""
    text = F.concat_ws(":", *[F.lit(str(s)) for s in salt], name)
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)


def start_points(points: DataFrame, most: int, starts: int, seed: int, name: str, features: str) -> np.ndarray:
    """(start, number, coordinate) of ``most`` points for each start; ``k`` clusters begin at the first ``k``.

    Each pass draws one point for every start: the one whose race -ln(draw) / squared distance ends first.
    Only when points run out is one drawn twice.
    """
    held: list[np.ndarray] = []
    for number in range(most):
        races = []
        for s in range(starts):
            gap = F.lit(1.0)
            if held:
                gap = F.least(*[squared(F.col(features), h[s]) for h in held]) if len(held) > 1 else squared(F.col(features), held[0][s])
            race = F.when(gap > 0, -F.ln(draw(F.col(name), seed + s, number)) / gap)
            races.append(F.min(F.struct(F.coalesce(race, F.lit(float("inf"))), F.col(name), F.col(features)))[features].alias(f"p{s}"))
        row = points.agg(*races).first()
        held.append(np.array([row[f"p{s}"] for s in range(starts)], float))
    return np.stack(held, axis=1)


def lloyd(points: DataFrame, models: list[np.ndarray], features: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of all models: counts and sums of every centre's points, and the cost of every model."""
    first = np.append(0, np.cumsum([len(m) for m in models]))
    flat = np.concatenate(models)
    width = flat.shape[1] + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cost = np.zeros((len(flat), width)), np.zeros(len(models))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width - 1)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                gap = ((part[:, None, :] - flat[None]) ** 2).sum(axis=-1)
                for m in range(len(models)):
                    own = gap[:, first[m] : first[m + 1]]
                    label = own.argmin(axis=1)
                    cost[m] += own[np.arange(len(own)), label].sum()
                    ones = np.column_stack([np.ones(len(part)), part])
                    np.add.at(total, first[m] + label, ones)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size + len(cost))), pa.array(np.append(total.ravel(), cost))], names=["cell", "v"])

    cells = points.select(features).mapInArrow(work, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(len(flat) * width + len(models))
    for r in cells.collect():  # one number for each coordinate of each centre
        out[r.cell] = r.v
    total = out[: len(flat) * width].reshape(len(flat), width)
    return total[:, 0], total[:, 1:], out[len(flat) * width :]


def fit_all(points: DataFrame, ks: Sequence[int], starts: int = 10, seed: int = 42, name: str = "state",
            features: str = "features", steps: int = STEPS, still: float = STILL) -> dict[int, Model]:
    """For every k the cheapest of several starts, all fitted in the same passes.

    A model stands still when its centres move less than ``still`` times the mean variance of a
    coordinate; it takes no further part in the passes. A centre without points stays where it is.
    """
    rows = settle(points.select(name, features))
    begin = start_points(rows, max(ks), starts, seed, name, features)
    jobs = [(k, s) for k in ks for s in range(starts)]
    centres = {job: begin[job[1], : job[0]] for job in jobs}
    size = len(begin[0, 0])
    spread = rows.agg(*[F.var_pop(F.col(features)[i]) for i in range(size)]).first()
    limit, moving = still * float(np.mean(spread)), list(jobs)
    for _ in range(steps):
        counts, sums, _ = lloyd(rows, [centres[j] for j in moving], features)
        at, left = 0, []
        for j in moving:
            k = len(centres[j])
            n, total = counts[at : at + k, None], sums[at : at + k]
            new = np.where(n > 0, total / np.maximum(n, 1), centres[j])
            moved = float(((new - centres[j]) ** 2).sum())
            centres[j] = new
            at += k
            if moved > limit:
                left.append(j)
        moving = left
        if not moving:
            break
    _, _, costs = lloyd(rows, [centres[j] for j in jobs], features)
    cost = dict(zip(jobs, costs))
    best = {k: min((j for j in jobs if j[0] == k), key=lambda j: (round(cost[j], 9), j)) for k in ks}
    return {k: Model(centres[j], float(cost[j])) for k, j in best.items()}


def silhouette(labelled: DataFrame, features: str = "features", label: str = "prediction") -> float | None:
    """Mean silhouette under Euclidean distance, by the definition; None without two clusters.

    Points are cut into blocks by a hash and every block meets every other one once: blocks are compared
    inside the tasks and leave one sum of distances for each of their points and clusters, so no
    pair of points ever is a row. A point that is alone in its cluster counts as 0.
    """
    sizes = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}  # one row a cluster
    if len(sizes) < 2:
        return None
    names = sorted(sizes)
    count = np.array([sizes[c] for c in names], float)
    blocks = -(-int(count.sum()) // BLOCK)
    place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col(label)) - 1
    point = F.struct(F.monotonically_increasing_id().alias("id"), F.col(features).alias("x"), place.cast("int").alias("c"))
    rows = settle(labelled.select(point.alias("p")).select("p", F.pmod(F.xxhash64("p"), F.lit(blocks)).alias("own")))
    packed = settle(rows.groupBy("own").agg(F.collect_list("p").alias("points")))  # about BLOCK points each
    every = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")
    other = packed.select(F.col("own").alias("with"), F.col("points").alias("others"))
    pairs = packed.withColumn("with", F.explode(every)).join(other, "with").select("points", "others")

    def coordinates(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = points.field("x")
        return x.flatten().to_numpy().reshape(len(points), -1), points.field("c").to_numpy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                mine, rest = batch.column(0)[r].values, batch.column(1)[r].values
                (x, c), (y, d) = coordinates(mine), coordinates(rest)
                sums = np.zeros((len(x), len(names)))
                for i, v in enumerate(x):
                    np.add.at(sums[i], d, np.sqrt(((y - v) ** 2).sum(axis=1)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, len(names)), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([mine.field("id"), pa.array(c, pa.int32()), flat], names=["id", "c", "sums"])

    met = pairs.mapInArrow(work, "id bigint, c int, sums array<double>")
    whole = met.groupBy("id", "c").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(names))])
    inside = F.lit(None).cast("double")
    outside = []
    for i, n in enumerate(count):
        inside = F.when(F.col("c") == i, F.col(f"s{i}") / F.lit(max(n - 1, 1.0))).otherwise(inside)
        outside.append(F.when(F.col("c") != i, F.col(f"s{i}") / F.lit(n)))
    alone = F.col("c").isin([i for i, n in enumerate(count) if n == 1])
    near = F.least(*outside)
    width = F.when(alone | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return whole.select(inside.alias("a"), near.alias("b"), "c").agg(F.avg(width)).first()[0]
