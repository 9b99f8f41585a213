"""Periodic runs of words: every maximal stretch that repeats itself four times or more.

Periods are handled by octave: octave ``P`` holds the periods from ``P`` to ``2 P - 1``, and its
boundaries are the words number 0, P, 2 P, ... of a document. Where a stretch keeps period ``q`` for at
least four periods, words ``i`` and ``i + q`` agree at 3 q places in a row, so a boundary ``m`` of the
octave lies among them from which agreement holds for ``P`` words at least. The work goes in
three steps:

* **Tiles.** Each document is cut, once for each octave, into overlapping tiles of ``SPAN``
  boundaries. Hashes of the ``P`` words at a boundary and at every place that is a period of the
  octave further on tell which tiles may hold agreement; hashes of all places double from one octave to
  the next, so this takes a few vector operations a word and octave. The other tiles go no further.
* **Fragments.** A tile is solved by itself, wherever it lands: at each boundary a Z-function to the
  right and one to the left give how far agreement reaches for all periods of the octave at once. A
  period that is a multiple of a smaller one is told by the same Z-function and dropped.
* **Runs.** Fragments, (document, period, first, end), are dealt out by document and period and
  touching ones are joined. A stretch of agreement ``[a, b)`` at period ``q`` is a run ``[a, b + q)``.

Documents without a tile that may hold agreement are done after the first step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import stash

#: Fewest periods and fewest words of a run.
TIMES, WORDS = 4, 6
#: Boundaries of a tile.
SPAN = 8
#: Texts cut together by a task.
ROWS = 500

Rewrite = Callable[[list[bytes], object], list[bytes]]
TILE = "struct<octave: int, tile: int, first: bigint, size: bigint, ids: array<int>>"


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, others don't."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, range(len(words))), np.int64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def flagged(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries by number) where a run's agreement over ``P`` words may begin; never misses one."""
    n, octave = len(ids), 0
    held = _mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    while n >= max(WORDS, TIMES << octave):
        p = 1 << octave
        last = (n - 2 * p) // p + 1  # boundaries with room for the words at m + P
        shifted = held[p:]
        most = min(len(shifted) // p, last)
        hit = np.zeros((last, p), bool)  # boundary, period
        hit[:most] = shifted[: most * p].reshape(most, p) == held[: most * p : p, None]
        rest = shifted[most * p : last * p]
        if most < last:
            hit[most, : len(rest)] = rest == held[most * p]
        # agreement over three periods begins anew at two neighbouring boundaries at least
        pair = (hit[:-1] & hit[1:]).any(axis=1)
        if pair.any():
            yield octave, np.flatnonzero(np.append(pair, False) | np.append(False, pair))
        held = _mix(held[: len(held) - p] * np.uint64(0x9E3779B97F4A7C15) + held[p:])
        octave += 1


def tiles(ids: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(octave, tile, number of its first word, words of the document, its words) of tiles that may hold agreement.

    A tile reaches one boundary to the left, and four beyond its last one: two for how far
    agreement is followed, two for the period.
    """
    out = []
    for octave, at in flagged(ids):
        p = 1 << octave
        for k in np.unique(at // SPAN).tolist():
            first = max(0, (k * SPAN - 1) * p)
            out.append((octave, k, first, len(ids), ids[first : (k * SPAN + SPAN + 3) * p]))
    return out


def z_function(s: list[int]) -> list[int]:
    """For every place how long the rest agrees with the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _power(z: list[int], q: int) -> bool:
    """Whether the first ``q`` words repeat a shorter block: ``z`` is their Z-function and goes on."""
    d = 1
    while d * d <= q:
        if q % d == 0:
            for step in {d, q // d}:
                if step < q and z[step] >= q - step:
                    return True
        d += 1
    return False


def fragments(octave: int, tile: int, first: int, size: int, ids: list[int]) -> list[tuple[int, int, int]]:
    """(period, first, end) of agreement at the boundaries of one tile.

    Only agreement over ``P`` words or more to the right of a boundary counts; it is followed ``P`` words
    to the left and 2 P to the right, so that fragments of one stretch touch, and reach its ends. Those
    that touch within the tile are joined here; what ends within it and is too short for a run goes.
    """
    p, out = 1 << octave, []
    open_: dict[int, list] = {}  # period: first, end, whether the stretch really begins and ends there
    for m in range(tile * SPAN * p, min((tile + 1) * SPAN * p, size - 2 * p + 1), p):
        at = m - first
        right = z_function(ids[at : at + 4 * p])
        periods = [q for q in range(p, min(2 * p, len(right))) if right[q] >= p and not _power(right, q)]
        if not periods:
            continue
        # to the left: the words before m read backwards, then those before m + 2 P - 1
        back = ids[max(0, at - p) : at][::-1]
        ahead = ids[max(0, at - p) : at + 2 * p - 1][::-1]
        left = z_function([*back, -1, *ahead])
        for q in periods:
            before = left[len(ahead) + 1 - q]  # where the words before m + q stand
            a, b = m - before, m + min(right[q], 2 * p)
            held = open_.get(q)
            if held and a <= held[1]:
                held[1], held[3] = b, right[q] < 2 * p
            else:
                if held:
                    out.append((q, *held))
                open_[q] = [a, b, before < p, right[q] < 2 * p]
    out += [(q, *held) for q, held in open_.items()]
    return [(q, a, b) for q, a, b, begins, ends in out if not (begins and ends) or b - a + q >= max(WORDS, TIMES * q)]


def gaps_joined(found: DataFrame, by: list[str | Column]) -> DataFrame:
    """Touching and overlapping fragments ``[first, stop)`` of a group become one; groups are spread by ``by``."""
    over = Window.partitionBy(*by).orderBy("first", "stop")
    reach = F.max("stop").over(over.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("first") > reach).cast("int"), F.lit(1))
    return (
        found.distinct().withColumn("_opens", opens)
        .withColumn("_part", F.sum("_opens").over(over.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "_part").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).drop("_part")
    )


def _listed(found: list[list[tuple]]) -> pa.Array:
    """Tiles of several texts as one array of lists."""
    flat = [x for own in found for x in own]
    ends = np.cumsum([0, *map(len, found)])
    sizes = np.cumsum([0, *(len(x[4]) for x in flat)])
    words = np.concatenate([x[4] for x in flat]).astype(np.int32) if flat else np.zeros(0, np.int32)
    octave, tile = (pa.array([x[i] for x in flat], pa.int32()) for i in (0, 1))
    first, size = (pa.array([x[i] for x in flat], pa.int64()) for i in (2, 3))
    ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(words))
    rows = pa.StructArray.from_arrays([octave, tile, first, size, ids], names=["octave", "tile", "first", "size", "ids"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None,
        with_text: bool = True) -> DataFrame:
    """``doc_id, mark, tiles, words``: each text's tiles that may hold agreement, and its words joined by spaces.

    ``mark`` tells texts of one id apart. ``rewrite`` maps (words, id) to the words to be used, in the
    task. With ``with_text`` false, texts without tiles carry the digest of their words in ``done``
    instead of the words.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                held, kept, done = [], [], []
                for key, value in zip(part.column(0).to_pylist(), part.column(2)):
                    words = split(value.as_py())
                    if rewrite is not None:
                        words = rewrite(words, key)
                    held.append(tiles(numbered(words)))
                    text, whole = b" ".join(words), bool(with_text or held[-1])
                    kept.append(text.decode("utf-8", "surrogatepass") if whole else None)
                    done.append(None if whole else hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _listed(held), pa.array(kept, pa.string()), pa.array(done, pa.string())],
                    names=["doc_id", "mark", "tiles", "words", "done"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("t"))
    return source.mapInArrow(work, f"doc_id {kind}, mark bigint, tiles array<{TILE}>, words string, done string")


def solve(tiled: DataFrame) -> DataFrame:
    """``doc_id, mark, period, first, stop``: fragments of agreement, tile by tile.

    Tiles of one document, however long, are dealt out over all tasks.
    """
    kind = tiled.schema["doc_id"].dataType.simpleString()
    rows = tiled.select("doc_id", "mark", F.explode("tiles").alias("t")).select("doc_id", "mark", "t.*")
    parts = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by the tile's words: equal tiles go together, tiles of one document do not
    rows = rows.repartition(parts, "doc_id", "mark", "octave", "tile")

    def work(batches):
        for batch in batches:
            own, found = [], []
            for k in range(batch.num_rows):
                octave, tile, first, size, ids = (batch.column(c)[k].as_py() for c in range(2, 7))
                got = fragments(octave, tile, first, size, ids)
                own += [k] * len(got)
                found += got
            if found:
                q, a, b = (pa.array(x, pa.int64()) for x in zip(*found))
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), q, a, b],
                                                 names=["doc_id", "mark", "period", "first", "stop"])

    return rows.mapInArrow(work, f"doc_id {kind}, mark bigint, period bigint, first bigint, stop bigint")


def stitch(found: DataFrame) -> DataFrame:
    """``doc_id, mark, start, length, period``: runs, from fragments dealt out by document and period."""
    whole = gaps_joined(found, ["doc_id", "mark", "period"])
    length = F.col("stop") - F.col("first") + F.col("period")
    return whole.select("doc_id", "mark", F.col("first").alias("start"), length.alias("length"), "period").where(
        F.col("length") >= F.greatest(F.lit(WORDS), TIMES * F.col("period")))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, start, length, period``: all runs of all texts. Words are numbered from 0.

    A run is a stretch of words with smallest period ``q``, of at least six words and four periods, that no
    neighbouring word extends. A null or empty text has none; texts that share an id give the runs of each
    different text; a repeated row gives its runs once; other columns are not read.
    """
    held = cut(docs, id_col, text_col, rewrite, with_text=False)
    return stitch(solve(held)).drop("mark")


def _kept(words: list[str], found: list[dict]) -> list[str]:
    """Words that no run drops: all but what follows the first period of a run."""
    gone = np.zeros(len(words) + 1, np.int64)
    for r in found:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stays).tolist()]


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None,
             with_text: bool = True) -> DataFrame:
    """Per row: ``doc_id, runs, collapsed``, its runs by start and period, and its words without repetition.

    A word is dropped if a run contains it after that run's first period; the rest is joined by single
    spaces. With ``with_text`` false, ``collapsed_sha256`` stands for the text. A null or empty text has no
    runs and collapses to an empty one; repeated rows stay repeated; texts that share an id are judged apart;
    an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = stash(cut(docs, id_col, text_col, rewrite, with_text), "tiles")
    run = "struct<start: bigint, length: bigint, period: bigint>"
    per_doc = stitch(solve(held)).groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("r"))
    per_doc = per_doc.select("d", "m", F.transform("r", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))
    name = "collapsed" if with_text else "collapsed_sha256"

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for text, found in zip(part.column(1), part.column(2)):
                    kept = " ".join(_kept(text.as_py().split(" "), found.as_py()))
                    out.append(kept if with_text else hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.string())],
                                                 names=["doc_id", "runs", name])

    # only texts with tiles take part in the join; the others are done
    none = F.array().cast(f"array<{run}>")
    tiled = held.where(F.size("tiles") > 0).select("doc_id", "mark", "words")
    met = tiled.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    worked = met.select("doc_id", "words", F.coalesce("runs", none).alias("runs")).mapInArrow(
        work, f"doc_id {kind}, runs array<{run}>, {name} string")
    plain = held.where(F.size("tiles") == 0).select(
        "doc_id", none.alias("runs"), F.col("words" if with_text else "done").alias(name))
    return worked.unionByName(plain)


def summary(collapsed: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (ties: smallest start, then period) and digests of the result of ``collapse``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return collapsed.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.s")).alias("start"), F.col("_best.n").alias("length"), (-F.col("_best.p")).alias("period"),
        F.expr("1000 * _best.n div -_best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )
