"""SimHash fingerprints and exact near-duplicate links by tiled comparison.

Fingerprints that differ in at most ``radius`` of 64 bits agree exactly on two of ``radius + 2``
blocks, so every link lies inside a bucket of fingerprints with two equal blocks. A bucket is
laid out in tiles; tiles are compared as numpy matrices (exclusive-or, bit count), and two tiles
whose bit counts differ by more than the radius are never compared, since each differing bit
changes the count by one. Where a tile is full of links, only those of a spanning forest come
out, not all pairs: that loses no connection and stays linear in the rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import apart, fresh, stash
from panelwright.llm.components import components
from panelwright.llm.jaccard import SIMILARITY, WORDS, similar_links

SHINGLE, RADIUS = 4, 4
SEED = 42
#: Fingerprints of one tile (hash-dealt, so about that many); a larger bucket has many tiles.
TILE = 4096


def simhash(raw: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of an UTF-8 text: words between ASCII white space, A-Z lower-cased."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - shingle + 1)]
    ends = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) per row; texts without words get zero."""

    def work(batches):
        for batch in batches:
            fps = []
            for at in range(0, batch.num_rows, 500):  # few texts at a time in Python's own memory
                for t in batch.slice(at, 500).column(1).to_pylist():
                    fps.append(simhash(t.encode("utf-8", "surrogatepass") if t else b"", shingle))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.asarray(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        work, f"doc_id {kind}, fp bigint"
    )


def tile_links(
    own: np.ndarray, other: np.ndarray | None, radius: int, masks: list[int], first: tuple[int, int], dense: int
) -> list[tuple[int, int]]:
    """Links within a tile, or between two, that belong to the bucket of blocks ``first``.

    A link belongs to the first two blocks on which its ends agree, so that it is found in one
    bucket only. Fingerprints with up to ``dense`` links here give all of them; of those with
    more, the links that join what is not yet joined.
    """
    pool = own if other is None else np.concatenate([own, other])
    side = np.arange(len(pool)) >= len(own)
    bits = np.bitwise_count(pool)
    order = np.argsort(bits, kind="stable")
    pool, side, bits = pool[order], side[order], bits[order].astype(np.int64)
    label = np.arange(len(pool))
    out: list[tuple[int, int]] = []
    for at in range(0, len(pool), 256):
        rows = pool[at : at + 256]
        # bit counts further apart than the radius can't be within it
        a = np.searchsorted(bits, bits[at] - radius)
        b = np.searchsorted(bits, bits[min(at + 256, len(pool)) - 1] + radius, "right")
        x = rows[:, None] ^ pool[a:b]
        i, j = np.nonzero(np.bitwise_count(x) <= radius)
        keep = i + at != j + a
        if other is not None:
            keep &= side[i + at] != side[j + a]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        x = x[i, j]
        mine = np.ones(len(x), bool)
        for k, mask in enumerate(masks[: first[1] + 1]):
            same = (x & np.uint64(mask)) == 0
            mine &= same == (k in first)
        i, j = i[mine] + at, j[mine] + a
        degree = np.bincount(i, minlength=len(pool))
        sparse = degree[i] <= dense
        out.extend(zip(pool[i[sparse]].tolist(), pool[j[sparse]].tolist()))
        i, j = i[~sparse], j[~sparse]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for s, e in zip(starts, np.append(starts[1:], len(i)) if len(i) else []):
            me, near = i[s], j[s:e]
            roots, which = np.unique(label[near], return_index=True)
            for root, one in zip(roots, near[which]):
                if root != label[me]:
                    out.append((int(pool[me]), int(pool[one])))
                    label[label == root] = label[me]
    return out


def _has_link(flat: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Which of many small buckets, laid end to end, hold any link: compared at growing distance."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found = np.zeros(len(sizes), bool)
    for step in range(1, int(sizes.max(initial=0))):
        same = owner[step:] == owner[:-step]
        if not same.any():
            break
        near = same & (np.bitwise_count(flat[step:] ^ flat[:-step]) <= radius)
        found[owner[step:][near]] = True
    return found


SMALL = 64  # buckets up to this size are tested many at a time; a matter of vector length only


def _compare(radius: int, dense: int):
    masks = blocks(radius)
    chosen = list(combinations(range(len(masks)), 2))

    def work(batches):
        for batch in batches:
            left, right, kinds = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            flat = left.flatten().to_numpy().view(np.uint64)
            sizes = np.diff(left.offsets.to_numpy())
            ends = np.cumsum(sizes)
            alone = right.is_null().to_numpy(zero_copy_only=False)
            small = alone & (sizes <= SMALL)
            todo = ~small
            if small.any():
                todo[np.flatnonzero(small)[_has_link(flat[np.repeat(small, sizes)], sizes[small], radius)]] = True
            found: list[tuple[int, int]] = []
            for k in np.flatnonzero(todo).tolist():
                own = flat[ends[k] - sizes[k] : ends[k]]
                other = None if alone[k] else right[k].values.to_numpy().view(np.uint64)
                found.extend(tile_links(own, other, radius, masks, chosen[kinds[k]], dense))
            a, b = np.sort(np.asarray(found, np.uint64).reshape(-1, 2), axis=1).view(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return work


def blocks(radius: int) -> list[int]:
    """Masks of ``radius + 2`` blocks covering 64 bits."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, dense: int = 0) -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``radius``. ``distinct(fp)``: no repeats.

    With ``dense``, all links of fingerprints that have up to so many in a tile.
    """
    masks = [x | y for x, y in combinations(blocks(radius), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # few bytes become many keys: dealt out first, as so small a table is read by few tasks
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(parts, "fp").select(
        "fp", F.explode(F.array(*(
            F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)
        ))).alias("k"),
    ).select("fp", "k.c", "k.key")

    # buckets of more than one tile, and how their fingerprints spread over bit counts
    count = F.bit_count("fp").cast("int")
    large = stash(
        keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("c", "key"), "buckets"
    )
    one = (
        keyed.join(large, ["c", "key"], "left_anti")
        .groupBy("c", "key").agg(F.collect_list("fp").alias("own")).where(F.size("own") > 1)
        .select("own", F.lit(None).cast("array<bigint>").alias("other"), "c")
    )
    many = keyed.join(large, ["c", "key"], "left_semi").withColumn("p", count)
    spread = many.groupBy("c", "key", "p").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = (
        many.join(spread, ["c", "key", "p"])
        .groupBy("c", "key", "p", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
        .agg(F.collect_list("fp").alias("own"))
    )
    tiles = stash(tiles.withColumn("name", F.struct("p", "part")), "tiles")
    first = tiles.select("c", "key", F.col("name").alias("na"))
    second = tiles.select("c", "key", F.col("name").alias("nb"))
    near = first.join(second, ["c", "key"]).where("na <= nb").where(F.abs(F.col("na.p") - F.col("nb.p")) <= radius)
    near = (
        near.repartition("c", "key", "na", "nb")
        .join(tiles.select("c", "key", F.col("name").alias("na"), "own"), ["c", "key", "na"])
        .join(tiles.select("c", "key", F.col("name").alias("nb"), F.col("own").alias("other")), ["c", "key", "nb"])
        .select("own", F.when(F.expr("na <> nb"), F.col("other")).alias("other"), "c")
    )
    return one.unionByName(near).mapInArrow(_compare(radius, dense), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable. A null or empty text has fingerprint zero and links like any other;
    repeated rows share a component; null ids never become a component's id (unless alone, then
    it is null). An empty table gives an empty result; other columns are not read.
    """
    rows = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    known = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(known.select("fp"), radius))
    rooted = known.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(rooted.join(least, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# -- near duplicates by similarity -------------------------------------------------------


def close_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, group`` of texts whose fingerprints are connected by links within ``radius``; no others."""
    rows = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    known = stash(rows.groupBy("fp").agg(F.count("*").alias("m")), "distinct")
    roots = components(links(known.select("fp"), radius))
    groups = known.join(roots, F.col("fp") == F.col("node"), "left").where("m > 1 or root is not null")
    return stash(rows.join(groups.select("fp", F.coalesce("root", "fp").alias("group")), "fp").select("doc_id", "group"), "close")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS,
             similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id, with all its columns.

    Near duplicates are texts whose shingle sets are similar enough, and what such links connect.
    SimHash finds the close ones, whose links are confirmed on the sets; similar texts whose fingerprints are further
    apart are found by a prefix-filter join, so that none is lost.
    Rows without an id stay. Different texts under one id are judged apart; rows that repeat id and
    text are one document.
    """
    node, gone_name = fresh(docs, "_node", "_gone")
    own = F.struct(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).alias("text"))
    named = docs.where(F.col(id_col).isNotNull()).select(own.alias(node), F.col(text_col))
    roots = stash(components(similar_links(named, node, text_col, shingle, similarity, close=close_texts(named, node, text_col))), "roots")
    first = roots.groupBy("root").agg(F.min("node").alias("first"))
    gone = roots.join(first, "root").where("node <> first").select(F.col("node").alias(gone_name))
    # few rows go: their ids are looked for first, so that no text is digested or shuffled but theirs
    gone = stash(gone, "gone")
    maybe, rest = apart(docs, id_col, gone.select(f"{gone_name}.id"))
    return maybe.join(gone, (F.col(id_col) == F.col(f"{gone_name}.id")) & (own == F.col(gone_name)), "left_anti").unionByName(rest)
