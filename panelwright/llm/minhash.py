"""Near duplicates by bottom-k sketches: one hash function, inverted lists, exact Jaccard at the end.

The sketch of a shingle set are its ``K`` least hashes. The least ``K`` hashes of the union of two sets are among
their sketches, and each of them lies in both sets with the chance of their Jaccard similarity, so the
*union sketch* estimates it; sets of up to ``K`` shingles are their own sketches, and the estimate is exact.

* **Classes.** Texts of equal sets are one class, whatever their number.
* **Lists.** Every one of a sketch's least ``LISTED`` hashes has the list of classes that retain it. Similar sets
  of up to 155 shingles always share one of these, larger ones but for a chance below ``MISS``. Classes meet in a
  list of up to ``LARGE`` pairwise, at growing distance, those that are connected already left out; the union sketch
  drops a pair only if a pair of the wanted similarity would look so with a chance below ``MISS``.
* **Hot lists.** A passage of many texts fills lists beyond ``LARGE``. Similar classes that meet in no other list
  share at least a fifth of their listed hashes, all of them hot (the same bound), so only such classes stay
  in hot lists, with the few least of their hot hashes. A list that then still is large is one group of candidates.
* **Verification.** Connected candidates are laid out in tiles by size. In tiles, and in pairs of tiles, the union
  sketch is tried again and the whole sets are compared. In a group of many tiles each is first compared within
  itself and with a few heads of its size; what this connects is laid out together and then compared with the
  rest of the group only.

Links come out as a spanning forest over checked links.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stash
from panelwright.llm.components import components
from panelwright.llm.jaccard import needed, shingle_set

SHINGLE, SIMILARITY = 4, 0.8
#: Hashes retained of a set, and those of them that have lists.
K, LISTED = 64, 32
#: Chance that the union sketch drops a pair of exactly the wanted similarity.
MISS = 1e-12
LARGE = 256
#: Shingles of one tile, about; tiles of a group beyond which tiles are first compared with heads only; heads.
VOLUME, MANY, HEADS = 1 << 15, 4, 2
#: Bitmaps that tell scans which texts are wanted: bits of one, and how many (4 MB in all).
BITS, BITMAPS = 32768, 1024
ROWS = 500


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; none without a word."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return shingle_set(raw, size) if raw.strip() else np.zeros(0, np.uint64)


def least_shared(similarity: Fraction, k: int = K, miss: float = MISS) -> np.ndarray:
    """Hashes of a union sketch of ``m`` (0 to k) that must lie in both sets, for sketches that are cut off at k.

    Fewer come up at the wanted similarity with a chance below ``miss``. A union sketch is as
    hypergeometric as drawing without return, whose tail the binomial one bounds.
    """
    t = float(similarity)
    out = []
    for m in range(k + 1):
        tail, x = 0.0, 0
        while x <= m and (tail := tail + comb(m, x) * t**x * (1 - t) ** (m - x)) < miss:
            x += 1
        out.append(x)
    return np.array(out, np.int64)


def _tops(own: np.ndarray, k: int) -> np.ndarray:
    """Upper halves of a sketch, filled up: order and, but for rare chance, equality stay."""
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    out[: min(k, len(own))] = np.minimum(own[:k] >> np.uint64(32), np.uint64(0xFFFFFFFE))
    return out


def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, t: Fraction, least: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (rows of upper halves) of sets of ``n`` and ``m`` may be similar enough."""
    k = x.shape[1]
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    filled = both != 0xFFFFFFFF
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & filled[:, 1:]
    rank = np.cumsum(filled & ~again, axis=1)
    shared = (again & (rank <= k)).sum(axis=1)
    size = np.minimum(rank[:, -1], k)
    whole = (n <= k) & (m <= k)  # both sketches are the sets: the union is known, but for halves that met
    return np.where(whole, (again.sum(axis=1) >= needed(n, m, t)), shared >= least[size])


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, k: int) -> DataFrame:
    """``doc_id, mark, n, digest, low``: a set's size, 16 bytes that stand for it, and its sketch."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingles(v.as_py(), size) for v in part.column(2)]
                lows = [s[:k].view(np.int64) for s in sets]
                ends = np.append(0, np.cumsum(list(map(len, lows))))
                low = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lows)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), low],
                    names=["doc_id", "mark", "n", "digest", "low"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("t"))
    return source.mapInArrow(work, f"doc_id {kind}, mark bigint, n bigint, digest binary, low array<bigint>")


def _lists(batches):
    """Batches of rows sorted by the first column, cut so that no list is in two."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        last = int(np.searchsorted(held.column(0).to_numpy(), held.column(0)[-1].as_py()))
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None:
        yield held


def _after(value: np.ndarray) -> np.ndarray:
    """How many rows of its list come after each row."""
    ends = np.flatnonzero(np.append(value[1:] != value[:-1], True))
    return np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(len(value))


def _sized(n: np.ndarray, m: np.ndarray, t: Fraction) -> np.ndarray:
    return t.denominator * np.minimum(n, m) >= t.numerator * np.maximum(n, m)


def _met(t: Fraction):
    """Rows with another one in their list whose size allows similarity. Rows are sorted by list and size."""

    def work(batches):
        for part in _lists(batches):
            value, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            next_ = np.append((value[1:] == value[:-1]) & _sized(n[1:], n[:-1], t), False)
            yield part.filter(pa.array(next_ | np.append(False, next_[:-1])))

    return work


class _Forest:
    """Connected numbers, by path halving."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, v: int) -> int:
        up = self.up
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    def join(self, v: int, w: int) -> bool:
        v, w = self.find(v), self.find(w)
        self.up[max(v, w)] = min(v, w)
        return v != w

    def labels(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), np.int64, len(self.up))


def _candidates(t: Fraction, k: int):
    """Pairs that may be similar enough: a spanning forest of each batch of lists."""
    least = least_shared(t, k)

    def work(batches):
        for part in _lists(batches):
            value, n, node = (part.column(c).to_numpy() for c in range(3))
            name, place = np.unique(node, return_inverse=True)
            sizes = np.diff(part.column(3).offsets.to_numpy())
            tops = np.full((len(value), k), 0xFFFFFFFF, np.uint32)
            tops[np.arange(k) < sizes[:, None]] = np.minimum(part.column(3).flatten().to_numpy().view(np.uint32), 0xFFFFFFFE)
            left, forest, label = _after(value), _Forest(len(name)), np.arange(len(name))
            i, found = np.arange(len(value)), []
            for step in range(1, int(left.max(initial=0)) + 1):
                i = i[left[i] >= step]
                i = i[_sized(n[i], n[i + step], t)]  # sizes grow within a list
                new = False
                for at in range(0, len(i), 4096):
                    a = i[at : at + 4096]
                    a = a[label[place[a]] != label[place[a + step]]]
                    b = a + step
                    fit = alike(tops[a], tops[b], n[a], n[b], t, least) if len(a) else np.zeros(0, bool)
                    for v, w in zip(place[a[fit]].tolist(), place[b[fit]].tolist()):
                        if forest.join(v, w):
                            found.append((v, w))
                            new = True
                if new:
                    label = forest.labels()
            a, b = np.asarray(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])

    return work


def candidates(classes: DataFrame, t: Fraction, k: int, large: int = LARGE, listed: int = LISTED) -> DataFrame:
    """``node, root`` of classes that may have a similar one: similar classes have the same root."""
    # how many of its listed hashes a class shares with a similar one, and how many suffice to share one
    enter = int(least_shared(t, listed)[listed])
    enough = next(h for h in range(1, listed + 1) if h == listed or (1 - float(t)) ** h <= MISS)
    spots = classes.select("node", "n", F.explode(F.slice("low", 1, listed)).alias("value"))
    # every eighth class shows which lists are about that large: what is called hot changes the way, not the result
    part = max(1, min(8, large // 32))
    shown = spots.where(F.pmod(F.xxhash64("node"), F.lit(part)) == 0)
    hot = shown.groupBy("value").agg(F.count("*").alias("m")).where(F.col("m") * part > large)
    hot = stash(hot.select("value", F.lit(True).alias("hot")), "hot")
    # marked once and kept: every spot is one row of this join, whether its list is hot or not
    told = stash(spots.join(hot, "value", "left"), "told")
    cold = told.where("hot is null").select("value", "n", "node")
    # classes that are hot enough to meet in hot lists alone
    marked = told.where("hot").groupBy("node", "n").agg(F.sort_array(F.collect_list("value")).alias("values"))
    marked = marked.where(F.size("values") * listed >= enter * F.least("n", F.lit(listed)))
    entered = stash(marked.select("node", "n", F.explode(F.slice("values", 1, enough)).alias("value")), "entered")
    dense = entered.groupBy("value").agg(F.count("*").alias("m")).where(F.col("m") > large)
    dense = stash(dense.select("value", F.lit(True).alias("dense")), "dense")
    entered = entered.join(dense, "value", "left")
    lists = cold.unionByName(entered.where("dense is null").select("value", "n", "node"))
    met = stash(lists.repartition("value").sortWithinPartitions("value", "n").mapInArrow(
        _met(t), "value bigint, n bigint, node bigint"), "met")
    tops = classes.select("node", F.expr("transform(low, x -> int(shiftright(x, 32)))").alias("tops")).dropDuplicates(["node"])
    pairs = met.join(tops, "node").select("value", "n", "node", "tops")
    pairs = pairs.repartition("value").sortWithinPartitions("value", "n").mapInArrow(_candidates(t, k), "a bigint, b bigint")
    whole = entered.where("dense").select(F.col("node").alias("a"), F.xxhash64(F.lit("list"), "value").alias("b"))
    return components(pairs.unionByName(whole))


def tile_links(sets: list[np.ndarray], label: np.ndarray, split: int, t: Fraction, k: int, least: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of similar pairs of a tile (``split`` 0), or between its first ``split`` sets and the rest.

    Sets of one ``label`` are known to be connected.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    tops = np.stack([_tops(s, k) for s in sets])
    label, out = np.unique(label, return_inverse=True)[1].copy(), []
    for i in range(split or len(sets)):
        others = np.arange(split or i + 1, len(sets))
        others = others[(label[others] != label[i]) & _sized(n[others], n[i], t)]
        if not len(others):
            continue
        fit = alike(np.broadcast_to(tops[i], (len(others), k)), tops[others], np.full(len(others), n[i]), n[others], t, least)
        for j in others[fit].tolist():
            if label[j] != label[i]:
                at = np.searchsorted(sets[i], sets[j])
                shared = int((sets[i][np.minimum(at, n[i] - 1)] == sets[j]).sum())
                if shared >= needed(n[i], n[j], t):
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _verify(t: Fraction, k: int):
    """Checked links of rows of one tile, or of two tiles against each other."""
    least = least_shared(t, k)

    def work(batches):
        for batch in batches:
            found_a, found_b = [], []
            for r in range(batch.num_rows):
                tiles = [c[r].values for c in batch.columns]
                digest = pa.concat_arrays([x.field("digest") for x in tiles])
                label = np.concatenate([x.field("label").to_numpy() for x in tiles])
                sets = [s.values.to_numpy().view(np.uint64) for x in tiles for s in x.field("set")]
                found = tile_links(sets, label, len(tiles[0]) if len(tiles) > 1 else 0, t, k, least)
                if found:
                    a, b = zip(*found)
                    found_a.append(digest.take(pa.array(a)))
                    found_b.append(digest.take(pa.array(b)))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(found_a), pa.concat_arrays(found_b)], names=["a", "b"])

    return work


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among ``wanted(key)``: all that are, and few others while the bitmaps are not full."""
    bitmaps = wanted.select(F.pmod(F.xxhash64(key), F.lit(BITS * BITMAPS)).alias("_slot")).select(
        F.expr(f"_slot div {BITS}").alias("_bucket"), (F.col("_slot") % BITS).alias("_bit")
    ).groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))
    slot = F.pmod(F.xxhash64(key), F.lit(BITS * BITMAPS))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.expr(f"int(_slot % {BITS} div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("_slot", slot).withColumn("_bucket", F.expr(f"_slot div {BITS}")).join(F.broadcast(bitmaps), "_bucket")
    return told.withColumn("_byte", byte).where("shiftright(_byte, int(_slot % 8)) & 1 = 1").select(*rows.columns)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``digest, set`` of classes, from the texts of their carriers ``wanted(carrier)``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("t"))
    few = sieve(source, "mark", wanted.select("carrier.mark")).select(F.struct("doc_id", "mark").alias("carrier"), "t")
    one = wanted.select(F.col("carrier").alias("c")).distinct()
    # repeated rows have one carrier: texts are told apart before their sets are made
    few = few.join(one, F.col("carrier").eqNullSafe(F.col("c")), "left_semi").dropDuplicates(["carrier"]).select("t")

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sets = [shingles(v.as_py(), size) for v in batch.slice(at, ROWS).column(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "set"])

    return few.mapInArrow(work, "digest binary, set array<bigint>")


def _placed(members: DataFrame, kind: Column, t: Fraction, volume: int) -> DataFrame:
    """``root, name, digest, label``: tiles of about equal volume. A name is (size band, ``kind``, part)."""
    band = F.floor(F.log("n") / F.lit(1.1 * -log(float(t))))
    rows = members.withColumns({"p": band, "k": kind})
    spread = rows.groupBy("root", "p", "k").agg(F.ceil(F.sum("n") / volume).alias("parts"))
    part = F.pmod(F.xxhash64("digest"), F.col("parts"))
    return stash(rows.join(spread, ["root", "p", "k"]).select(
        "root", F.struct("p", "k", part.alias("part")).alias("name"), "digest", "label"), "placed")


def _filled(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """``root, name, own``: the contents of tiles."""
    return placed.join(sets, "digest").groupBy("root", "name").agg(F.collect_list(F.struct("digest", "label", "set")).alias("own"))


def _across(placed: DataFrame, sets: DataFrame, near: DataFrame, check) -> DataFrame:
    """Links between the pairs of tiles ``near(root, na, nb)``; other tiles are not filled."""
    near = stash(near, "near")
    named = near.select("root", F.explode(F.array("na", "nb")).alias("name")).distinct()
    tiles = stash(_filled(placed.join(named, ["root", "name"], "left_semi"), sets), "tiles")
    pairs = (
        near.join(tiles.select("root", F.col("name").alias("na"), "own"), ["root", "na"])
        .join(tiles.select("root", F.col("name").alias("nb"), F.col("own").alias("other")), ["root", "nb"])
    )
    return pairs.select("own", "other").mapInArrow(check, "a binary, b binary")


def checked_links(docs: DataFrame, classes: DataFrame, roots: DataFrame, id_col: str, text_col: str, size: int,
                  t: Fraction, k: int, volume: int = VOLUME, many: int = MANY) -> DataFrame:
    """``a, b``: digests of similar classes of equal root, checked on their whole sets; connects all such classes."""
    members = classes.join(roots, "node").select("root", "n", "digest", "carrier", F.xxhash64("digest").alias("label"))
    several = members.groupBy("root").agg(F.count("*").alias("m")).where("m > 1").select("root")
    members = stash(members.join(several, "root"), "members")
    sets = stash(full_sets(docs, members, id_col, text_col, size), "sets")
    mixed, check = F.lit(0).cast("bigint"), _verify(t, k)
    placed = _placed(members, mixed, t, volume)
    names = placed.select("root", "name").distinct()
    wide = stash(names.groupBy("root").agg(F.count("*").alias("m")).where(F.col("m") > many).select("root"), "wide")

    # every tile within itself, those of wide groups together with the heads of their size
    broad = placed.join(wide, "root", "left_semi")
    least = F.array_sort(F.collect_set(F.struct(F.xxhash64("digest").alias("h"), "digest", "label")))
    heads = broad.where("name.part = 0").groupBy("root", "name.p").agg(F.slice(least, 1, HEADS).alias("heads"))
    shown = broad.select("root", "name", F.col("name.p").alias("p")).distinct().join(heads, ["root", "p"])
    shown = shown.select("root", "name", F.explode("heads").alias("h")).select("root", "name", "h.digest", "h.label")
    inner = _filled(placed.unionByName(shown.where("name.part > 0")), sets).select("own").mapInArrow(check, "a binary, b binary")
    small = names.join(wide, "root", "left_anti").withColumnRenamed("name", "na")
    pairs = small.join(small.withColumnRenamed("na", "nb"), "root").where("na < nb and nb.p - na.p <= 1")
    links = stash(inner.unionByName(_across(placed, sets, pairs, check)), "checked")

    # wide groups: what is connected by now lies together, the rest is compared across
    left = members.join(wide, "root", "left_semi").drop("label")
    joined = components(links).select(F.col("node").alias("digest"), F.xxhash64(F.lit("joined"), "root").alias("label"))
    left = left.join(joined, "digest", "left").withColumn("label", F.coalesce("label", F.xxhash64("digest")))
    heavy = left.groupBy("root", "label").agg(F.sum("n").alias("v")).where(F.col("v") * 2 > volume).select("root", "label", F.lit(True).alias("heavy"))
    left = left.join(heavy, ["root", "label"], "left")
    placed = _placed(left, F.when(F.col("heavy"), F.col("label")).otherwise(mixed), t, volume)
    names = placed.select("root", F.col("name").alias("na")).distinct()
    pairs = names.join(names.withColumnRenamed("na", "nb"), "root").where(
        "na < nb and abs(nb.p - na.p) <= 1 and (na.k = 0 or na.k <> nb.k)")
    again = _filled(placed.where("name.k = 0"), sets).select("own").mapInArrow(check, "a binary, b binary")
    return links.unionByName(again).unionByName(_across(placed, sets, pairs, check))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    similarity: float = SIMILARITY, k: int = K, large: int = LARGE, volume: int = VOLUME) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row.

    Texts whose sets of distinct word shingles are similar enough are linked; ``component_id`` is the smallest
    id reachable, and its row is kept. A text of fewer words is one shingle; one without words, or null, has
    none and is linked with nothing. Repeated rows share a component; of texts that share an id each is judged
    by itself. A null id is the smallest only among null ids. An empty table gives an empty result; other
    columns are not read.
    """
    t = Fraction(str(similarity))
    rows = stash(sketches(docs, id_col, text_col, size, k), "sketches")
    classes = rows.where("n > 0").groupBy("digest", "n").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("carrier"),
        F.first("low").alias("low"), F.count("*").alias("copies"))
    classes = stash(classes.withColumn("node", F.xxhash64("digest")), "classes")
    roots = stash(candidates(classes, t, k, large), "roots")
    links = checked_links(docs, classes, roots, id_col, text_col, size, t, k, volume)
    linked = components(links).select(F.col("node").alias("digest"), "root")
    # only classes of several rows or with links take part in the last join
    grouped = classes.join(linked, "digest", "left").where("copies > 1 or root is not null").select(
        "digest", "least", F.coalesce("root", "digest").alias("root"))
    first = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(grouped.join(first, "root").select("digest", "component_id"), "named")
    own = F.when(F.col("n") > 0, F.col("component_id"))
    return rows.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce(own, "doc_id")).alias("kept"))
