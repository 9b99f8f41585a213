"""Pairs of texts whose shingle sets are similar enough, exactly: no pair of the threshold is lost.

Every set is put in one order, shingles that a sample shows to be common last. Two sets of Jaccard
similarity ``t`` share a shingle among the first ``n - ceil(t n) + 1`` of each (prefix filter), so
every wanted pair meets in the block of such a shingle. Three bounds drop pairs there, and never
a wanted one: the sizes, the places of the shingle, and the bit count of the exclusive-or of two parity
sketches, which is at most the number of shingles that the sets do not share. What is left
becomes a forest of candidates, linear in the rows. A block of more than ``LARGE`` rows goes by in order of
size, and each row meets those that are not too small for it: no block is ever united as a whole, since chains of such
blocks would make one group of most texts. Each connected group of candidates is then laid out in tiles by size,
and in every pair of tiles the sets themselves are compared. Links come out as a spanning forest
over links that were checked, so that a large group gives few rows and loses no connection.
"""

from __future__ import annotations

from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import apart, stash, unit_draw
from panelwright.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: Texts that show which shingles are common, and in how many of them. This only orders: no result depends on it.
SAMPLE, COMMON, MOST = 10_000, 3, 100_000
LARGE = 256  # rows of a block that are compared in pairs together with other blocks; a larger block is streamed by itself
STRIP = 1 << 20  # pairs of a large block that are tested at a time
#: Shingles of one tile, about. A group of more than SIDE tiles gets larger ones, up to WIDER times, as each tile is copied for its partners.
VOLUME, SIDE, WIDER = 1 << 15, 16, 8
SEED = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def shingle_set(raw: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles (a shorter text: its whole sequence).

    Words lie between ASCII white space, A-Z lower-cased.
    """
    words = raw.lower().split()
    take = min(size, len(words))
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    spots = max(1, len(words) - size + 1)
    out = np.full(spots, SEED + take, np.uint64)
    for k in range(take):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + each[k : k + spots])
    return np.unique(out)


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def needed(a, b, t: Fraction):
    """Shingles that sets of ``a`` and ``b`` must share."""
    return -(-t.numerator * (a + b) // (t.numerator + t.denominator))


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles per slot; slots grow with the set, a wider sketch folds to a narrower one."""
    width = max(1024, 1 << (len(own) // 2).bit_length())
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def prefix(own: np.ndarray, common: np.ndarray, heat: np.ndarray, t: Fraction) -> np.ndarray:
    """The first shingles of a set: rare ones by hash, then common ones by how common they are."""
    n = len(own) + 1 + -t.numerator * len(own) // t.denominator
    at = np.searchsorted(common, own)
    known = at < len(common)
    known[known] = common[at[known]] == own[known]
    rare = own[~known]
    if len(rare) >= n:
        return rare[:n]
    return np.concatenate([rare, own[known][np.argsort(heat[at[known]], kind="stable")]])[:n]


def common_shingles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that are common in a sample, with their numbers of texts."""
    share = SAMPLE / max(1, docs.count())
    drawn = docs.where(unit_draw(F.col(id_col), "jaccard") < share).select(F.col(text_col).alias("t"))

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [shingle_set(_raw(t), shingle) for t in batch.slice(at, 500).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    counts = drawn.mapInArrow(work, "s bigint").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "s").limit(MOST).collect()
    common = np.array([r.s for r in top], np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], np.array([r.n for r in top], np.int64)[order]


def summaries(docs: DataFrame, id_col: str, text_col: str, shingle: int, t: Fraction) -> DataFrame:
    """``doc_id, node, n, one, two, sketch, first``: a set's size, digests, sketch and first shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, id_col, text_col, shingle))

    def work(batches):
        common, heat = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # few texts at a time in Python's own memory
                part = batch.slice(at, 500)
                sizes, digests, sketches, firsts = [], [], [], []
                for text in part.column(2).to_pylist():
                    own = shingle_set(_raw(text), shingle)
                    digest = xxhash.xxh128_digest(own.tobytes())
                    sizes.append(len(own))
                    digests.append(np.frombuffer(digest, np.int64))
                    sketches.append(sketch(own).tobytes())
                    firsts.append(prefix(own, common, heat, t).view(np.int64))
                one, two = np.array(digests).T
                ends = np.append(0, np.cumsum(list(map(len, firsts))))
                first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(one.copy()), pa.array(two.copy()),
                     pa.array(sketches, pa.binary()), first],
                    names=["doc_id", "node", "n", "one", "two", "sketch", "first"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    # equal nodes of unequal rows only make a group of candidates larger
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("node"), F.col(text_col).alias("t")
    ).mapInArrow(work, f"doc_id {kind}, node bigint, n bigint, one bigint, two bigint, sketch binary, first array<bigint>")


def _blocks(batches):
    """Batches of rows sorted by ``token`` (column 0) cut so that blocks stay whole; very large ones come in pieces.

    Gives (batch, whether it is a piece of a large block).
    """
    held, large = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = held.column(0).to_numpy()
        if large is not None:
            end = int(np.searchsorted(token, large, "right"))
            if end:
                yield held.slice(0, end), True
                held, token = held.slice(end), token[end:]
            if not len(token):
                continue
            large = None
        last = int(np.searchsorted(token, token[-1]))
        if last:
            yield held.slice(0, last), False
            held = held.slice(last)
        if held.num_rows > LARGE:
            large = token[-1]
            yield held, True
            held = held.slice(held.num_rows)
    if held is not None and held.num_rows:
        yield held, large is not None and held.column(0)[0].as_py() == large


def _near(token: np.ndarray, pos: np.ndarray, n: np.ndarray, t: Fraction):
    """Rows i, j of one block that sizes and places allow to be similar; at growing distance."""
    ends = np.flatnonzero(np.append(token[1:] != token[:-1], True))
    left = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(len(token))  # rows after this one in its block
    i = np.arange(len(token))
    for step in range(1, int(left.max(initial=0)) + 1):
        i = i[left[i] >= step]
        j = i + step
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        may = (t.denominator * low >= t.numerator * high) & (
            np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j], t))
        if may.any():
            yield i[may], j[may]


def _met(t: Fraction):
    """Rows that may have a similar one in their block; of large blocks all rows."""

    def work(batches):
        for part, large in _blocks(batches):
            token, pos, n = (part.column(k).to_numpy() for k in range(3))
            keep = np.ones(len(token), bool) if large else _crowded(token, LARGE)
            small = np.flatnonzero(~keep)
            for i, j in _near(token[small], pos[small], n[small], t):
                keep[small[i]] = keep[small[j]] = True
            yield part.filter(pa.array(keep))

    return work


def _crowded(token: np.ndarray, most: int) -> np.ndarray:
    """Which rows are in blocks of more than ``most`` rows."""
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(first, len(token)))
    return np.repeat(sizes > most, sizes)


def _folded(raw: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(raw.reshape(-1, width), axis=0)


class _Sketches:
    """Sketches of a batch, folded once to every width that occurs."""

    def __init__(self, column: pa.Array):
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
        self.width = np.fromiter(map(len, raw), np.int64, len(raw))
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            wide = np.flatnonzero(self.width >= w)
            at = np.zeros(len(raw), np.int64)
            at[wide] = np.arange(len(wide))
            self.folded[w] = at, np.stack([_folded(raw[k], w) for k in wide]).view(np.uint64)

    def fit(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, t: Fraction):
        """Those of the pairs i, j that may be similar, some at a time."""
        least = np.minimum(self.width[i], self.width[j])
        for w in np.unique(least).tolist():
            at, bits = self.folded[w]
            x, y = i[least == w], j[least == w]
            step = max(1, (1 << 23) // w)
            for k in range(0, len(x), step):
                a, b = x[k : k + step], y[k : k + step]
                apart = np.bitwise_count(bits[at[a]] ^ bits[at[b]]).sum(axis=1, dtype=np.int64)
                near = apart <= n[a] + n[b] - 2 * needed(n[a], n[b], t)
                yield a[near], b[near]


def _streamed(held: pa.RecordBatch, old: int, t: Fraction, find, unite) -> None:
    """Rows of a large block, sorted by size: those after the first ``old`` meet all before them.

    Pairs that are joined already are not compared again.
    """
    pos, n, node = (held.column(k).to_numpy() for k in (1, 2, 3))
    sketches = _Sketches(held.column(4))
    root = np.fromiter(map(find, node.tolist()), np.int64, len(node))
    at = old
    while at < len(n):
        # sets before these are too small for all of the strip
        low = int(np.searchsorted(n, -(-t.numerator * n[at] // t.denominator)))
        j = np.arange(at, min(at + max(1, min(64, STRIP // (at + 1 - low))), len(n)))
        at = int(j[-1]) + 1
        i = np.arange(low, at)
        a, b = n[i][None, :], n[j][:, None]
        may = (i[None, :] < j[:, None]) & (t.denominator * a >= t.numerator * b) & (root[i][None, :] != root[j][:, None])
        may &= np.minimum((n - pos)[i][None, :], (n - pos)[j][:, None]) >= needed(a, b, t)
        y, x = np.nonzero(may)
        for x, y in sketches.fit(i[x], j[y], n, t):
            if not len(x):
                continue
            # of the rows of one group, one is enough for each new row
            _, one = np.unique(np.stack([root[x], y]), axis=1, return_index=True)
            for v, u in zip(x[one].tolist(), y[one].tolist()):
                if root[v] != root[u]:
                    r = unite(int(node[v]), int(node[u]))
                    root[(root == root[v]) | (root == root[u])] = r


def _forest(t: Fraction):
    """Links of candidates that the sketches allow too: a spanning forest of each task's."""

    def work(batches):
        up: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        held, last = None, None  # what rows to come of the large block may still meet, and its shingle

        def find(v: int) -> int:
            while (w := up.setdefault(v, v)) != v:
                up[v] = v = up[w]
            return v

        def unite(v: int, u: int) -> int:
            if (r := find(v)) != (s := find(u)):
                up[r] = s
                found.append((v, u))
            return s

        for part, large in _blocks(batches):
            if large:
                same = held is not None and last == part.column(0)[0].as_py()
                old = held.num_rows if same else 0
                held = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0] if same else part
                last = part.column(0)[0].as_py()
                _streamed(held, old, t, find, unite)
                n = held.column(2).to_numpy()
                held = held.slice(int(np.searchsorted(n, -(-t.numerator * n[-1] // t.denominator))))
            else:
                crowded = _crowded(part.column(0).to_numpy(), LARGE)
                small = part.filter(pa.array(~crowded))
                if small.num_rows:
                    token, pos, n, node = (small.column(k).to_numpy() for k in range(4))
                    sketches = _Sketches(small.column(4))
                    for i, j in _near(token, pos, n, t):
                        for a, b in sketches.fit(i, j, n, t):
                            for v, u in set(zip(node[a].tolist(), node[b].tolist())):
                                unite(v, u)
                rest = part.filter(pa.array(crowded))
                token = rest.column(0).to_numpy()
                first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else []
                for a, b in zip(first, np.append(first[1:], len(token)) if len(token) else []):
                    _streamed(rest.slice(int(a), int(b - a)), 0, t, find, unite)
            a, b = np.asarray(found, np.int64).reshape(-1, 2).T
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], names=["a", "b"])

    return work


def candidates(rows: DataFrame, t: Fraction, close: DataFrame | None = None) -> DataFrame:
    """``node, root`` of texts that may have a similar one: similar texts always have the same root.

    Texts of one group of ``close(doc_id, group)`` meet like those that share a first shingle.
    """
    spots = rows.select("node", "n", F.posexplode("first").alias("pos", "token")).select(
        "token", F.col("pos").cast("bigint").alias("pos"), "n", "node")
    met = stash(spots.repartition("token").sortWithinPartitions("token").mapInArrow(
        _met(t), "token bigint, pos bigint, n bigint, node bigint"), "met")
    if close is not None:
        met = met.unionByName(rows.select("doc_id", "node", "n").join(close.distinct(), "doc_id").select(
            F.xxhash64(F.lit("close"), "group").alias("token"), F.lit(0).cast("bigint").alias("pos"), "n", "node"))
    sketches = rows.select("node", "sketch").distinct()
    pairs = met.join(sketches, "node").select("token", "pos", "n", "node", "sketch")
    return components(pairs.repartition("token").sortWithinPartitions("token", "n").mapInArrow(_forest(t), "a bigint, b bigint"))


def tile_links(sets: list[np.ndarray], split: int, t: Fraction) -> list[tuple[int, int]]:
    """Spanning forest of the similar pairs of a tile (``split`` 0), or between its first ``split`` sets and the rest."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.append(0, np.cumsum(n)[:-1])
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), np.int64)
    label = np.arange(len(sets))
    out = []
    for i in range(split or len(sets)):
        others = np.arange(split or i + 1, len(sets))
        others = others[(label[others] != label[i]) & (t.denominator * np.minimum(n[others], n[i]) >= t.numerator * np.maximum(n[others], n[i]))]
        if not len(others):
            continue
        mine = place[starts[i] : starts[i] + n[i]]
        mark[mine] = 1
        if len(others) * 4 < len(sets):
            shared = np.fromiter((mark[place[starts[j] : starts[j] + n[j]]].sum() for j in others.tolist()), np.int64, len(others))
        else:
            shared = np.add.reduceat(mark[place], starts)[others]
        mark[mine] = 0
        for j in others[shared >= needed(n[others], n[i], t)].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _verify(t: Fraction):
    def work(batches):
        for batch in batches:
            found_a, found_b = [], []
            for k in range(batch.num_rows):
                own, other = batch.column(0)[k].values, batch.column(1)[k].values
                tiles = [own] if other is None else [own, other]
                ids = pa.concat_arrays([x.field("id") for x in tiles])
                sets = [s.values.to_numpy().view(np.uint64) for x in tiles for s in x.field("set")]
                found = tile_links(sets, 0 if other is None else len(own), t)
                if found:
                    a, b = zip(*found)
                    found_a.append(ids.take(pa.array(a)))
                    found_b.append(ids.take(pa.array(b)))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(found_a), pa.concat_arrays(found_b)], names=["a", "b"])

    return work


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS,
                  similarity: float = SIMILARITY, volume: int = VOLUME, close: DataFrame | None = None) -> DataFrame:
    """``a, b``: links that connect all ids whose shingle sets are similar enough, and no others.

    Rows without an id take no part. Texts of equal sets are linked to the one of the least id.
    ``close(doc_id, group)``: ids that another method holds for near; those of a group meet in any case.
    """
    t = Fraction(str(similarity))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stash(summaries(docs, id_col, text_col, shingle, t), "sets")
    roots = candidates(rows, t, close)
    found = stash(rows.select("doc_id", "node", "n", "one", "two").join(roots, "node").distinct(), "groups")
    classes = stash(found.groupBy("root", "one", "two", "n").agg(F.min("doc_id").alias("least")), "classes")
    same = found.join(classes, ["root", "one", "two", "n"]).where("doc_id <> least").select(
        F.col("least").alias("a"), F.col("doc_id").alias("b"))

    # tiles of about equal volume; sizes more than one band apart can't be similar
    band = F.floor(F.log(F.col("n")) / F.lit(1.1 * -log(float(t)))).alias("p")
    several = classes.groupBy("root").agg(F.count("*").alias("m")).where("m > 1").select("root")
    classes = classes.join(several, "root").select("root", band, "n", "one", "two", "least")
    tile = F.greatest(F.lit(volume), F.least(F.ceil(F.sum("n") / SIDE), F.lit(WIDER * volume)))
    spread = classes.groupBy("root", "p").agg(F.ceil(F.sum("n") / tile).alias("parts"))
    placed = stash(classes.join(spread, ["root", "p"]).select(
        "root", F.struct("p", F.pmod(F.xxhash64("one"), F.col("parts")).alias("part")).alias("name"), "one", "two", "least"), "placed")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(_raw(x), shingle).view(np.int64) for x in part.column(1).to_pylist()]
                one, two = np.array([np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64) for s in sets]).T
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(one.copy()), pa.array(two.copy()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["least", "one", "two", "set"])

    source = docs.select(F.col(id_col).alias("least"), F.col(text_col).alias("t"))
    some, _ = apart(source, "least", placed.select("least"))
    sets = some.join(placed.select("least").distinct(), "least", "left_semi").mapInArrow(
        cut, f"least {kind}, one bigint, two bigint, set array<bigint>")
    tiles = stash(
        placed.join(sets.dropDuplicates(["least", "one", "two"]), ["least", "one", "two"])
        .groupBy("root", "name").agg(F.collect_list(F.struct(F.col("least").alias("id"), "set")).alias("own")), "tiles")
    first, second = tiles.select("root", F.col("name").alias("na")), tiles.select("root", F.col("name").alias("nb"))
    near = first.join(second, "root").where("na <= nb").where(F.abs(F.col("na.p") - F.col("nb.p")) <= 1)
    near = (
        near.repartition("root", "na", "nb")
        .join(tiles.select("root", F.col("name").alias("na"), "own"), ["root", "na"])
        .join(tiles.select("root", F.col("name").alias("nb"), F.col("own").alias("other")), ["root", "nb"])
        .select("own", F.when(F.expr("na <> nb"), F.col("other")).alias("other"))
    )
    between = near.mapInArrow(_verify(t), f"a {kind}, b {kind}")
    return between.unionByName(same).distinct()
