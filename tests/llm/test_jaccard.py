"""Links of similar texts connect what brute force over all pairs connects."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import jaccard
from panelwright.llm.components import components
from panelwright.llm.simhash import keep_one


def by_definition(text: str | None) -> frozenset[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """The least id of each id's component, and all similar pairs."""
    sets = [(i, by_definition(t)) for i, t in rows]
    root, pairs = {i: i for i, _ in rows}, set()

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if both * 5 >= 4 * (len(a) + len(b) - both):
                    pairs |= {(i, j), (j, i)}
                    a_root, b_root = sorted((find(i), find(j)))
                    root[b_root] = a_root
    return {i: find(i) for i in root}, pairs


def assert_exact(spark, rows, **more):
    want, pairs = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similar_links(df, **more).persist()
    assert {(r.a, r.b) for r in found.collect()} <= pairs
    got: dict[int, set[int]] = {}
    for r in components(found).collect():
        got.setdefault(r.root, set()).add(r.node)
    expected: dict[int, set[int]] = {}
    for i, root in want.items():
        expected.setdefault(root, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in expected.values() if len(x) > 1)
    return df, want


def crowd(rng, texts: int, twins: int):
    """Texts of one template, about 0.74 similar; some have a twin that is 0.95 similar or more."""
    template = [f"t{rng.randrange(10_000)}" for _ in range(200)]
    rows = []
    for k in range(texts):
        own = list(template)
        for at in (20, 70, 120, 170):  # each new word changes five shingles; four of them and a tail
            own[at + rng.randrange(20)] = f"own{k}x{at}"
        own[-12:] = [f"tail{k}y{j}" for j in range(12)]
        rows.append((len(rows), " ".join(own)))
        if k < twins:
            own[-1] = "twin"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("large", [256, 8])  # blocks compared in pairs, or taken as one candidate group
def test_twins_in_a_crowd(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard, "LARGE", large)
    rows = crowd(random.Random(1), 240, 60)
    df, want = assert_exact(spark, rows, volume=4000)
    assert len(set(want.values())) == 240  # the crowd itself is below the threshold
    assert {r.doc_id for r in keep_one(df).collect()} == set(want.values())


def test_large_blocks_are_not_united(spark, monkeypatch):
    """Unlike texts of one length that share a passage stay apart as candidates; pairs among them are found."""
    monkeypatch.setattr(jaccard, "LARGE", 4)
    rng = random.Random(4)
    passage, rows = [f"p{k}" for k in range(30)], []
    for k in range(40):
        own = passage + [f"o{k}x{rng.randrange(10**6)}" for _ in range(40)]
        rows.append((len(rows), " ".join(own)))
        if k % 8 == 0:
            rows.append((len(rows), " ".join(own + ["more"])))
    t = Fraction("0.8")
    sets = jaccard.summaries(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, t).persist()
    # all are close by another method, too
    close = sets.select("doc_id", F.lit(1).alias("group"))
    groups: dict[int, set[int]] = {}
    for r in sets.select("doc_id", "node").join(jaccard.candidates(sets, t, close), "node").collect():
        groups.setdefault(r.root, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[i, i + 1] for i in range(0, 45, 9)]
    assert_exact(spark, rows)


@pytest.mark.parametrize("size", [7, 400, 5000])
def test_streamed_blocks_come_in_pieces(size):
    """A large block dealt over batches links what all pairs of it link; small blocks are around it."""
    rng, t = np.random.default_rng(5), Fraction("0.8")
    sets, rows = [], []
    for k in range(1200):
        if k < 100 or rng.random() < 0.6:
            own = rng.integers(0, 1 << 60, rng.integers(5, 3000) if k % 9 == 0 else rng.integers(20, 90)).astype(np.uint64)
        else:  # a copy with some other shingles, that may be too many
            own = sets[rng.integers(0, k)].copy()
            own[rng.random(len(own)) < rng.choice([0.02, 0.11, 0.2])] = k
        sets.append(np.unique(own))
        rows.append((7 if k < 1000 else 8 + k // 4, 0, len(sets[-1]), k, jaccard.sketch(sets[-1]).tobytes()))
    rows.sort(key=lambda r: (r[0], r[2]))
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])]
    whole = pa.RecordBatch.from_arrays(columns, names=["token", "pos", "n", "node", "sketch"])
    found = [(a, b) for out in jaccard._forest(t)(whole.slice(k, size) for k in range(0, len(rows), size))
             for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    up = list(range(1200))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in found:
        assert find(a) != find(b)  # a forest
        up[find(a)] = find(b)
    block, similar = {r[3]: r[0] for r in rows}, 0
    for i in range(1200):
        for j in range(i):
            small, big = sorted((len(sets[i]), len(sets[j])))
            if block[i] == block[j] and small * 5 >= 4 * big:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * 5 >= 4 * (small + big - both):
                    similar += 1
                    assert find(i) == find(j)
    assert similar > 100 and len({find(v) for v in range(1200)}) > 600  # unlike ones are not united


def test_twins_of_one_fingerprint(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        own = [f"w{rng.randrange(100_000)}" for _ in range(60)]
        for last in ("one", "two"):
            rows.append((len(rows), "the same five words again " * 100 + " ".join([*own, last])))
    df, want = assert_exact(spark, rows)
    assert len(set(want.values())) == 40
    assert {r.doc_id for r in keep_one(df).collect()} == set(want.values())


def test_pairs_around_the_threshold(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, " \t"), (10**6 + 2, "one Two"), (10**6 + 3, "ONE two\n"), (10**6 + 4, "one two three four five")]
    for k in range(150):
        base = [f"v{rng.randrange(50_000)}" for _ in range(rng.choice([12, 60, 200, 3000]))]
        rows.append((2 * 10**6 + 2 * k, " ".join(base)))
        for at in rng.sample(range(len(base)), max(1, int(len(base) * rng.uniform(0.005, 0.035)))):
            base[at] = f"x{k}y{at}"
        rows.append((2 * 10**6 + 2 * k + 1, " ".join(base)))
    assert_exact(spark, rows, volume=3000)


def test_texts_under_one_id_are_judged_apart(spark):
    """Clashing, null and repeated ids against brute force over rows."""
    rng = random.Random(21)
    texts = {k: " ".join(f"{k}{rng.randrange(900)}" for _ in range(80)) for k in "abcdef"}
    near = {k: t + " more" for k, t in texts.items()}
    rows = [(1, texts["a"]), (1, texts["b"]), (0, near["b"]), (5, texts["c"]), (5, texts["c"]), (6, near["c"]),
            (7, texts["d"]), (7, near["d"]), (None, texts["e"]), (None, texts["e"]), (9, near["e"]), (9, texts["f"]), (2, None), (2, ""), (2, texts["f"])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _node int")
    kept = sorted(r[2] for r in keep_one(df).collect())
    # of b the text of id 0 stays; c: both rows of id 5; d: one text of id 7; e: rows without id stay; f: the text of id 2
    one_d = {6, 7} & set(kept)
    assert len(one_d) == 1 and set(kept) - one_d == {0, 2, 3, 4, 8, 9, 10, 12, 13, 14}
