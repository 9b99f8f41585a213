"""Components of near duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from panelwright.llm import minhash
from panelwright.llm.minhash import alike, least_shared, near_duplicates, shingles


def by_definition(text: str | None, size: int = 4) -> frozenset[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows):
    """(n_shingles, component) of each row, rows told apart by place."""
    sets = [by_definition(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, list] = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(len(s), smallest[find(i)]) for i, s in enumerate(sets)]


def assert_exact(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, **more).collect()]
    want = [(r[0], *b, r[0] == b[1]) for r, b in zip(rows, brute(rows))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def varied(rng, base, changes):
    text = list(base)
    for _ in range(changes):
        text[rng.randrange(len(text))] = f"c{rng.randrange(10**6)}"
    return " ".join(text)


def corpus(rng, groups, alone):
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(groups):
        base = make(rng.choice([4, 9, 30, 120, 500]))
        texts += [varied(rng, base, rng.choice([0, 1, len(base) // 40, len(base) // 18])) for _ in range(rng.randrange(2, 6))]
    return texts + [" ".join(make(rng.randrange(1, 200))) for _ in range(alone)]


def test_groups_and_edge_cases(spark):
    rng = random.Random(1)
    texts = [None, "", " \t ", "One", "one", "a b c", "A B C", "a b c d", "x " * 30_000, "x " * 20_000, *corpus(rng, 40, 80)]
    rows = [(i + 7, t, 0) for i, t in enumerate(texts)]
    rows += [(None, "a b c", 0), (None, "only here", 0), (None, None, 0), (9, "a b c", 0), (9, "other words of this id", 0)]
    rng.shuffle(rows)
    assert_exact(spark, rows)


@pytest.mark.parametrize("large, volume", [(3, 400), (8, 3000)])
def test_hot_passages_and_crowds(spark, large, volume):
    """Crowds of near copies, and a passage that most texts share, over lists that count as hot."""
    rng = random.Random(large)
    passage = [f"p{i}" for i in range(60)]
    base = [f"b{rng.randrange(400)}" for _ in range(150)]
    texts = [varied(rng, base, 2) for _ in range(60)]
    twin = [varied(rng, base, 25) for _ in range(20)]  # mostly below the threshold to each other
    texts += twin + [varied(rng, t.split(), 1) for t in twin]
    for _ in range(60):
        own = [f"o{rng.randrange(5000)}" for _ in range(rng.choice([3, 10, 40, 300]))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += texts[5:25] + corpus(rng, 10, 20)
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert_exact(spark, rows, large=large, volume=volume)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_union_sketch_never_drops_similar_pairs():
    rng = np.random.default_rng(3)
    t, k = Fraction("0.8"), 64
    least = least_shared(t, k)
    assert 20 < least[64] < 40 and (np.diff(least) >= 0).all()
    for n in (3, 20, 64, 70, 300, 5000):
        for _ in range(60):
            union = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) << np.uint64(1))
            order = rng.permutation(len(union))
            apart = len(union) // 5  # similarity of 0.8 at least
            one = np.delete(union, order[: apart // 2])
            two = np.delete(union, order[apart // 2 : apart])
            x, y = minhash._tops(one, k)[None], minhash._tops(two, k)[None]
            assert alike(x, y, np.array([len(one)]), np.array([len(two)]), t, least)[0]
    far = [shingles(" ".join(f"{s}{i}" for i in range(300))) for s in "ab"]
    x, y = (minhash._tops(s, k)[None] for s in far)
    assert not alike(x, y, np.array([297]), np.array([297]), t, least)[0]
