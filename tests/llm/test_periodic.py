"""Runs and collapsed texts against a search by definition."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm.periodic import collapse, find_runs, fragments, numbered, summary, tiles, z_function
from panelwright.llm.queries import op13_periodic, repeated_tail


def by_definition(words) -> list[tuple[int, int, int]]:
    """All runs, by start and period: maximal stretches of each period, kept if no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            smaller = any(all(words[j] == words[j + d] for j in range(a, a + length - d)) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_by_definition(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


def solved(words) -> list[tuple[int, int, int]]:
    """The same by tiles and fragments, stitched here."""
    by_period: dict[int, list[tuple[int, int]]] = {}
    for octave, tile, first, size, ids in tiles(numbered(words)):
        for q, a, b in fragments(octave, tile, first, size, ids.tolist()):
            by_period.setdefault(q, []).append((a, b))
    out = []
    for q, found in by_period.items():
        whole: list[list[int]] = []
        for a, b in sorted(found):
            if whole and a <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], b)
            else:
                whole.append([a, b])
        out += [(a, b - a + q, q) for a, b in whole if b - a + q >= max(6, 4 * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab", max_size=70), st.text(alphabet="abc", max_size=12), st.integers(0, 9), st.text(alphabet="abc", max_size=40))
def test_any_words(head, block, times, tail):
    words = [c.encode() for c in head + block * times + tail]
    assert solved(words) == by_definition(words)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=60))
def test_z_function(s):
    z = z_function([ord(c) for c in s])
    for i in range(len(s)):
        k = 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        assert z[i] == k


def planted(rng, n):
    words = [f"w{rng.randrange(n)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        p, times = rng.randrange(1, max(2, n // 6)), rng.choice([3, 4, 5, 9])
        at = rng.randrange(n)
        words[at:at] = [f"b{rng.randrange(max(1, p // 2))}" for _ in range(p)] * times + [f"b{rng.randrange(9)}" for _ in range(rng.randrange(3))]
    return words


def test_long_periods_and_long_texts():
    rng = random.Random(2)
    for n in (30, 100, 300, 700):
        for _ in range(12):
            words = [w.encode() for w in planted(rng, n)]
            assert solved(words) == by_definition(words)
    block = [str(i).encode() for i in range(5000)]
    words = [b"x", *block, *block, *block, *block, *block[:7], b"y"]
    assert solved(words) == [(1, 20_007, 5000)]
    assert solved([b"a"] * 30_000) == [(0, 30_000, 1)]
    assert solved([b"a", b"b"] * 9999 + [b"a"]) == [(0, 19_999, 2)]


def test_table_against_definition(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a\x0bb\x0ca\rb a b a b", "x y " * 9, "la " * 3000]
    texts += [" ".join(planted(rng, rng.randrange(5, 120))) for _ in range(80)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 2), (5, texts[7], 2), (None, texts[7], 2), (None, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, period int")

    def by_hand(t):
        words = (t or "").encode().split()
        found = by_definition(words)
        return found, b" ".join(kept_by_definition(words, found)).decode()

    want = sorted(repr((i, *by_hand(t))) for i, t, _ in rows)
    got = collapse(df).collect()
    assert sorted(repr((r.doc_id, [(x.start, x.length, x.period) for x in r.runs], r.collapsed)) for r in got) == want
    listed = {(i, *r) for i, t, _ in rows for r in by_hand(t)[0]}
    assert {(r.doc_id, r.start, r.length, r.period) for r in find_runs(df).collect()} == listed
    short = {(r.doc_id, r.collapsed_sha256) for r in collapse(df, with_text=False).collect()}
    assert short == {(i, hashlib.sha256(by_hand(t)[1].encode()).hexdigest()) for i, t, _ in rows}
    assert collapse(df.limit(0)).collect() == [] == summary(collapse(df.limit(0), with_text=False)).collect()


def test_query_on_whole_table(spark):
    """The registered query against a search by vectors over the words of every document."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in op13_periodic(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = repeated_tail((d.text or "").encode().split(), d.doc_id)
        ids, found = numbered(words), []
        for q in range(1, len(ids) // 4 + 1):
            same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]])
            edges = np.flatnonzero(np.diff(same))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a + q >= max(6, 4 * q) and not any(q % x == 0 and (ids[a : b + q - x] == ids[a + x : b + q]).all() for x in range(1, q)):
                    found.append((a, b - a + q, q))
        found.sort(key=lambda r: (r[0], r[2]))
        some += bool(found)
        r = got[d.doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None, None, None))), d.doc_id
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept_by_definition(words, found))).hexdigest()
    assert some > 5


@pytest.mark.parametrize("n", [1, 2, 9, 100])
def test_repeated_tail(n):
    words = [str(i).encode() for i in range(n)]
    for key in range(200):
        import zlib

        h = zlib.crc32(str(key).encode())
        out = list(words)
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            out = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert repeated_tail(words, key) == out
