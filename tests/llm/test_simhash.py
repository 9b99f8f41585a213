"""Fingerprints against the definition, links and components against brute force."""

from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from panelwright.llm.components import components
from panelwright.llm import jaccard
from panelwright.llm.simhash import close_texts, fingerprints, keep_one, links, near_duplicates, simhash


def by_definition(text: str, k: int = 4) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(values: list[int], radius: int) -> dict[int, int]:
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprint_is_the_definition():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 9, 300, 9000]:
        text = " ".join(rng.choice(["The", "Öl", "x y", "Éa", "and", "ẞ"]) for _ in range(n)) + "\v\f\t "
        assert simhash(text.encode()) == by_definition(text)
    assert simhash(b"") == 0


def flips(rng, base, n):
    for bit in rng.sample(range(64), n):
        base ^= 1 << bit
    return base


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(60)} | {0}
    for v in list(values)[:25]:
        values |= {flips(rng, v, rng.randint(1, 6)) for _ in range(8)}
    hot = rng.getrandbits(64)
    values |= {flips(rng, hot, rng.randint(0, 3)) for _ in range(150)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = groups(values, 4)
    for tile in (4096, 16):  # one tile per bucket, and buckets laid out in many tiles
        found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links(df, 4, tile).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in found)
        parent = {v: v for v in values}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in found:
            parent[find(a)] = find(b)
        assert len({(want[v], find(v)) for v in values}) == len(set(want.values())) == len({find(v) for v in values})


def test_components_of_long_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 == len({got[1000 + i] for i in range(300)})
    assert got[0] != got[1000] and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents_and_edge_cases(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eta", "iota"]
    long = [rng.choice(words) + str(i % 97) for i in range(400)]
    texts = [None, "", "  \t", " ".join(long), " ".join(long[:399] + ["other"]), " ".join(long), "one two", "x " * 50000]
    rows = [(10 + i, t, "c") for i, t in enumerate(texts)] + [(10, None, "c"), (None, "one two", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = near_duplicates(df).collect()
    assert len(out) == len(rows)
    marks = {r.doc_id: by_definition(r.text) for r in df.where("doc_id is not null").collect()}
    want = groups(sorted(set(marks.values())), 4)
    for r in out:
        mark = marks.get(r.doc_id, by_definition("one two"))
        assert r.fingerprint == f"{mark:016x}"
        assert r.component_id == min(i for i, m in marks.items() if want[m] == want[mark])
    assert near_duplicates(df.limit(0)).collect() == []


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = {r.doc_id: by_definition(r.text) for r in docs.collect()}
    want = groups(sorted(set(marks.values())), 4)
    for r in near_duplicates(docs).collect():
        assert r.component_id == min(i for i, m in marks.items() if want[m] == want[marks[r.doc_id]])
    assert fingerprints(docs).where(F.col("fp").isNull()).count() == 0


def test_keep_one_of_each_group(spark):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, groups_of = [], {}
    for g in range(30):
        base = make(250)
        for k in range(rng.randint(2, 6)):
            text = list(base)
            if k:
                text[rng.randrange(250)] = "changed"
            groups_of[len(rows)] = g
            rows.append((len(rows), " ".join(text), g))
    alone = [(1000 + i, " ".join(make(120)), -1) for i in range(200)]
    df = spark.createDataFrame(rows + alone + [(None, None, 0), (2000, "", 0), (2001, " ", 0)], "doc_id long, text string, _gone int")
    kept = [r.doc_id for r in keep_one(df).collect()]
    assert len(kept) == len(set(kept)) and set(range(1000, 1200)) <= set(kept) and None in kept
    assert 2000 in kept and 2001 not in kept  # texts without words are alike
    assert sorted(groups_of[i] for i in kept if i is not None and i < 1000) == list(range(30))
    assert keep_one(df.limit(0)).collect() == []


def test_near_copies_are_found_by_simhash(spark, monkeypatch):
    """Without the prefix filter, close texts still meet; unlike ones of one fingerprint stay."""
    rng = random.Random(12)
    make = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base, passage = make(400), "one two three four five " * 200
    rows = [(1, base), (2, base + " more"), (3, make(300)), (4, passage + make(20)), (5, passage + make(20))]
    marks = [by_definition(t) for _, t in rows]
    assert 0 < (marks[0] ^ marks[1]).bit_count() <= 4 and marks[3] == marks[4]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups_found = {}
    for r in close_texts(df).collect():
        groups_found.setdefault(r.group, set()).add(r.doc_id)
    assert sorted(map(sorted, groups_found.values())) == [[1, 2], [4, 5]]
    monkeypatch.setattr(jaccard, "_met", lambda t: lambda batches: iter(()))
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [1, 3, 4, 5]


def test_close_texts_are_all_that_brute_force_connects(spark):
    """Every text with a partner within the radius has its group; null, empty and repeated texts too."""
    rng = random.Random(13)
    texts = [None, "", " \t", "one two", "One  two", "x y z"]
    for k in range(40):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([5, 60, 400]))]
        texts.append(" ".join(words))
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += texts[6:12]
    marks = {i: by_definition(t) for i, t in enumerate(texts)}
    root = groups(sorted(set(marks.values())), 4)
    want: dict[int, set[int]] = {}
    for i, m in marks.items():
        want.setdefault(root[m], set()).add(i)
    got: dict[int, set[int]] = {}
    for r in close_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.doc_id not in got.setdefault(r.group, set())
        got[r.group].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert len(got) > 10
