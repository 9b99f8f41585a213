"""Hits against the definition, word by word."""

from __future__ import annotations

import hashlib
import random
import re

from panelwright.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text, items):
    words, hit, found = split(text), set(), set()
    for item, wanted in items:
        wanted = split(wanted)
        m = min(10, len(wanted))
        spans = {tuple(wanted[i : i + m]) for i in range(len(wanted) - m + 1)} if m else set()
        for s in range(len(words) - m + 1):
            if m and tuple(words[s : s + m]) in spans:
                hit |= set(range(s, s + m))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, w string, th int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    out = contamination(d, b)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()), key=repr)
    assert got == sorted(((i, *expected(t, items)) for i, t in docs), key=repr)
    clean = drop_contaminated(d, b)
    assert clean.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(
        ((i, t) for i, t in docs if not expected(t, items)[4]), key=repr)


def test_random_texts(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "日本", "x9"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", " -", "\n"]) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([10, 11, 12, 15, 30, 60, 9, 5, 2, 0])] + [(10, None), (2, make(12)), (99, make(40))]
    docs = []
    for i in range(60):
        text = make(rng.randint(0, 60))
        if i % 3:
            words = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(max(1, len(words) - 8))
            text += " | " + " ".join(words[a : a + rng.randint(6, 25)]).upper() + ". " + make(rng.randint(0, 20))
        docs.append((i, text))
    check(spark, docs, items)


def test_edges(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten), (2, ten), (10, "solo"), (3, None), (4, "!!")]
    docs = [(1, None), (2, ""), (3, ten), (3, ten), (3, "other text"), (None, "a SOLO b"), (4, ten[:-3]), (5, ("x y " * 30000) + ten + " z"),
            (6, "one two three four five six seven eight nine ten " * 3)]
    check(spark, docs, items)
    check(spark, docs, [(3, None), (4, "")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contamination(empty, spark.createDataFrame([(1, ten)], "item_id long, text string")).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    out = contamination(spark.createDataFrame(docs, "doc_id long, text string"), none).collect()
    assert len(out) == len(docs) and not any(r.contaminated for r in out)
