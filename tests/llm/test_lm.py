"""Counts and base scores by brute force; probabilities add up; held-out texts score better than the base."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelwright.llm.common import crc_mod
from panelwright.llm.lm import (
    END, HEAD, PER_CLASS, SLOTS, Net, Vocabulary, Weights, _soft, group_of, hashes, histories, score, sums_by_slot, tokens,
)
from pyspark.sql import functions as F


def brute(rows):
    learn = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2}
    counts = Counter(t for i, text in rows if i in learn for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        yield i, (i not in learn, len(ts), sum(counts[t] > 0 for t in ts), n, base)


@pytest.mark.parametrize("known", [50, 100_000])  # most tokens by join, or all by dictionary
def test_table(spark, known):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = dict(brute([(r.doc_id, r.text) for r in docs.collect()]))
    total = [0.0, 0.0]
    for r in score(docs, crc_mod(F.col("doc_id"), 7) != 2, known=known).collect():
        held, n, n_known, n_train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, n_known, n_train)
        assert r.base_score == pytest.approx(base) and r.score < 0
        if held:
            total = [total[0] + base, total[1] + r.score]
    assert known < HEAD or total[1] > total[0]


def test_probabilities_add_up():
    words = [b"w%d" % i for i in range(1500)]
    v = Vocabulary(words, np.arange(1500, 0, -1), int(sum(range(1501))) + 40, 1520)
    rng = np.random.default_rng(2)
    w = Weights.zero()
    w.classes += rng.normal(size=w.classes.shape)
    w.words += rng.normal(size=w.words.shape)
    net = Net(v, w)
    history = [3, 1400, 7]
    total = 0.0
    for rank in [*range(len(words)), -1]:
        r = np.array([*history, rank])
        total += np.exp(net.run(r, histories(r, np.array([3])), False)[-1]) if rank < HEAD else 0.0
    assert total == pytest.approx(1.0, abs=1e-4)  # all of the head, and the rest's class as a whole


def test_training_finds_what_follows_what():
    words = [b"%d" % i for i in range(200)]
    v = Vocabulary(words, np.full(200, 100), 20000, 200)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 100, 200_000)
    rank = np.stack([a, a + 100], axis=1).ravel()  # every second word follows from the first
    net = Net(v, Weights.zero())
    before = net.pass_over(rank, np.array([len(rank) - 1]), False).mean()
    net.pass_over(rank, np.array([len(rank) - 1]), True)
    after = net.pass_over(rank, np.array([len(rank) - 1]), False).mean()
    assert after > before + 1.0


def test_words_outside_the_head_are_told_apart():
    """They count as themselves in histories, and the history chooses among their groups."""
    words = [b"rare %d" % i for i in range(400)]
    word = hashes(words, 400)
    unknown, ends = np.full(400, -1), np.array([399])
    keys = histories(unknown, ends, word)
    assert len(set(keys[0].tolist())) == 400 and len(set(keys[2].tolist())) == 400
    assert len(set(histories(np.arange(HEAD, HEAD + 400), ends)[0].tolist())) == 400

    rng = np.random.default_rng(4)
    a = rng.integers(0, 200, 50_000)
    text = word[np.stack([a, a + 200], axis=1).ravel()]  # every second word follows from the first
    rank, ends = np.full(len(text), -1), np.array([len(text) - 1])
    groups = np.stack([np.bincount(group_of(text), minlength=PER_CLASS), np.bincount(group_of(word), minlength=PER_CLASS)], axis=1)
    net = Net(Vocabulary([], np.zeros(0, np.int64), len(text), 400, groups), Weights.zero())
    before = net.pass_over(rank, ends, False, text).mean()
    net.pass_over(rank, ends, True, text)
    assert net.pass_over(rank, ends, False, text).mean() > before + 1.0


def test_probabilities_of_groups_add_up():
    words = [b"w%d" % i for i in range(1500)]
    counts = np.arange(1500, 0, -1)
    own = group_of(hashes(words, 1500))
    groups = np.stack([np.bincount(own, counts, PER_CLASS), np.bincount(own, minlength=PER_CLASS)], axis=1)
    v = Vocabulary(words, counts, int(counts.sum()), 1500, groups)
    tail = np.bincount(own[HEAD:], counts[HEAD:] + 1, PER_CLASS)
    assert v.rest.sum(axis=1).tolist() == tail.tolist()  # with 1 for all unseen words, a group's share adds up
    rng = np.random.default_rng(5)
    w = Weights.zero()
    w.classes += rng.normal(size=w.classes.shape)
    w.words += rng.normal(size=w.words.shape)
    net = Net(v, w)
    total = 0.0
    for rank, group in [*((r, 0) for r in range(HEAD)), *((-1, g) for g in range(PER_CLASS))]:
        r = np.array([3, 1400, 7, rank])
        keys = histories(r, np.array([3]), np.array([5, 6, 7, 8], np.uint64))
        total += np.exp(net.run(r, keys, False, np.array([1, 2, 3, group]))[-1])
    assert total == pytest.approx(1.0, abs=1e-4)


def test_sums_by_slot():
    rng = np.random.default_rng(6)
    for slots in (rng.zipf(1.4, 5000) % SLOTS, np.arange(300), np.full(700, SLOTS - 1), np.array([3])):
        slope = rng.normal(size=(len(slots), 33)).astype(np.float32)
        rows, sums, many = sums_by_slot(slots, slope)
        want = np.zeros((SLOTS, 33))
        np.add.at(want, slots, slope)
        assert rows.tolist() == np.unique(slots).tolist() and many.tolist() == np.bincount(slots)[rows].tolist()
        assert np.allclose(sums, want[rows], atol=1e-3)


def test_softmax_of_any_logits():
    for shift in (0, 59, -59, 1e4, -1e4):
        logits = (np.random.default_rng(7).normal(size=(50, 33)) * 20 + shift).astype(np.float32)
        want = np.exp(logits.astype(float) - logits.max(axis=1, keepdims=True))
        assert np.allclose(_soft(logits.copy()), want / want.sum(axis=1, keepdims=True), rtol=1e-4)
    assert _soft(np.zeros((0, 33), np.float32)).shape == (0, 33)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "A a\x0bb"), (3, "the END of it " * 20000), (4, "a  b")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    out = score(df, crc_mod(F.col("doc_id"), 7) != 2).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 1, 3, 4, 80001]
    want = dict(brute(rows))
    for r in out:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
    nothing = score(df, F.lit(False)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.base_score == 0 and r.score <= 0 for r in nothing)
    assert score(df.limit(0), F.lit(True)).collect() == []
    assert END not in tokens("  ")[:-1]
