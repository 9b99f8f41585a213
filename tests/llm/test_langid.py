"""Held-out accuracy, spans of mixed texts, and the shortcut against the word-by-word pass."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm.common import crc_mod
from panelwright.llm.langid import fit, identify, keep_identified, label, viterbi, viterbi_many, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))


def test_held_out_accuracy(docs, model):
    held = docs.where(crc_mod(F.col("doc_id"), 4) == 2)
    right = identify(held, model).join(held, "doc_id").where("lang = lang_pred").count()
    assert right >= 0.98 * held.count()


def path_score(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


def test_shortcut_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(300):
        scores = rng.normal(size=(rng.integers(1, 40), 3)) * rng.choice([0.5, 2.0, 6.0])
        scores[:, rng.integers(3)] += rng.choice([0.0, 1.0])
        a, b = label([scores], 4.0)[0], viterbi(scores, 4.0)
        assert path_score(scores, a, 4.0) == pytest.approx(path_score(scores, b, 4.0))


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(12)
    for _ in range(200):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        scores = rng.normal(size=(n, k)) * rng.choice([1.0, 4.0])
        best = max(path_score(scores, np.array(p), 2.0) for p in product(range(k), repeat=n))
        assert path_score(scores, viterbi(scores, 2.0), 2.0) == pytest.approx(best)
        assert path_score(scores, label([scores], 2.0)[0], 2.0) == pytest.approx(best)


def test_many_texts_at_once():
    rng = np.random.default_rng(5)
    for k in (1, 2, 5):
        texts = [rng.normal(size=(n, k)).astype(np.float32) * 3 for n in (1, 2, 7, 8, 9, 64, 500, 1, 33)]
        for size in (1, 8, 32):
            for scores, path in zip(texts, viterbi_many(texts, 4.0, size)):
                assert path.tolist() == viterbi(scores, 4.0).tolist()
    assert viterbi_many([]) == []


def test_marks_belong_to_their_words():
    assert words("हिन्दी भाषा ภาษาไทย it's e\u0301te\u0301 'a' don\u2019t") == [
        "हिन्दी", "भाषा", "ภาษาไทย", "it's", "e\u0301te\u0301", "a", "don\u2019t"]


def test_shortcut_leaves_two_languages_without_the_best_one():
    scores = np.array([[0.0, 7.2, -40.0], [0.0, -40.0, 7.2]])
    assert label([scores], 8.0)[0].tolist() == viterbi(scores, 8.0).tolist() == [1, 2]
    rng = np.random.default_rng(9)
    for _ in range(500):
        scores = rng.normal(size=(rng.integers(2, 8), 4)) * 3.0
        scores[:, 0] = 0.5 * scores.max(axis=1)
        assert path_score(scores, label([scores], 4.0)[0], 4.0) == pytest.approx(path_score(scores, viterbi(scores, 4.0), 4.0))


def test_spans_of_a_mixed_text(docs, model, spark):
    parts = [docs.where(F.col("lang") == lang).where("length(text) > 600").orderBy("doc_id").first().text for lang in ("en", "de")]
    halves = [" ".join(p.split()[:60]) for p in parts]
    text = halves[0] + " . " + halves[1]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = identify(df, model).first().spans
    assert [s.lang for s in spans][0] == "en" and [s.lang for s in spans][-1] == "de"
    assert sum(s.words for s in spans) == len(words(text)) and len(spans) <= 4


def test_texts_in_many_languages_stay(spark):
    rng = np.random.default_rng(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = {f"l{k}": ["".join(rng.choice(list(letters[4 * k : 4 * k + 6]), 7)) for _ in range(50)] for k in range(5)}
    rows = [(k * 100 + i, " ".join(rng.choice(lexicon[lang], 60)), lang) for k, lang in enumerate(lexicon) for i in range(20)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(" ".join(rng.choice(lexicon[lang], 60)) for lang in lexicon)
    df = spark.createDataFrame([(1, mixed), (2, "123 ...")], "doc_id long, text string")
    assert identify(df.where("doc_id = 1"), model).first().score < 0.25
    assert [r.doc_id for r in keep_identified(df, model).collect()] == [1]


def test_edges(spark, docs, model):
    rows = [(1, None, "k"), (2, "", "k"), (3, "123 ... ²", "k"), (4, "the and of", "k"), (4, "the and of", "k"), (None, "der die und " * 20000, "k"), (5, "Привет мир", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    out = identify(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[None].lang_pred == "de"
    assert by[5].lang_pred in model.languages
    kept = keep_identified(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {4, None} and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert identify(df.limit(0), model).collect() == [] == keep_identified(df.limit(0), model).collect()
    nothing = fit(docs.limit(0))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    assert keep_identified(docs, model).count() >= 0.97 * docs.count()
