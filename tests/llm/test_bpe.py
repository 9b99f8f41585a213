"""The coder against the tokenizers library, word by word and over tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelwright.llm.bpe import Codec, default_vocabulary, encode_decode

TRICKY = [
    "", " ", "a", "'s 'll don't I'm we've", "ΣΑΣ ΟΔΟΣ σς Σ", "İstanbul ẞ ﬁ", "é é 가", "\x1c\x1d\x85 x　y",
    "<|startoftext|>hi<|endoftext|>", "x<|endoftext|>'S<|endof text|>", "123 4５½Ⅷ", "🤗👩‍👩‍👧 ok", "日本語テキスト", "abc\u0000def", "﻿b​c",
    ":\U000323b0x", "\u1c89\ua7cb\ua7dc\U00010d50\U00016ea0 \u0558a", "a" * 300, "ﷺ İı", "!!!???...", "don’t stop", "_under_score_", "́ͅx", "<|startoftext|>" * 3,
]

LETTERS = str.maketrans("0123456789", "qrstuvwxyz")  # digits of base 26 that are no letters


@pytest.fixture(scope="module")
def pair():
    path = default_vocabulary()
    return Codec(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


def check(pair, text):
    codec, library = pair
    ids, n, words = next(codec.encode([text]))
    want = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(ids, "<u4").tolist()
    assert got == want, (text, got, want)
    assert n == len(want)
    assert codec.decode(ids) == codec.decode_words(words) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts(pair, text):
    check(pair, text)


@settings(max_examples=1500, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(pair, text):
    check(pair, text)


@settings(max_examples=1500, deadline=None)
@given(text=st.text(alphabet="abcdefghilmnorstu '0éüñß.,-", max_size=80))
def test_word_like_text(pair, text):
    check(pair, text)


@pytest.mark.parametrize("text", [
    "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(200_000)), "a" * 200_000, "na" * 60_000,
    "ภาษาไทยเป็นภาษาที่มีระดับเสียง" * 1500, "中文分词没有空格" * 4000, "x1" * 500 + "!" * 50_000,
])
def test_words_without_end(pair, text):
    check(pair, text)


def test_both_ways_of_merging(pair):
    codec, rng = pair[0], np.random.default_rng(1)
    for n in (2, 5, 50, 300):
        for _ in range(40):
            base = codec.base("".join(rng.choice(list("abcdehilnorst"), n)))
            assert codec._merge_long(list(base)) == codec.merge(list(base), {})


def test_what_a_task_remembers_is_bounded_and_frequent_words_stay(pair, monkeypatch):
    codec, library = Codec(open(default_vocabulary(), encoding="utf-8").read()), pair[1]
    codec_words, seen = codec.speculate, []
    monkeypatch.setattr(codec, "speculate", lambda symbols: seen.append(symbols) or codec_words(symbols))
    texts = [" ".join(["often", *(np.base_repr(2_000 * k + j, 26).lower().translate(LETTERS) for j in range(2_000))]) for k in range(200)]
    for k, (ids, n, words) in enumerate(codec.encode(texts)):
        if k % 50 == 0:
            want = library.encode(texts[k], add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert codec.decode_words(words) == library.decode(want, skip_special_tokens=False)
    assert seen.count("often") == 1 and len(seen) >= 380_000
    held = [codec.ids, codec.shown, *getattr(codec, "past", ())]
    assert sum(map(len, held)) < 600_000  # words' ids and pieces, of 800,000


def test_texts_leave_a_batch_by_parts(spark, pair):
    rows = [(i, f"{i} words {'x' * (i % 7)}") for i in range(2_500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in encode_decode(df, with_ids=False).collect()}
    for i, t in rows:
        want = pair[1].encode(t, add_special_tokens=False).ids
        assert got[i] == (len(want), hashlib.sha256(np.asarray(want, "<u4").tobytes()).hexdigest())


def test_table(spark, pair):
    texts = [None, "", "The same words", "The same words", "Ünïcode wörds " * 2000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in encode_decode(df, with_ids=False).collect()}
    whole = {r.doc_id: r for r in encode_decode(df).collect()}
    for i, t in enumerate(texts):
        want = pair[1].encode(t or "", add_special_tokens=False).ids
        data = np.asarray(want, "<u4").tobytes()
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(data).hexdigest()
        assert bytes(whole[i].ids) == data
        assert rows[i].decoded_sha256 == hashlib.sha256(whole[i].decoded.encode()).hexdigest()
    assert encode_decode(df.limit(0)).collect() == []
