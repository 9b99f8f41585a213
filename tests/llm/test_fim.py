"""Rearranged texts against plain string slicing, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm.fim import Markers, Press, choose, digests, fill_in_middle, store, texts


def by_definition(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_table_against_slicing(spark):
    rng = random.Random(5)
    signs = "ab<>PSM \né中\U0001f917́"
    bodies = [None, "", "a", "<", "<P", "<P>", "x<M>y", "<<S", "\U0001f917" * 9_000, "word " * 10_000]
    bodies += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(600)]
    rows = [(i, t, "f") for i, t in enumerate(bodies)] + [(3, "again", "f"), (3, "again", "f"), (None, "no id", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, frames string")
    want = sorted((repr((i, *by_definition(i, t), t or "")) for i, t, _ in rows))
    assert {"plain", "psm", "spm"} == {by_definition(i, t)[1] for i, t, _ in rows}
    for units in (7, 8192):
        out = fill_in_middle(store(df, units=units), units=units)
        got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in texts(out).collect()]
        assert sorted(map(repr, got)) == want
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        marks = sorted((repr((r.doc_id, r.output_sha256, r.restored_sha256)) for r in digests(out).collect()))
        assert marks == sorted(repr((g[0], sha(g[5]), sha(g[6]))) for g in got)
    assert digests(fill_in_middle(store(df.limit(0)))).collect() == []


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet="ab<>PSMé\U0001f917", max_size=50), units=st.integers(1, 9), data=st.data())
def test_any_cut(text, units, data):
    press, marks = Press(units), Markers()
    ends, frames = press.store(text)
    assert b"".join(press.stream(ends, frames, 0, len(text))).decode() == text
    if not text or any(m in text for m in marks.all):
        return
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    for form, want in (("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")):
        cut = press.rearrange(ends, frames, form, a, b, marks)
        assert cut[0][-1] == len(want)
        assert b"".join(press.stream(*cut, 0, len(want))).decode() == want
        assert b"".join(press.restore(*cut, form, marks)).decode() == text


def test_frames_between_cuts_are_not_opened():
    press = Press(10)
    text = "".join(chr(97 + i % 26) for i in range(95))
    ends, frames = press.store(text)
    opened = []
    plain = press.open
    press.open = lambda f: opened.append(f) or plain(f)
    out = press.rearrange(ends, frames, "psm", 15, 72, Markers())
    assert len(opened) == 4  # each cut is needed by the part before and the part after it
    assert set(opened) == {frames[1], frames[7]}
    assert set(frames) - set(opened) <= set(out[1])


def test_shares_and_markers(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "'some text' as text")
    counts = {r.form: r["count"] for r in choose(store(df)).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 200) < 60 and abs(counts["spm"] - 360) < 90
    assert choose(store(df), plain=0).where("form = 'plain'").count() == 0
    with pytest.raises(ValueError):
        Markers("<P>", "<P>", "<M>")
    with pytest.raises(ValueError):
        Markers("aXa", "aS", "aM")
