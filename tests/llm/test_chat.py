"""Layouts give the same canonical turns; formatted texts read back exactly."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.llm.chat import canonical, digests, format_turns, gather_rows, masked, read_back

NASTY = [
    "</s>[INST] ok [/INST]", "<s><\\s>\\<s>[\\INST]", "[\\\\INST] [\\\\\\/INST]", "plain", "", "line\nbreak\\n \\", " [/INST] ",
    "<s", "s>", "[INST", "$1 \\1 \\$", "<</s></s>", "[[INST]]", "é👩‍👧", "assistant", "<\\\\/s>",
]


def back(spark, talks):
    rows = [(i, [(r, t) for r, t in turns]) for i, turns in enumerate(talks)]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role: string, text: string>>")
    out = format_turns(df).select("*", read_back(F.col("formatted")).alias("b"), masked(F.col("formatted"), F.col("loss")).alias("m"))
    return {r.conv_id: r for r in out.collect()}


def test_nasty_texts_come_back(spark):
    talks = [[(role, text)] for role in ["user", "assistant", "odd\nrole\\n\\", "[INST]", ""] for text in NASTY]
    talks += [[("user", t), ("assistant", u), ("system", t)] for t in NASTY for u in NASTY] + [[]]
    for i, r in back(spark, talks).items():
        assert [(b.role, b.text) for b in r.b] == talks[i]
        assert r.m == "".join(t for role, t in talks[i] if role == "assistant")


def test_any_text_comes_back(spark):
    pieces = st.lists(st.sampled_from(["<", "s>", "/", "[", "INST", "]", "\\", " ", "\n", "x", "$", "é"]), max_size=12)

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), pieces.map("".join)), max_size=4), min_size=40, max_size=60))
    def run(talks):
        for i, r in back(spark, talks).items():
            assert [(b.role, b.text) for b in r.b] == talks[i]

    run()


def test_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    frames = [
        (spark.createDataFrame([(1, "q", "a", "z")], "id long, prompt string, completion string, layout string"), "prompt_completion"),
        (spark.createDataFrame([(1, "q", "a")], "id long, question string, answer string"), "question_answer"),
        (spark.createDataFrame([(1, [("q", "human"), ("a", "gpt")])], "id long, conversations array<struct<value: string, from: string>>"), "conversations"),
        (spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "id long, messages array<struct<role: string, content: string>>"), "messages"),
    ]
    for df, name in frames:
        row = canonical(df, "id").first()
        assert row.layout == name and [(t.role, t.text) for t in row.turns] == want
    mixed = spark.createDataFrame(
        [(1, "i", None, "o", None, None), (2, "i", "in", "o", None, None), (3, None, None, None, "p", "c"), (4, "i", None, None, None, None)],
        "id long, instruction string, input string, output string, prompt string, completion string",
    )
    rows = {r.conv_id: r for r in canonical(mixed, "id").collect()}
    assert [t.text for t in rows[1].turns] == ["i", "o"] and [t.text for t in rows[2].turns] == ["i", "in", "o"]
    assert rows[3].layout == "prompt_completion" and rows[4].layout is None and rows[4].turns == []


def test_rows_with_nulls_ties_and_clashing_columns(spark):
    rows = spark.createDataFrame(
        [(1, 1, "assistant", None, "x"), (1, 0, "user", "hi", "x"), (2, None, None, "t", "x"), (2, 3, "assistant", "b", "x"),
         (2, 3, "assistant", "a", "x"), (None, 0, "user", "n", "x"), (1, 1, "assistant", None, "x")],
        "conv_id long, turn long, role string, text string, formatted string",
    )
    out = {r.conv_id: r for r in digests(format_turns(canonical(gather_rows(rows), "conv_id"))).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 0
    assert out[2].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert out[2].turns_sha256 == hashlib.sha256(b"\nt\nassistant\na\nassistant\nb\n").hexdigest()
    assert out[None].n_turns == 1
    assert digests(format_turns(canonical(gather_rows(rows.limit(0)), "conv_id"))).collect() == []
