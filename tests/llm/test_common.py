"""Rows told apart by bitmaps."""

from __future__ import annotations

from panelwright.llm import exact_dedup
from panelwright.llm.common import apart


def test_wanted_rows_and_the_rest(spark):
    rows = [(k if k % 9 else None, f"t{k}", k) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, _bits string, _slot int")
    for wanted in ([(k,) for k in range(0, 2000, 50)], [(None,), (3,)], []):
        maybe, rest = apart(df, "doc_id", spark.createDataFrame(wanted, "x long"))
        assert maybe.columns == rest.columns == df.columns
        some, others = [tuple(r) for r in maybe.collect()], [tuple(r) for r in rest.collect()]
        assert sorted(r[2] for r in some + others) == list(range(2000))
        ids = {w for (w,) in wanted}
        assert not [r for r in others if r[0] in ids] and len(some) <= len([r for r in rows if r[0] in ids]) + 5
    full, none = apart(df, "doc_id", spark.range(2000).selectExpr("id"))
    assert full.count() + none.count() == 2000


def test_texts_that_stay_are_not_shuffled(spark):
    """Exact copies: only rows of ids that lose one lie behind an exchange."""
    rows = [(k, f"text {min(k, 90)}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = exact_dedup.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(90), 99]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
