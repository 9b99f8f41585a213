"""Groups against a dictionary of texts, with nulls, repeated rows, long texts and clashing names."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from panelwright.llm.exact_dedup import exact_groups, keep_one

SCHEMA = "doc_id long, text string, _len int, _digest string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def test_groups(spark):
    long = "ab" * 200_000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "a "), (6, "same start " * 30 + "x"), (7, "same start " * 30 + "y"),
            (8, long), (9, long), (9, long), (10, long[:-1] + "c"), (None, "a"), (None, "alone"), (11, "é"), (12, "é")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = exact_groups(frame(spark, rows), carry={"sha": F.sha2("_text", 256)}).collect()
    assert len(out) == len(rows)
    want = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    key = repr
    assert sorted(map(key, map(tuple, out))) == sorted(map(key, want))
    assert exact_groups(frame(spark, rows).limit(0)).collect() == []


def test_keep_one(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (None, "a"), (None, None), (4, ""), (5, "z"), (5, "z")]
    df = frame(spark, rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(2, "a"), (3, "b"), (3, "c"), (4, ""), (5, "z")]
    assert keep_one(df.limit(0)).collect() == []


def test_one_text_for_most_rows(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("own "), F.col("id"))).otherwise(F.lit("hot")).alias("text"))
    out = exact_groups(df).groupBy("kept", "group_size").count().collect()
    assert {(r.kept, r.group_size): r["count"] for r in out} == {(True, 1): 1000, (True, 2000): 1, (False, 2000): 1999}
