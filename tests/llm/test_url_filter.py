"""Listed rules by definition; mined rules against brute-force matching."""

from __future__ import annotations

import re

import pytest

from panelwright.llm.url_filter import LISTED, judge, mine, split_url, tokens
from pyspark.sql import functions as F


def expected(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in LISTED:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return host, path, *(best or (None, None))


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "x://example.net/enx", "x://net/", "x://net", "x://notnet/",
    "a://b://c/d", "x://example.com/de/", "x://wexample.com/de/", "x://w.example.com/DE/", "x://É.ORG/fr/é\nline", "x://h?://net/",
    "x://org/fr/", "x://example.org#a/fr/", "x://h\n/p", "://net/q", "x://net//", "x://example.net/en/", "x://EXAMPLE.net/en/?net/",
]


def test_listed_rules(spark):
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS + URLS[-2:])], "page_id long, url string, host string")
    rows = {r.page_id: r for r in judge(df).collect()}
    assert len(rows) == len(URLS) + 2
    for i, u in enumerate(URLS + URLS[-2:]):
        host, path, rule, verdict = expected(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == (verdict or rows[i].verdict) and rows[i].verdict in ("allow", "block")
    assert judge(df.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_mined_rules_decide_as_brute_force_does(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    out = judge(pages).collect()
    host, path = split_url(F.col("url"))
    rule = {r.page_id: (r.rule, r.verdict) for r in out}
    seen = [
        (r.page_id, sorted(r.parts), *rule[r.page_id])
        for r in pages.select("page_id", tokens(F.col("url"), host, path).alias("parts")).collect()
    ]
    labelled = [(i, parts, v) for i, parts, r, v in seen if r is not None]
    mined = mine(spark.createDataFrame(labelled, "page_id long, parts array<string>, verdict string")).collect()
    assert mined
    for m in mined:  # support and confidence by counting
        have = [v for _, parts, v in labelled if set(m.parts) <= set(parts)]
        assert m.confidence == pytest.approx(have.count(m.verdict) / len(have)) and m.confidence >= 0.75
        assert have.count(m.verdict) / len(labelled) == pytest.approx(m.support)
    for i, parts, r, v in seen:
        if r is None:
            fits = [m for m in mined if set(m.parts) <= set(parts)]
            best = max(fits, key=lambda m: (m.confidence, m.support, -len(m.parts), " ".join(m.parts)), default=None)
            assert v == (best.verdict if best else "allow")
