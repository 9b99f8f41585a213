"""Pseudonyms keep the format, link equal values, can be undone, and leave the rest alone."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelwright.llm.pii import pseudonymise

KEY = "test key"
TEXTS = [
    None, "", "nothing here", "mail a.b9@mail7.example.com, again a.b9@mail7.example.com.", "card 4111111111111111 and 4111 1111 1111 1111",
    "not a card 4111111111111112", "ip 97.51.17.173 but 300.1.1.1 or 1.2.3.4.5", "call +1 (017) 555-7713 now", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x',
    "IBAN DE89 3704 0044 0532 0130 00, DE89370400440532013000; bad DE89370400440532013001", "born 1999-12-31 or 31.12.1999 or 12/31/1999, not 1999-13-31",
    "ssn 123-45-6789, not 000-45-6789", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "a" * 100000 + " 10.0.0.1 " + "b" * 1000, "[3] $1 \\1 4111111111111111",
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_formats_links_and_undo(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, kinds string")
    out = pseudonymise(df, KEY)
    rows = {r.doc_id: r for r in out.collect()}
    kinds = [r.kinds for _, r in sorted(rows.items())]
    assert kinds == [[], [], [], ["email"] * 2, ["card"] * 2, [], ["ipv4"], ["phone"], ["secret"], ["iban"] * 2, ["date"] * 3, ["ssn"], ["ipv6"], ["ipv4"], ["card"]]
    for i, t in enumerate(TEXTS):
        new = rows[i].text
        if not kinds[i]:
            assert new == t
            continue
        assert new != t and (len(new) == len(t) or "ipv4" in kinds[i])
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
        if i not in (6, 13):
            assert shape(new) == shape(t)
    cards = re.findall(r"[\d ]{16,}", rows[4].text)
    assert all(luhn(c) for c in cards) and re.sub(" ", "", cards[0]) == re.sub(" ", "", cards[1])
    assert re.findall(r"\d{16}", rows[14].text)[0] == re.findall(r"\d{16}", rows[4].text)[0]
    mails = re.findall(r"\S+@\S+com", rows[3].text)
    assert mails[0] == mails[1]
    a, b, bad = re.findall(r"[A-Z]{2}\d\d[\d ]{18,23}", rows[9].text)
    plain = re.sub(" ", "", a)
    assert plain == b.strip() and int(plain[4:] + "1314" + plain[2:4]) % 97 == 1 and "DE89370400440532013001" in rows[9].text
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", rows[10].text).groups()
    assert f"{d}.{m}.{y}" in rows[10].text and f"{m}/{d}/{y}" in rows[10].text and "1999-13-31" in rows[10].text
    again = {r.doc_id: r.text for r in pseudonymise(out.select("doc_id", "text"), KEY, undo=True).collect()}
    assert again == dict(enumerate(TEXTS))
    other = {r.doc_id: r.text for r in pseudonymise(df, "another key").collect()}
    assert other[4] != rows[4].text
    assert pseudonymise(df.limit(0), KEY).collect() == []


def test_one_to_one(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("%03d-%02d-%04d", F.col("id") % 600 + 1, F.col("id") % 99 + 1, F.col("id") + 1).alias("text"))
    out = pseudonymise(df, KEY).collect()
    assert len({r.text for r in out}) == 3000 and all(r.kinds == ["ssn"] for r in out)
    days = spark.range(4000).select(F.col("id").alias("doc_id"), F.date_format(F.expr("date_add(date'1950-01-01', cast(id * 7 as int))"), "yyyy-MM-dd").alias("text"))
    out = pseudonymise(days, KEY).collect()
    assert len({r.text for r in out}) == 4000 and all(r.kinds == ["date"] for r in out)


def test_secrets_of_any_length_and_short_ipv6(spark):
    run = "aB3dE6gH9k" * 500
    secrets = [run[:129], run[:150], run[:500], run, run[:60] + "/" + run[:70] + "+" + run[:87] + "-" + run[:100],
               f"{run[:36]}.{run[3:120]}.{run[5:48]}", run[:40] + "==", run[:40] + "é"]
    short = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1", "2001:db8:1:2:3:4:5::", "::2:3:4:5:6:7:8"]
    other = ["std::vector Foo::bar", "1:2:3:4::5:6:7:8", "at 12:30:45", "::"]
    texts = [f'x token="{t}" end' for t in secrets] + [f"from {t}, and {t}: up" for t in short] + other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pseudonymise(df, KEY)
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(secrets):
        assert rows[i].kinds == ["secret"] and len(rows[i].text) == len(texts[i])
        old, new = t.rstrip("é"), rows[i].text[9 : 9 + len(t.rstrip("é"))]
        # no piece of it stays in clear, signs stay in place
        assert not any(old[k : k + 12] == new[k : k + 12] for k in range(len(old) - 11))
        assert re.sub("[A-Za-z0-9]", "a", old) == re.sub("[A-Za-z0-9]", "a", new)
    for i, t in enumerate(short, len(secrets)):
        assert rows[i].kinds == ["ipv6"] * 2 and t not in rows[i].text and len(rows[i].text) == len(texts[i])
    for i, t in enumerate(other, len(secrets) + len(short)):
        assert rows[i].text == t and rows[i].kinds == []
    again = {r.doc_id: r.text for r in pseudonymise(out.select("doc_id", "text"), KEY, undo=True).collect()}
    assert again == dict(enumerate(texts))


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = pseudonymise(docs, KEY)
    back = pseudonymise(out.select("doc_id", "text"), KEY, undo=True)
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        old = texts[r.doc_id]
        cards = [c for c in re.findall(r"(?<![\w.])\d{16}(?![\w.])", old) if luhn(c)]
        mails = re.findall(r"[\w.]+@mail\d\.example\.com", old)
        assert not any(c in r.text for c in cards) and not any(m in r.text for m in mails)
        assert len(r.text) == len(old) or "ipv4" in r.kinds
