"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every ``SPAN - K + 1`` consecutive word k-grams the one with the least hash is kept. A span
of ``SPAN`` words contains exactly one such group of k-grams, so whatever text shares a span
with an item also shares a kept hash: no shared span can be missed. Kept hashes of documents
and items are joined; every hit is then extended to the spans around it, compared word by word
with the item's spans, and the words under matching spans are counted once.

Items shorter than a span are looked for as a whole, through the hashes of all word groups of
their length; only lengths that occur (at most ``SPAN - 1``) are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import apart, fresh, lower_ascii, stash

SPAN, K = 10, 4
# What ends a word once A-Z are lower-cased: every ASCII character but digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in order; null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS)
    return F.filter(parts, lambda w: w != "")


def _pairwise(left: Column, right: Column, offset: int, n: Column, combine) -> Column:
    """Combine element i of ``left`` with element i + offset of ``right``, for ``n`` positions."""
    cut = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), cut), F.slice(right, F.lit(offset + 1), cut), combine)


def _spread(df: DataFrame, base: str, out: str, width: int, combine) -> DataFrame:
    """Column ``out``: for each position, ``combine`` over ``width`` consecutive elements of ``base``.

    Built by doubling, so the number of passes is logarithmic in the width.
    """
    have, at, steps = base, 1, []
    while at < width:
        step = min(at, width - at)
        name = f"{out}_{at + step}"
        n = F.size(base) - (at + step - 1)
        df = df.withColumn(name, _pairwise(F.col(have), F.col(have), step, n, combine))
        steps.append(name)
        have, at = name, at + step
    return df.withColumn(out, F.col(have)).drop(*steps)


def _hashes(df: DataFrame, k: int, out: str) -> DataFrame:
    """Order-sensitive hashes of all groups of ``k`` words of column ``w``."""
    if k == 1:
        return df.withColumn(out, F.transform("w", lambda w: F.xxhash64(F.lit(1), w)))
    df = df.withColumn("h1", F.transform("w", lambda w: F.xxhash64(w)))
    return _spread(df, "h1", out, k, lambda a, b: F.xxhash64(F.lit(k), a, b)).drop("h1")


def _winnowed(df: DataFrame, out: str, span: int, k: int) -> DataFrame:
    """For each span of ``span`` words its least k-gram hash (an array, by the span's first word)."""
    return _spread(_hashes(df, k, "g"), "g", out, span - k + 1, lambda a, b: F.least(a, b)).drop("g")


def _short(df: DataFrame, lengths: list[int]) -> DataFrame:
    for m in lengths:
        df = _hashes(df, m, f"s{m}")
    return df


def _matching(hashes: str, m: int) -> Column:
    """Spans of ``m`` words whose hash is among ``fps``: start, length and text."""
    at = F.transform(F.col(hashes), lambda h, i: F.when(F.array_contains("fps", h), i))
    return F.transform(
        F.filter(at, lambda i: i.isNotNull()),
        lambda i: F.struct(
            i.alias("start"), F.lit(m).alias("len"), F.array_join(F.slice("w", i + 1, F.lit(m)), " ").alias("span")
        ),
    )


def hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K,
) -> tuple[DataFrame, DataFrame]:
    """Two frames keyed by (``doc_id``, ``th``), ``th`` being a hash of the text.

    ``sizes``: one row per document with ``n_words`` and ``copies`` (equal rows). ``found``: one row per matching span of a
    document, ``start`` and ``len`` in words, with the matching ``item``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t"))
    tests = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w"))
    tests = stash(tests.where("size(w) > 0").distinct(), "items")
    lengths = sorted(
        r[0] for r in tests.select(F.least(F.size("w"), F.lit(span)).alias("m")).distinct().collect()
    )  # at most ``span`` numbers
    short, whole = [m for m in lengths if m < span], span in lengths

    # spans of the items: their text, and the hash that leads to them
    spans = []
    if whole:
        long = _winnowed(tests.where(F.size("w") >= span), "m", span, k)
        spans.append(long.select("item", F.posexplode("m").alias("i", "fp"), "w").select(
            "item", "fp", F.lit(span).alias("len"),
            F.array_join(F.slice("w", F.col("i") + 1, F.lit(span)), " ").alias("span"),
        ))
    for m in short:
        part = _hashes(tests.where(F.size("w") == m), m, "g")
        spans.append(part.select(
            "item", F.col("g")[0].alias("fp"), F.lit(m).alias("len"), F.array_join("w", " ").alias("span")
        ))
    if not spans:
        sizes = source.select("doc_id", "th", F.size(words(F.col("t"))).cast("long").alias("n_words"), F.lit(1).alias("copies"))
        return sizes, sizes.select(
            "doc_id", "th", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("item")
        ).limit(0)
    spans_df = spans[0]
    for other in spans[1:]:
        spans_df = spans_df.unionByName(other)
    spans_df = stash(spans_df.distinct(), "item-spans")
    prints = spans_df.select("fp").distinct()

    # fingerprints of the documents against those of the items
    frame = source.select("doc_id", "th", words(F.col("t")).alias("w"))
    frame = frame.withColumn("n_words", F.size("w").cast("long"))
    arrays = [f"s{m}" for m in short] + (["m"] if whole else [])
    if whole:
        frame = _winnowed(frame, "m", span, k)
    frame = _short(frame, short)
    kept = F.array_distinct(F.concat(*arrays)) if len(arrays) > 1 else F.array_distinct(arrays[0])
    exploded = frame.select("doc_id", "th", "n_words", F.posexplode_outer(kept).alias("pos", "fp"))
    matched = exploded.join(prints.withColumn("hit", F.lit(True)), "fp", "left")
    sizes = stash(
        matched.groupBy("doc_id", "th").agg(
            F.first("n_words").alias("n_words"),
            F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("copies"),
            F.collect_set(F.when(F.col("hit"), F.col("fp"))).alias("fps"),
        ), "doc-prints",
    )

    # extend the hits: only documents with a common fingerprint are read again
    suspects = sizes.where(F.size("fps") > 0).select(
        F.col("doc_id").alias("sid"), F.col("th").alias("sth"), "fps"
    )
    again, _ = apart(source, "doc_id", suspects.select("sid"))
    again = again.join(suspects, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")))
    again = again.select("doc_id", "th", words(F.col("t")).alias("w"), "fps")
    if whole:
        again = _winnowed(again, "m", span, k)
    again = _short(again, short)
    places = [_matching(name, m) for name, m in [(f"s{m}", m) for m in short] + ([("m", span)] if whole else [])]
    places = F.concat(*places) if len(places) > 1 else places[0]
    candidates = again.select("doc_id", "th", F.explode(places).alias("p")).select("doc_id", "th", "p.*")
    found = candidates.join(
        spans_df.select("item", F.col("len"), "span").distinct(), ["len", "span"]
    ).select("doc_id", "th", "start", "len", "item").distinct()
    return sizes.select("doc_id", "th", "n_words", "copies"), found


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated``.

    ``n_hit`` counts the words under any matching span, each once; ``items`` are the sorted ids
    (as strings) of the items with matching spans. A null or empty text has no words; items
    without words match nothing and rows that repeat an item add nothing. Rows that repeat an id
    with different texts are judged apart; rows that repeat both are judged alike. An empty
    ``docs`` gives an empty result, an empty ``items`` clean documents.
    """
    sizes, found = hits(docs, items, id_col, text_col, item_col, item_text_col, span, k)
    found = stash(found, "hits")
    before = Window.partitionBy("doc_id", "th").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    covered = (
        found.select("doc_id", "th", "start", "len").distinct()
        .withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("doc_id", "th")
        .agg(F.sum(F.greatest(end - F.greatest("start", "seen"), F.lit(0))).cast("long").alias("n_hit"))
    )
    named = (
        found.select("doc_id", "th", "item").distinct().groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    marks = covered.join(
        named.select(F.col("doc_id").alias("nid"), F.col("th").alias("nth"), "items"),
        F.col("doc_id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth")),
    ).select(F.col("doc_id").alias("mid"), F.col("th").alias("mth"), "n_hit", "items")
    out = sizes.join(marks, F.col("doc_id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth")), "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no span with any item, with all their columns."""
    _, found = hits(docs, items, id_col, text_col)
    bad_id, bad_th, th = fresh(docs, "_bad", "_bad_th", "_th")
    bad = stash(found.select(F.col("doc_id").alias(bad_id), F.col("th").alias(bad_th)).distinct(), "contaminated")
    maybe, rest = apart(docs, id_col, bad.select(bad_id))
    marked = maybe.withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.join(
        bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(th) == F.col(bad_th)), "left_anti"
    ).drop(th).unionByName(rest)
