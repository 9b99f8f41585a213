"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

The first scan takes two numbers per text (byte length and the hash of its first
characters). Only (length, prefix) pairs seen more than once survive. The second scan
digests the whole content of the survivors, where the text is read, so that no text is ever
shuffled. The survivors reach that scan as a bitmap of fixed size: a set bit that belongs to
no survivor costs one digest and changes no result, because groups are formed by the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import apart, fresh, stash

PREFIX_CHARS = 256
#: Bits in one bitmap (what ``bitmap_construct_agg`` makes) and number of bitmaps: 1 MB in all.
BITS, BUCKETS = 32768, 256


def _shape(text: Column, prefix: int) -> dict[str, Column]:
    return {
        "_len": F.octet_length(text),
        "_head": F.xxhash64(F.substring(text, 1, prefix)),
    }


def _slot(length: Column, head: Column) -> Column:
    return F.pmod(F.xxhash64(length, head), F.lit(BITS * BUCKETS))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix: int = PREFIX_CHARS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``carry``.

    Texts are equal when identical; null counts as empty. The largest id of a group stays, a
    null id ranks below every other. Rows that repeat both id and text count one by one in
    ``group_size`` and are all marked alike; ``keep_one`` keeps a single one of them. An empty
    table gives an empty result. Other columns of ``docs`` are not read, whatever their names.
    ``carry`` names further columns computed from ``_text`` while it is being read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))

    # lengths, then prefixes: counted before the shuffle, so a large group is one row per task
    shapes = source.select(*(c.alias(n) for n, c in _shape(F.col("_text"), prefix).items()))
    heads = shapes.groupBy("_len", "_head").agg(F.count("*").alias("_n"))
    heads = stash(heads, "dedup-heads")
    lengths = heads.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    alive = heads.where("_n > 1").join(lengths, "_len", "left_semi")
    slot = _slot(F.col("_len"), F.col("_head"))
    bitmaps = (
        alive.select((slot / BITS).cast("int").alias("_bucket"), (slot % BITS).alias("_bit"))
        .groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))
    )  # at most BUCKETS rows of BITS bits

    # full digests of the survivors, at the scan
    rows = source.withColumns(_shape(F.col("_text"), prefix)).withColumn("_slot", _slot(F.col("_len"), F.col("_head")))
    rows = rows.withColumn("_bucket", (F.col("_slot") / BITS).cast("int"))
    rows = rows.join(F.broadcast(bitmaps), "_bucket", "left")
    bit = F.col("_slot") % BITS
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    alive_bit = F.expr("shiftright(_byte, cast(_slot % 8 as int)) & 1") == 1
    rows = rows.withColumn("_byte", byte)
    rows = stash(rows.select(
        "doc_id", "_len", "_head",
        F.when(alive_bit, F.sha2("_text", 256)).alias("_full"),
        *((carry or {})[n].alias(n) for n in (carry or {})),
    ), "dedup-rows")

    # written first, so that both sides of the join are dealt out anew and a hot group is split
    groups = stash((
        rows.where("_full is not null")
        .groupBy("_len", "_head", "_full")
        .agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size"))
        .where("_size > 1")
    ), "dedup-groups")
    joined = rows.join(groups, ["_len", "_head", "_full"], "left")
    grouped = F.col("_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(grouped, F.col("_keep")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        *(carry or {}),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX_CHARS) -> DataFrame:
    """The documents that stay, with all their columns.

    Of rows that repeat both id and text one stays. Ids are compared with their text's digest,
    so different texts under one id are judged apart. Only texts under an id that loses a row are
    digested again and shuffled.
    """
    columns = docs.columns
    digest, gone_id, gone_digest, again_id, again_digest = fresh(
        docs, "_digest", "_gone", "_gone_digest", "_again", "_again_digest"
    )
    verdict = exact_groups(docs, id_col, text_col, prefix, carry={"digest": F.sha2("_text", 256)})
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest))
    again = (
        verdict.where("kept and group_size > 1").groupBy("doc_id", "digest").count().where("count > 1")
        .select(F.col("doc_id").alias(again_id), F.col("digest").alias(again_digest))
    )
    gone, again = stash(gone, "dedup-gone"), stash(again, "dedup-again")
    maybe, rest = apart(docs, id_col, gone.select(gone_id).union(again.select(again_id)))
    left = maybe.withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    left = left.join(
        gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_digest)), "left_anti"
    )
    # rows repeated as a whole: rare, and only they are brought together
    left = left.join(
        again, F.col(id_col).eqNullSafe(F.col(again_id)) & (F.col(digest) == F.col(again_digest)), "left"
    )
    once = left.where(F.col(again_digest).isNull())
    repeated = left.where(F.col(again_digest).isNotNull()).dropDuplicates([id_col, digest])
    return once.unionByName(repeated).select(*columns).unionByName(rest)
