"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import scratch_path

#: Bitmaps that tell scans which rows are wanted: bits of one (what ``bitmap_construct_agg`` makes), and how many.
BITS, BITMAPS = 32768, 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage, survives lost executors, and keeps later column pruning.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``. A null key gives null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def unit_draw(key: Column, salt: str) -> Column:
    """A draw in [0, 1) that depends on the row's key alone, not on its place."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30)


def apart(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be in the only column of ``wanted``, and all others, which surely are not.

    ``wanted`` reaches the scan as bitmaps of 4 MB at most, so that wide rows are shuffled for few others than
    the wanted ones while the bitmaps are not full. Null is a key like any other.
    """
    slot, bucket, bits, byte = fresh(rows, "_slot", "_bucket", "_bits", "_byte")
    bitmaps = stash(
        wanted.select(F.pmod(F.xxhash64(wanted.columns[0]), F.lit(BITS * BITMAPS)).alias(slot))
        .select(F.expr(f"int({slot} div {BITS})").alias(bucket), (F.col(slot) % BITS).alias(byte))
        .groupBy(bucket).agg(F.expr(f"bitmap_construct_agg({byte})").alias(bits)), "bitmaps",
    )
    marked = rows.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(BITS * BITMAPS))).withColumn(bucket, F.expr(f"int({slot} div {BITS})"))
    marked = marked.join(F.broadcast(bitmaps), bucket, "left")
    own = F.conv(F.hex(F.substring(F.col(bits), F.expr(f"int({slot} % {BITS} div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn(byte, F.coalesce(own, F.lit(0)))
    hit = F.expr(f"shiftright({byte}, int({slot} % 8)) & 1 = 1")
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names starting like ``bases`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in bases:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
