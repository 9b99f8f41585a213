"""Incremental refresh: only leaves not seen before are read.

The file source remembers processed leaves in its checkpoint, so a run after new quarters have
landed reads just those. Each leaf is read once, and each micro-batch owns one folder per
table, overwritten when the batch is repeated after a failure: rows arrive exactly once. A
leaf's age does not matter, so that a backfill that keeps its file times is read like any other,
and leaves that cannot be decoded are recorded next to the tables.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelwright.operators import quality
from panelwright.schemas import TABLES, table_schema
from panelwright.sources import leaves
from panelwright.sources.warehouse import Warehouse, from_tables

_TEXT = "value string"
_QUARANTINE = "rel_path string, reason string"
# the file source ignores files older than this before the newest one: out of reach
_ANY_AGE = "36500d"


@dataclass(frozen=True)
class Refreshed:
    warehouse: Warehouse
    quarantine: DataFrame
    checks: DataFrame


def refresh(
    spark: SparkSession, root: str, out: str, state: str, files_per_batch: int | None = None
) -> Refreshed:
    """Bring the tables below ``out`` up to date. ``state`` holds the progress."""
    reader = (
        spark.readStream.format("text").schema(_TEXT)
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("maxFileAge", _ANY_AGE)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    fresh = leaves.attach_records(reader.load(f"{root.rstrip('/')}/data"), root)

    def store(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            # few files per table and quarter, however many leaves the batch read
            parts = {n: rows.hint("rebalance", "year", "quarter") for n, rows in leaves.parse_tables(held).items()}
            parts["quarantine"] = leaves.quarantine(held).hint("rebalance")

            def put(name: str) -> None:
                writer = parts[name].write.mode("overwrite")
                if name in TABLES:
                    writer = writer.partitionBy("year", "quarter")
                writer.parquet(f"{out.rstrip('/')}/{name}/batch={batch_id}")

            with ThreadPoolExecutor(len(parts)) as pool:
                list(pool.map(put, parts))
        finally:
            held.unpersist()

    query = (
        fresh.writeStream.foreachBatch(store)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return open_refreshed(spark, out)


def open_refreshed(spark: SparkSession, out: str) -> Refreshed:
    """Tables, quarantined leaves and checks as of the last finished refresh.

    Period filters prune folders: below each batch the tables are laid out by quarter.
    """
    def stored(name: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{out.rstrip('/')}/{name}")

    tables = from_tables(spark, {name: stored(name, table_schema(name)) for name in TABLES})
    quarantine = stored("quarantine", _QUARANTINE).select("rel_path", "reason")
    return Refreshed(tables, quarantine, quality.run_checks(tables))
