"""Ingest job: discover, route, parse, store, validate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelwright.operators import quality
from panelwright.session import settle
from panelwright.sources import leaves
from panelwright.sources.folders import Versions
from panelwright.sources.warehouse import Warehouse, from_tables, load_counts, open_warehouse, write_warehouse


QUARANTINE = "quarantine"
FACT = "agg_transaction"  # the table that the checks look at


class QualityError(RuntimeError):
    """A check failed; the message is the report."""


@dataclass(frozen=True)
class IngestResult:
    warehouse: Warehouse
    counts: DataFrame
    quarantine: DataFrame
    checks: DataFrame


def ingest(
    spark: SparkSession,
    root: str,
    out: str,
    datasets: Sequence[str] = leaves.DATASETS,
    min_year: int | None = None,
    max_year: int | None = None,
    strict: bool = True,
) -> IngestResult:
    """Rebuild the warehouse at ``out`` from the landing folder.

    Tables of datasets left out exist but are empty. Malformed leaves are listed in
    ``quarantine``. Every run writes a version of its own below ``out`` and checks it there; with ``strict`` a
    failed check raises. Only then is the version published, all tables in one step: until that
    step, and after a run that broke off anywhere before it, readers find the version before.
    """
    found = leaves.route_files(leaves.discover_files(spark, root, datasets, min_year, max_year))
    if found.isEmpty():
        raise ValueError("no file matches the requested scope")
    bodies = leaves.read_bodies(spark, root, datasets, min_year, max_year)
    versions = Versions(spark, out)
    version = versions.fresh()
    aside = versions.path(version)
    parsed = from_tables(spark, leaves.parse_tables(bodies))
    seen = write_warehouse(parsed, aside, {FACT: quality.row_figures()})
    leaves.quarantine(bodies).hint("rebalance").write.parquet(f"{aside}/{QUARANTINE}")
    stored = open_warehouse(spark, aside)
    checks = settle(quality.run_checks(stored, seen[FACT]))
    if strict and quality.has_failures(checks):
        report = quality.format_report(checks)
        versions.folders.remove(f"{versions.label}={version}")
        raise QualityError(report)
    versions.publish(version)
    versions.tidy()
    bad = spark.read.schema("rel_path string, reason string").parquet(f"{aside}/{QUARANTINE}")
    return IngestResult(stored, load_counts(stored), bad, checks)
