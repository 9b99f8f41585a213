"""Refresh by quarter: new, corrected and removed leaves.

A manifest remembers every leaf behind the tables: path, length, file time and a digest of its body. A run
compares it with the landing folder. Bodies are read only for quarters in which some leaf is new, gone or
of another length or time; of those, the cells (table, year, quarter) in which a digest really changed
are written anew, all others stay as they are.

Each run writes below folders of its own, and the manifest, which says for each leaf in which run its cell
lies, comes last. Publishing the manifest puts all tables in place in one step; a run that breaks off
before it changes nothing. Afterwards, cells that neither this manifest nor the one before mentions are
removed, so the number of files does not grow with the runs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import quality
from panelwright.schemas import TABLES, table_columns, table_schema
from panelwright.session import settle
from panelwright.sources import leaves
from panelwright.sources.folders import Folders, Versions
from panelwright.sources.warehouse import from_tables
from panelwright.streaming.refresh import Refreshed

MANIFEST = (
    "rel_path string, table_name string, year int, quarter int, length bigint, modified timestamp, "
    "digest string, reason string, run int"
)


def _manifests(spark: SparkSession, out: str) -> Versions:
    return Versions(spark, f"{out.rstrip('/')}/manifest", "run")


def _read(spark: SparkSession, path: str | None) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/leaves") if path else spark.createDataFrame([], MANIFEST)


def _cells(manifest: DataFrame) -> set[tuple[str, int, int, int]]:
    """(table, run, year, quarter) of a manifest: a few for each quarter of the calendar."""
    return {tuple(r) for r in manifest.select("table_name", "run", "year", "quarter").distinct().collect()}


def _folder(cell: tuple[str, int, int, int]) -> str:
    return "{}/run={}/year={}/quarter={}".format(*cell)


def _in(cells: set[tuple[int, int]]) -> Column:
    """Whether a row's year and quarter are among some."""
    return (F.col("year") * 10 + F.col("quarter")).isin([10 * y + q for y, q in cells])


def reconcile(spark: SparkSession, root: str, out: str) -> Refreshed:
    """Bring the tables below ``out`` in line with the leaves below ``root``, whatever happened to those.

    A leaf that cannot be decoded gives no rows and is listed with the reason; one that is mended later is
    read then. A run that finds nothing changed writes nothing.
    """
    versions = _manifests(spark, out)
    old = _read(spark, versions.newest())
    now = leaves.list_details(spark, root)
    before = old.select("rel_path", F.struct("length", "modified").alias("was"), F.col("year").alias("y"), F.col("quarter").alias("q"))
    both = now.join(before, "rel_path", "full")
    seen = F.struct("length", "modified")
    stirred = both.filter(F.col("was").isNull() | F.col("length").isNull() | (seen != F.col("was"))).select(
        F.coalesce("year", "y").alias("year"), F.coalesce("quarter", "q").alias("quarter")).distinct()
    quarters = {(r.year, r.quarter) for r in stirred.collect()}  # at most the quarters of the calendar
    if not quarters:
        return open_reconciled(spark, out)

    bodies = leaves.read_bodies(spark, root).filter(_in(quarters))
    bad = leaves.quarantine(bodies)
    digests = bodies.select("rel_path", F.sha2("body", 256).alias("digest"))
    fresh = settle(now.filter(_in(quarters)).join(digests, "rel_path").join(bad, "rel_path", "left").select(
        "rel_path", "table_name", "year", "quarter", "length", "modified", "digest", "reason"))
    own = old.filter(_in(quarters))
    change = fresh.select("rel_path", "table_name", "year", "quarter", "digest").join(
        own.select("rel_path", F.col("table_name").alias("t"), F.col("year").alias("y"), F.col("quarter").alias("q"), F.col("digest").alias("d")),
        "rel_path", "full").filter(~F.col("digest").eqNullSafe(F.col("d")))
    touched = {tuple(r) for r in change.select(
        F.coalesce("table_name", "t"), F.coalesce("year", "y"), F.coalesce("quarter", "q")).distinct().collect()}

    run = versions.fresh()
    parsed = leaves.parse_tables(bodies)

    def put(name: str) -> None:
        cells = {(y, q) for t, y, q in touched if t == name}
        if cells:
            parsed[name].filter(_in(cells)).hint("rebalance", "year", "quarter").write.mode("overwrite").partitionBy(
                "year", "quarter").parquet(f"{out.rstrip('/')}/{name}/run={run}")

    with ThreadPoolExecutor(len(TABLES)) as pool:
        list(pool.map(put, TABLES))

    at = F.array(*[F.lit(f"{t} {y} {q}") for t, y, q in sorted(touched)]).cast("array<string>")
    is_new = F.array_contains(at, F.concat_ws(" ", "table_name", "year", "quarter"))
    held = own.groupBy("table_name", "year", "quarter").agg(F.max("run").alias("at"))  # one run a cell
    settled = fresh.join(held, ["table_name", "year", "quarter"], "left").withColumn("run", F.when(is_new, run).otherwise(F.col("at")))
    columns = spark.createDataFrame([], MANIFEST).columns
    manifest = old.filter(~_in(quarters)).select(*columns).unionByName(settled.select(*columns))
    manifest.hint("rebalance").write.parquet(f"{versions.path(run)}/leaves")
    versions.publish(run)
    _tidy(spark, out, versions)
    return open_reconciled(spark, out)


def _tidy(spark: SparkSession, out: str, versions: Versions) -> None:
    """Remove cells that the last two manifests do not mention, and what broken runs left."""
    versions.tidy()
    folders, stay = Folders(spark, out), set()
    for run in versions.published():
        stay |= set(map(_folder, _cells(_read(spark, versions.path(run)))))
    runs = {"/".join(x.split("/")[:2]) for x in stay}
    for name in TABLES:
        for path in folders.found(f"{name}/run=*"):
            if path not in runs:
                folders.remove(path)
        for path in folders.found(f"{name}/run=*/year=*/quarter=*"):
            if path not in stay:
                folders.remove(path)


def open_reconciled(spark: SparkSession, out: str) -> Refreshed:
    """Tables, quarantined leaves and checks as of the last finished run.

    Cells are named one by one, so filters on year and quarter prune them before any file is opened.
    """
    newest = _manifests(spark, out).newest()
    manifest = _read(spark, newest)
    stored, there = _cells(manifest), Folders(spark, out)

    def table(name: str) -> DataFrame:
        on_disk = set(there.found(f"{name}/run=*/year=*/quarter=*"))  # a cell of unreadable leaves has no folder
        paths = sorted(p for p in map(_folder, (c for c in stored if c[0] == name)) if p in on_disk)
        if not paths:
            return spark.createDataFrame([], table_schema(name))
        base = out.rstrip("/")
        rows = spark.read.schema(table_schema(name)).option("basePath", f"{base}/{name}").parquet(*[f"{base}/{p}" for p in paths])
        return rows.select(*table_columns(name))

    tables = from_tables(spark, {name: table(name) for name in TABLES})
    quarantine = manifest.filter(F.col("reason").isNotNull()).select("rel_path", "reason")
    return Refreshed(tables, quarantine, quality.run_checks(tables))
