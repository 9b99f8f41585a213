"""The five fact tables, their views, and how they are stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import period_key
from panelwright.schemas import TABLES, table_schema
from panelwright.sources.folders import Versions


class Warehouse:
    """The five tables as attributes, and the views over them; all lazy."""

    agg_transaction: DataFrame
    agg_user: DataFrame
    map_transaction: DataFrame
    map_user: DataFrame
    top_transaction: DataFrame

    @property
    def state_txn_quarter(self) -> DataFrame:
        return state_txn_quarter(self.agg_transaction)

    @property
    def state_user_quarter(self) -> DataFrame:
        return state_user_quarter(self.agg_user)


@dataclass(frozen=True)
class Tables(Warehouse):
    """A warehouse of given frames."""

    agg_transaction: DataFrame
    agg_user: DataFrame
    map_transaction: DataFrame
    map_user: DataFrame
    top_transaction: DataFrame


def state_txn_quarter(agg_transaction: DataFrame) -> DataFrame:
    """Totals per state and quarter."""
    return (
        agg_transaction.filter(F.col("level") == "state")
        .groupBy(F.col("geo").alias("state"), "year", "quarter")
        .agg(F.sum("txn_count").alias("txn_count"), F.sum("txn_amount").alias("txn_amount"))
        .select("state", "year", "quarter", period_key().alias("period_key"), "txn_count", "txn_amount")
    )


def state_user_quarter(agg_user: DataFrame) -> DataFrame:
    """User figures per state and quarter."""
    return agg_user.filter(F.col("level") == "state").select(
        F.col("geo").alias("state"), "year", "quarter", period_key().alias("period_key"),
        "registered_users", "app_opens",
    )


def from_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Warehouse:
    """A warehouse of the given tables; those not given exist but are empty."""
    return Tables(
        **{
            name: _typed(tables[name], name) if name in tables else spark.createDataFrame([], table_schema(name))
            for name in TABLES
        }
    )


def write_warehouse(warehouse: Warehouse, path: str, watch: Mapping[str, Sequence[Column]] | None = None) -> dict[str, dict]:
    """Replace the stored tables.

    Files are split by quarter so that period filters prune folders. The rebalance hint lets
    adaptive execution join small partitions and split one that holds most of the rows. The
    tables are independent, so their jobs run side by side. Aggregates to ``watch``, by table, are
    taken of the rows as they are written, and returned.
    """
    def put(name: str) -> dict:
        return write_table(getattr(warehouse, name), path, name, (watch or {}).get(name, ()))

    with ThreadPoolExecutor(len(TABLES)) as pool:
        return dict(zip(TABLES, pool.map(put, TABLES)))


def write_table(df: DataFrame, path: str, name: str, watch: Sequence[Column] = ()) -> dict:
    """Store a table; returns the values of the aggregates to ``watch``."""
    rows, seen = df.hint("rebalance", "year", "quarter"), Observation()
    if watch:  # behind the shuffle: a task that is repeated does not count twice
        rows = rows.observe(seen, *watch)
    rows.write.mode("overwrite").partitionBy("year", "quarter").parquet(f"{path.rstrip('/')}/{name}")
    return seen.get if watch else {}


def open_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _typed(spark.read.schema(table_schema(name)).parquet(f"{path.rstrip('/')}/{name}"), name)


def open_warehouse(spark: SparkSession, path: str) -> Warehouse:
    """The stored tables: the newest published version below ``path``, or tables that lie in ``path`` itself."""
    at = Versions(spark, path).newest() or path
    return Tables(**{name: open_table(spark, at, name) for name in TABLES})


def load_counts(warehouse: Warehouse) -> DataFrame:
    """Row count of every table, empty ones included."""
    counts = [
        getattr(warehouse, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name in TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def _typed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema(name)])


