"""The five fact tables, derived from the order tables of a test folder.

State = nation of the customer, category = order priority, district = market segment,
pincode = customer name; figures are order counts and exact decimal sums.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.schemas import TABLES, table_columns
from panelwright.session import scratch_path
from panelwright.sources.warehouse import Warehouse, open_table, write_table

CATEGORIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NATION = "all"


# Columns read of the order tables; a fixed schema saves a footer job per table.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey bigint",
}


class OrderFacts(Warehouse):
    """Lazy derivations.

    Orders meet customers in one join; the planner broadcasts the customers while they are
    small and merges sorted partitions when not, where adaptive execution splits the partition
    of a customer with very many orders. Everything after the join is combined in the same
    stage, so only one row per nation, quarter and breakdown leaves a task.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _orders(self) -> DataFrame:
        return self.table("orders").select(
            "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("category"),
            F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        )

    @cached_property
    def _customers(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", F.col("n_name").alias("state"))
        return (
            self.table("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("o_custkey"), "state",
                F.lower("c_mktsegment").alias("district"), F.col("c_name").alias("name"),
            )
        )

    @cached_property
    def _sales(self) -> DataFrame:
        return self._orders.join(self._customers, "o_custkey")

    @staticmethod
    def _totals() -> list[Column]:
        """Amounts are summed as decimals, so the double does not depend on the order."""
        return [F.count("*").alias("txn_count"), F.sum("amount").cast("double").alias("txn_amount")]

    @cached_property
    def agg_transaction(self) -> DataFrame:
        """State rows, and country rows rolled up from the already aggregated state rows."""
        grain = ["state", "year", "quarter", "category"]
        cells = self._sales.groupBy(*grain).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
        both = cells.groupingSets([grain, grain[1:]], *grain).agg(
            F.grouping("state").alias("is_total"),
            F.sum("n").alias("txn_count"), F.sum("amount").cast("double").alias("txn_amount"),
        )
        total = F.col("is_total") == 1
        return both.select(
            F.when(total, F.lit("country")).otherwise(F.lit("state")).alias("level"),
            F.when(total, F.lit(NATION)).otherwise(F.col("state")).alias("geo"),
            "year", "quarter", "category", "txn_count", "txn_amount",
        )

    @cached_property
    def agg_user(self) -> DataFrame:
        """Users = customers seen so far; opens = order lines of the quarter.

        Lines are counted per order before the join, which folds a very long order map-side.
        """
        key = F.col("year") * 10 + F.col("quarter")
        new = (
            self._orders.groupBy("o_custkey").agg(F.min(key).alias("key"))
            .join(self._customers, "o_custkey")
            .groupBy("state", "key").agg(F.count("*").alias("new"))
        )
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.count("*").alias("lines")
        )
        opened = (
            self._orders.join(lines, "o_orderkey").join(self._customers, "o_custkey")
            .groupBy("state", key.alias("key")).agg(F.sum("lines").alias("opens"))
        )
        quarters = self._orders.agg(F.collect_set(F.struct("year", "quarter"))).scalar()
        grid = (
            new.select("state").distinct().withColumn("q", quarters)
            .select("state", F.inline("q")).withColumn("key", key)
        )
        so_far = F.sum("new").over(
            Window.partitionBy("state").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        )
        return (
            grid.join(new, ["state", "key"], "left").join(opened, ["state", "key"], "left")
            .select(
                F.lit("state").alias("level"), F.col("state").alias("geo"), "year", "quarter",
                F.coalesce(so_far, F.lit(0)).cast("bigint").alias("registered_users"),
                F.coalesce(F.col("opens"), F.lit(0)).cast("bigint").alias("app_opens"),
            )
        )

    @cached_property
    def map_transaction(self) -> DataFrame:
        cells = self._sales.groupBy("state", "district", "year", "quarter").agg(*self._totals())
        return cells.select(*table_columns("map_transaction"))

    @cached_property
    def map_user(self) -> DataFrame:
        """The distinct count shuffles (place, quarter, customer), which no single place can clog."""
        return self._sales.groupBy("state", "district", "year", "quarter").agg(
            F.count_distinct("o_custkey").alias("registered_users"), F.count("*").alias("app_opens")
        ).withColumn("district", F.concat("district", F.lit(" district")))

    @cached_property
    def top_transaction(self) -> DataFrame:
        """The ten largest entities per parent, kind and quarter.

        One pass over the sales computes all three kinds. The rank filter lets Spark cut each
        task to ten candidates per ranking before the shuffle.
        """
        time = ["year", "quarter"]
        cells = self._sales.groupingSets(
            [["state", *time], ["state", "district", *time], ["state", "name", *time]],
            "state", "district", "name", *time,
        ).agg(F.grouping("district").alias("no_district"), F.grouping("name").alias("no_name"), *self._totals())
        is_district, is_name = F.col("no_district") == 0, F.col("no_name") == 0
        is_state = ~is_district & ~is_name
        entities = cells.select(
            F.when(is_state, F.lit("country")).otherwise(F.lit("state")).alias("parent_level"),
            F.when(is_state, F.lit(NATION)).otherwise(F.col("state")).alias("parent_geo"),
            F.when(is_state, F.lit("state")).when(is_district, F.lit("district")).otherwise(F.lit("pincode"))
            .alias("entity_type"),
            F.when(is_state, F.col("state")).when(is_district, F.col("district")).otherwise(F.col("name"))
            .alias("entity_name"),
            "year", "quarter", "txn_count", "txn_amount",
        )
        best = Window.partitionBy("parent_level", "parent_geo", "entity_type", "year", "quarter").orderBy(
            F.desc("txn_amount"), "entity_name"
        )
        return (
            entities.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= 10).drop("place")
        )


class StoredFacts(Warehouse):
    """The same tables, each stored once when first asked for, by year and quarter.

    The analytics expect stored tables, and some read one several times (say, to find the newest
    quarter). Reading them back keeps pruning of columns and periods.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, facts: Warehouse | None = None):
        self._facts, self._held = facts or OrderFacts(spark, sf_dir), {}
        self._spark, self._path = spark, scratch_path(spark, "facts")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._held:
            write_table(getattr(self._facts, name), self._path, name)
            self._held[name] = open_table(self._spark, self._path, name)
        return self._held[name]


# Rules that take cells out of the facts or spoil them, worded so that any SQL engine reads them.
GONE = "level = 'state' AND (length(geo) * 7 + year * 4 + quarter) % 9 = 0"
THIN = "district = 'machinery' AND length(state) % 2 = 0 AND year > 1992"
TWICE = "category LIKE '1%' AND (year * 4 + quarter) % 11 = 3"
BELOW = "category LIKE '2%' AND (year * 4 + quarter) % 13 = 5"
KEYLESS = "category LIKE '3%' AND (year * 4 + quarter) % 17 = 2"
ODD = "category LIKE '4%' AND (year * 4 + quarter) % 19 = 1"
LOST = "level = 'country' AND year > 1994"


# Cells that are corrected after they were first loaded, and leaves that are withdrawn.
CORRECTED = "year = 1997 AND quarter = 2"
WITHDRAWN = "year = 1996 AND quarter = 1"


class CorrectedFacts(OrderFacts):
    """One quarter's transactions as a correction gives them: every figure doubled."""

    @cached_property
    def agg_transaction(self) -> DataFrame:
        rows = OrderFacts(self.spark, self.sf_dir).agg_transaction.filter(CORRECTED)
        return rows.withColumns({c: F.col(c) * 2 for c in ("txn_count", "txn_amount")})


class ThinnedFacts(Warehouse):
    """Facts with holes: states that miss quarters, and districts with few of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._facts = OrderFacts(spark, sf_dir)

    @property
    def agg_transaction(self) -> DataFrame:
        return self._facts.agg_transaction.filter(f"NOT ({GONE})")

    @property
    def agg_user(self) -> DataFrame:
        return self._facts.agg_user

    @property
    def map_transaction(self) -> DataFrame:
        return self._facts.map_transaction.filter(f"NOT ({THIN})")

    @property
    def map_user(self) -> DataFrame:
        return self._facts.map_user

    @property
    def top_transaction(self) -> DataFrame:
        return self._facts.top_transaction


class DamagedFacts(ThinnedFacts):
    """Holes, and rows that every check but one must find: repeated, negative, keyless, misdated, lost."""

    @property
    def agg_transaction(self) -> DataFrame:
        rows = super().agg_transaction.filter(f"NOT ({LOST})")
        spoilt = {
            "txn_amount": f"CASE WHEN {BELOW} THEN -txn_amount ELSE txn_amount END",
            "category": f"CASE WHEN {KEYLESS} THEN NULL ELSE category END",
            "quarter": f"CASE WHEN {ODD} THEN 7 ELSE quarter END",
        }
        return rows.unionByName(rows.filter(TWICE)).selectExpr(
            *[f"{spoilt.get(c, c)} AS {c}" for c in table_columns("agg_transaction")]
        )
