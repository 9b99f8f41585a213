"""Small warehouses and panels with known growth, generated by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import period_key
from panelwright.functions.periods import from_ord
from panelwright.schemas import CATEGORIES, share_columns
from panelwright.sources.warehouse import Warehouse, from_tables

FIRST = 2019 * 4
GROWTH = 1.06
PLACES = {"northland": 5e9, "southland": 2e9, "westland": 9e8}
WEIGHTS = dict(zip(CATEGORIES[:3], (2.0, 5.0, 0.5)))
TOWNS = ("old town", "new town")


def quarters(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(
        F.col("id").alias("i"), (F.col("id") + FIRST).cast("int").alias("period_ord")
    ).withColumns(from_ord(F.col("period_ord")))


def warehouse(spark: SparkSession, n: int = 15, districts: bool = True, places: dict = PLACES) -> Warehouse:
    """Every place grows by the same factor each quarter; users grow by one step."""
    def each(df: DataFrame, name: str, values) -> DataFrame:
        return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))

    def looked_up(name: str, values: dict):
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
        return F.create_map(*pairs)[F.col(name)]

    base = each(quarters(spark, n), "geo", places).withColumn(
        "amount", looked_up("geo", places) * F.pow(F.lit(GROWTH), "i")
    )
    cells = each(base, "category", WEIGHTS).withColumn(
        "txn_amount", F.col("amount") * looked_up("category", WEIGHTS)
    ).withColumn("txn_count", (F.col("txn_amount") / 1200).cast("bigint"))
    by_state = cells.withColumn("level", F.lit("state"))
    country = cells.groupBy("year", "quarter", "category").agg(
        F.sum("txn_amount").alias("txn_amount"), F.sum("txn_count").alias("txn_count")
    ).withColumns({"level": F.lit("country"), "geo": F.lit("india")})
    step = F.col("i") + 1
    tables = {
        "agg_transaction": by_state.unionByName(country, allowMissingColumns=True),
        "agg_user": base.withColumns({
            "level": F.lit("state"), "registered_users": step * 4000, "app_opens": step * 90000,
        }),
    }
    if districts:
        local = each(base, "district", TOWNS).withColumn("state", F.col("geo"))
        tables["map_transaction"] = local.withColumns({
            "txn_amount": F.col("amount") / 2, "txn_count": (F.col("amount") / 2400).cast("bigint"),
        })
        tables["map_user"] = local.withColumns({
            "district": F.concat("district", F.lit(" district")),
            "registered_users": step * 700, "app_opens": step * 8000,
        })
    return from_tables(spark, tables)


def panel(spark: SparkSession, states: int = 3, n: int = 12) -> DataFrame:
    """A balanced panel with wobbling growth and constant shares."""
    rows = quarters(spark, n).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(states))))
    wobble = 1 + F.pmod(F.xxhash64("s", "i"), F.lit(100)) / 1000
    shares = {c: F.lit(x) for c, x in zip(share_columns(), (0.3, 0.6, 0.05, 0.03, 0.02))}
    return rows.select(
        F.format_string("s%d", "s").alias("state"), "year", "quarter", period_key().alias("period_key"), "period_ord",
        (F.col("s") * 1000 * F.pow(F.lit(1.08), "i")).cast("bigint").alias("txn_count"),
        (F.col("s") * 1e6 * F.pow(F.lit(1.09), "i") * wobble).alias("txn_amount"),
        (F.col("s") * 500 * (F.col("i") + 10)).alias("registered_users"),
        (F.col("s") * 7000 * (F.col("i") + 10)).alias("app_opens"),
        *[v.alias(c) for c, v in shares.items()],
    )
