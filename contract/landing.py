"""Write facts as JSON leaves in the landing layout, so that ingestion can be checked end to end."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.facts import NATION
from panelwright.sources.leaves import COUNTRY
from panelwright.sources.warehouse import Warehouse


def _path(dataset: str, entity: str, geo: Column) -> Column:
    base = f"{dataset}/{entity}/" + ("hover/" if dataset == "map" else "") + f"country/{COUNTRY}"
    place = F.when(geo == NATION, F.lit("")).otherwise(F.concat(F.lit("/state/"), geo))
    return F.concat(
        F.lit(base), place, F.format_string("/%d/%d.json", F.col("year"), F.col("quarter"))
    )


def _metric() -> Column:
    return F.struct(F.lit("TOTAL").alias("type"), F.col("txn_count").alias("count"), F.col("txn_amount").alias("amount"))


def _data(*fields: Column) -> Column:
    return F.to_json(F.struct(F.struct(*fields).alias("data")))


def _agg_transaction(w: Warehouse) -> DataFrame:
    entry = F.struct(F.col("category").alias("name"), F.array(_metric()).alias("paymentInstruments"))
    return w.agg_transaction.groupBy(_path("aggregated", "transaction", F.col("geo")).alias("rel_path")).agg(
        _data(F.collect_list(entry).alias("transactionData")).alias("body")
    )


def _users() -> Column:
    return F.struct(F.col("registered_users").alias("registeredUsers"), F.col("app_opens").alias("appOpens"))


def _agg_user(w: Warehouse) -> DataFrame:
    return w.agg_user.select(
        _path("aggregated", "user", F.col("geo")).alias("rel_path"), _data(_users().alias("aggregated")).alias("body")
    )


def _map_transaction(w: Warehouse) -> DataFrame:
    """District leaves of the states, and national ones that list states and are not loaded."""
    def leaves(df: DataFrame, geo: Column, name: str) -> DataFrame:
        entry = F.struct(F.col(name).alias("name"), F.array(_metric()).alias("metric"))
        return df.groupBy(_path("map", "transaction", geo).alias("rel_path")).agg(
            _data(F.collect_list(entry).alias("hoverDataList")).alias("body")
        )

    return leaves(w.map_transaction, F.col("state"), "district").unionByName(
        leaves(w.state_txn_quarter, F.lit(NATION), "state")
    )


def _map_user(w: Warehouse) -> DataFrame:
    entries = F.map_from_entries(F.collect_list(F.struct("district", _users())))
    return w.map_user.groupBy(_path("map", "user", F.col("state")).alias("rel_path")).agg(
        _data(entries.alias("hoverData")).alias("body")
    )


def _top_transaction(w: Warehouse) -> DataFrame:
    entry = F.struct(F.col("entity_name").alias("entityName"), _metric().alias("metric"))

    def section(name: str, kind: str) -> Column:
        return F.collect_list(F.when(F.col("entity_type") == kind, entry)).alias(name)

    return w.top_transaction.groupBy(_path("top", "transaction", F.col("parent_geo")).alias("rel_path")).agg(
        _data(section("states", "state"), section("districts", "district"), section("pincodes", "pincode")).alias("body")
    )


def _top_user(w: Warehouse) -> DataFrame:
    """Rankings of users: present in the feed, not loaded."""
    return w.agg_user.select(
        _path("top", "user", F.col("geo")).alias("rel_path"), _data(_users().alias("aggregated")).alias("body")
    )


KINDS = {
    "agg_transaction": _agg_transaction,
    "agg_user": _agg_user,
    "map_transaction": _map_transaction,
    "map_user": _map_user,
    "top_transaction": _top_transaction,
    "top_user": _top_user,
}


def leaf_bodies(w: Warehouse, kinds: Sequence[str] = tuple(KINDS)) -> DataFrame:
    out = None
    for kind in kinds:
        part = KINDS[kind](w)
        out = part if out is None else out.unionByName(part)
    return out


def write_leaves(leaves: DataFrame, root: str) -> int:
    """Write each body to ``<root>/data/<rel_path>`` from the tasks; a repeated task writes the same.

    ``root`` has a scheme (see ``session.shared_dir``), so that it means the same to every task.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # this writer knows the object store by another scheme than Spark does
        store, base = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", root))
        for pdf in batches:
            for rel, body in zip(pdf["rel_path"], pdf["body"]):
                target = f"{base.rstrip('/')}/data/{rel}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(body.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return leaves.mapInPandas(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def withdraw(spark: SparkSession, root: str, pattern: str) -> int:
    """Delete the landed leaves that match a glob below ``data``; returns how many."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/{pattern}")
    store = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(store.delete(status.getPath(), False) for status in store.globStatus(glob))


def backdate(spark: SparkSession, root: str, pattern: str, days: int) -> int:
    """Give the landed leaves that match a glob below ``data`` an older file time; returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    glob = jvm.org.apache.hadoop.fs.Path(f"{root}/data/{pattern}")
    store = glob.getFileSystem(conf)
    found = store.globStatus(glob)
    for status in found:
        store.setTimes(status.getPath(), status.getModificationTime() - days * 86_400_000, -1)
    return len(found)
