"""JSON leaves laid out by dataset, entity, place, year and quarter.

    <root>/data/aggregated/<entity>/country/<c>[/state/<slug>]/<year>/<q>.json
    <root>/data/map/<entity>/hover/country/<c>[/state/<slug>]/<year>/<q>.json
    <root>/data/top/<entity>/country/<c>[/state/<slug>]/<year>/<q>.json

Everything here is lazy. Path rules are plain columns over the file path, so Spark drops
the files nobody wants while planning the scan, before a single body is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.schemas import TABLES, table_columns

# Dataset families, entities and the country name of national rows.
DATASETS = ("aggregated", "map", "top")
ENTITIES = ("transaction", "user")
COUNTRY = "india"

# Path patterns.
LEAF_PATTERN = r"(\d{4})/([1-4])\.json$"
STATE_PATTERN = r"/state/([^/]+)/\d{4}/[1-4]\.json$"

# Counts arrive in scientific notation, which a BIGINT field would turn into null; they are
# read as DOUBLE and cut to BIGINT afterwards.
_METRIC = "STRUCT<type: STRING, count: DOUBLE, amount: DOUBLE>"
_USERS = "STRUCT<registeredUsers: DOUBLE, appOpens: DOUBLE>"
_RANKED = f"ARRAY<STRUCT<entityName: STRING, metric: {_METRIC}>>"

# Body layouts.
BODIES: dict[str, str] = {
    "agg_transaction": "data STRUCT<transactionData: "
    f"ARRAY<STRUCT<name: STRING, paymentInstruments: ARRAY<{_METRIC}>>>>",
    "agg_user": f"data STRUCT<aggregated: {_USERS}>",
    "map_transaction": f"data STRUCT<hoverDataList: ARRAY<STRUCT<name: STRING, metric: ARRAY<{_METRIC}>>>>",
    "map_user": f"data STRUCT<hoverData: MAP<STRING, {_USERS}>>",
    "top_transaction": f"data STRUCT<states: {_RANKED}, districts: {_RANKED}, pincodes: {_RANKED}>",
}
_CORRUPT = "_corrupt"


# -- paths ---------------------------------------------------------------------

def relative_path(path: Column, root: str) -> Column:
    """Path below ``<root>/data/``, or null for a file elsewhere."""
    prefix = (urlparse(root).path if "://" in root or root.startswith("file:") else root).rstrip("/")
    rest = F.substring_index(path, f"{prefix}/data/", -1)
    return F.when(F.contains(path, F.lit(f"{prefix}/data/")), rest)


def is_leaf(rel: Column) -> Column:
    """Whether a relative path is a leaf of a known dataset and entity."""
    return F.coalesce(rel.rlike(f"^({'|'.join(DATASETS)})/({'|'.join(ENTITIES)})/.*{LEAF_PATTERN}"), F.lit(False))


def classify(rel: Column) -> dict[str, Column]:
    """Typed record of a leaf path, as columns to add."""
    parts = F.split(rel, "/")
    slug = F.regexp_extract(rel, STATE_PATTERN, 1)
    return {
        "dataset": F.get(parts, F.lit(0)),
        "entity": F.get(parts, F.lit(1)),
        "level": F.when(rel.rlike(STATE_PATTERN), F.lit("state")).otherwise(F.lit("country")),
        "geo": F.when(rel.rlike(STATE_PATTERN), slug).otherwise(F.lit(COUNTRY)),
        "year": F.regexp_extract(rel, LEAF_PATTERN, 1).try_cast("int"),
        "quarter": F.regexp_extract(rel, LEAF_PATTERN, 2).try_cast("int"),
    }


def is_routed() -> Column:
    """Whether a classified leaf yields rows: national maps and top/user do not."""
    return (
        (F.col("dataset") == "aggregated")
        | ((F.col("dataset") == "map") & (F.col("level") == "state"))
        | ((F.col("dataset") == "top") & (F.col("entity") == "transaction"))
    )


def target_table() -> Column:
    """Name of the table a routed leaf feeds."""
    prefix = F.when(F.col("dataset") == "aggregated", F.lit("agg")).otherwise(F.col("dataset"))
    return F.concat(prefix, F.lit("_"), F.col("entity"))


def _in_scope(datasets: Sequence[str], min_year: int | None, max_year: int | None) -> Column:
    keep = F.col("dataset").isin(*datasets)
    if min_year is not None:
        keep = keep & (F.col("year") >= min_year)
    if max_year is not None:
        keep = keep & (F.col("year") <= max_year)
    return keep


def classify_paths(paths: DataFrame, column: str = "rel_path") -> DataFrame:
    """Classified records of a frame of relative paths; other paths drop out."""
    return (
        paths.select(F.col(column).alias("rel_path"))
        .filter(is_leaf(F.col("rel_path")))
        .withColumns(classify(F.col("rel_path")))
        .select("dataset", "entity", "level", "geo", "year", "quarter", "rel_path")
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below the landing folder as ``rel_path``; bodies are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(f"{root.rstrip('/')}/data")
    )
    return files.select(relative_path(F.col("path"), root).alias("rel_path"))


def list_details(spark: SparkSession, root: str) -> DataFrame:
    """Routed leaves with the table they feed, their length and file time; bodies are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .load(f"{root.rstrip('/')}/data")
        .select(relative_path(F.col("path"), root).alias("rel_path"), "length", F.col("modificationTime").alias("modified"))
    )
    known = files.filter(is_leaf(F.col("rel_path"))).withColumns(classify(F.col("rel_path"))).filter(is_routed())
    return known.select("rel_path", target_table().alias("table_name"), "year", "quarter", "length", "modified")


def discover_files(
    spark: SparkSession,
    root: str,
    datasets: Sequence[str] = DATASETS,
    min_year: int | None = None,
    max_year: int | None = None,
) -> DataFrame:
    """Known leaves in scope, ordered by dataset, entity, level, place and time."""
    return (
        classify_paths(list_files(spark, root))
        .filter(_in_scope(datasets, min_year, max_year))
        .orderBy("dataset", "entity", "level", "geo", "year", "quarter")
    )


def route_files(files: DataFrame) -> DataFrame:
    return files.filter(is_routed())


# -- bodies --------------------------------------------------------------------

def attach_records(raw: DataFrame, root: str) -> DataFrame:
    """Body plus classified path of the routed leaves of a text scan."""
    # the file path column is URL-encoded, with plus signs left as they are
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (
        raw.withColumn("rel_path", relative_path(path, root))
        .filter(is_leaf(F.col("rel_path")))
        .withColumns(classify(F.col("rel_path")))
        .filter(is_routed())
        .select("rel_path", "dataset", "entity", "level", "geo", "year", "quarter", F.col("value").alias("body"))
    )


def read_bodies(
    spark: SparkSession,
    root: str,
    datasets: Sequence[str] = DATASETS,
    min_year: int | None = None,
    max_year: int | None = None,
) -> DataFrame:
    """One row per routed leaf with its whole body; other datasets' folders are not even listed."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(f"{root.rstrip('/')}/data/{{{','.join(datasets)}}}", wholetext=True)
    )
    return attach_records(raw, root).filter(_in_scope(datasets, min_year, max_year))


def _decoded(bodies: DataFrame, table: str) -> DataFrame:
    """Leaves of one table with the decoded body; malformed ones have a filled _corrupt field."""
    schema = f"{BODIES[table]}, {_CORRUPT} STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    prefix, entity = table.split("_")
    dataset = "aggregated" if prefix == "agg" else prefix
    own = bodies.filter((F.col("dataset") == dataset) & (F.col("entity") == entity))
    return own.withColumn("j", F.from_json("body", schema, options))


def _malformed() -> Column:
    return F.col("j").isNull() | F.col(f"j.{_CORRUPT}").isNotNull()


def _number(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.lit(0.0)).cast(kind)


def _total(metrics: Column, field: str, kind: str) -> Column:
    """Sum of one field over a metric list; a missing list or value counts as zero."""
    values = F.transform(F.coalesce(metrics, F.array()), lambda m: _number(m[field], kind))
    return F.aggregate(values, F.lit(0).cast(kind), lambda total, v: total + v)


def _totals(metrics: Column) -> list[Column]:
    return [
        _total(metrics, "count", "bigint").alias("txn_count"),
        _total(metrics, "amount", "double").alias("txn_amount"),
    ]


def _user_counts(users: str) -> list[Column]:
    return [
        _number(F.col(f"{users}.registeredUsers"), "bigint").alias("registered_users"),
        _number(F.col(f"{users}.appOpens"), "bigint").alias("app_opens"),
    ]


def _sound(bodies: DataFrame, table: str) -> DataFrame:
    return _decoded(bodies, table).filter(~_malformed())


def parse_agg_transaction(bodies: DataFrame) -> DataFrame:
    rows = _sound(bodies, "agg_transaction").withColumn("e", F.explode("j.data.transactionData"))
    return rows.select(
        "level", "geo", "year", "quarter", F.col("e.name").alias("category"),
        *_totals(F.col("e.paymentInstruments")),
    )


def parse_agg_user(bodies: DataFrame) -> DataFrame:
    """One row per leaf; a missing or empty section gives none."""
    rows = _sound(bodies, "agg_user").withColumn("e", F.col("j.data.aggregated"))
    # an empty object decodes to a struct of nulls, as does one naming only other keys
    named = F.json_object_keys(F.get_json_object("body", "$.data.aggregated"))
    return rows.filter(F.coalesce(F.size(named), F.lit(0)) > 0).select(
        "level", "geo", "year", "quarter", *_user_counts("e")
    )


def parse_map_transaction(bodies: DataFrame) -> DataFrame:
    rows = _sound(bodies, "map_transaction").withColumn("e", F.explode("j.data.hoverDataList"))
    return rows.select(
        F.col("geo").alias("state"), F.col("e.name").alias("district"), "year", "quarter",
        *_totals(F.col("e.metric")),
    )


def parse_map_user(bodies: DataFrame) -> DataFrame:
    rows = _sound(bodies, "map_user").select("*", F.explode("j.data.hoverData").alias("district", "e"))
    return rows.select(F.col("geo").alias("state"), "district", "year", "quarter", *_user_counts("e"))


def parse_top_transaction(bodies: DataFrame) -> DataFrame:
    def tagged(section: str, kind: str) -> Column:
        entries = F.coalesce(F.col(f"j.data.{section}"), F.array())
        return F.transform(
            entries,
            lambda e: F.struct(
                F.lit(kind).alias("entity_type"),
                e["entityName"].alias("entity_name"),
                _number(e["metric"]["count"], "bigint").alias("txn_count"),
                _number(e["metric"]["amount"], "double").alias("txn_amount"),
            ),
        )

    sections = F.concat(
        tagged("states", "state"), tagged("districts", "district"), tagged("pincodes", "pincode")
    )
    rows = _sound(bodies, "top_transaction").withColumn("e", F.explode(sections))
    return rows.select(
        F.col("level").alias("parent_level"), F.col("geo").alias("parent_geo"),
        "e.entity_type", "e.entity_name", "year", "quarter", "e.txn_count", "e.txn_amount",
    )


PARSERS = {
    "agg_transaction": parse_agg_transaction,
    "agg_user": parse_agg_user,
    "map_transaction": parse_map_transaction,
    "map_user": parse_map_user,
    "top_transaction": parse_top_transaction,
}


def parse_tables(bodies: DataFrame) -> dict[str, DataFrame]:
    """All five tables; each is a branch that reads only the leaves routed to it."""
    return {name: PARSERS[name](bodies).select(*table_columns(name)) for name in TABLES}


def quarantine(bodies: DataFrame) -> DataFrame:
    """Leaves that could not be decoded, with the reason. They never stop a run."""
    bad = None
    for table in TABLES:
        part = _decoded(bodies, table).filter(_malformed()).select(
            "rel_path", F.lit(f"PARSE malformed body for {table}").alias("reason")
        )
        bad = part if bad is None else bad.unionByName(part)
    return bad
