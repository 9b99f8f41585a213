"""Data-quality checks: PASS, WARN (worth knowing) or FAIL (blocks downstream use)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import over_nonzero
from panelwright.sources.warehouse import Warehouse

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
GRAIN = ["level", "geo", "year", "quarter", "category"]


def _keyless() -> Column:
    out = F.lit(False)
    for key in ("geo", "year", "quarter", "category"):
        out = out | F.col(key).isNull()
    return out


def _negative() -> Column:
    return (F.col("txn_count") < 0) | (F.col("txn_amount") < 0)


def row_figures() -> list[Column]:
    """Figures of the fact table that need no grouping, to be observed while it is written."""
    def total(level: str) -> Column:
        return F.sum(F.when(F.col("level") == level, F.col("txn_amount"))).alias(f"{level}_total")

    return [
        F.count(F.lit(1)).alias("n_rows"), F.count_if(_negative()).alias("negative"),
        F.count_if(_keyless()).alias("null_keys"), F.count_if(~F.col("quarter").between(1, 4)).alias("bad_quarter"),
        total("state"), total("country"),
    ]


def _seen_figures(agg_transaction: DataFrame, seen: Mapping) -> DataFrame:
    """The same row as ``_fact_figures``; only repeated cells are looked for in the table."""
    twice = agg_transaction.groupBy(*GRAIN).agg(F.count("*").alias("copies")).agg(F.count_if(F.col("copies") > 1).alias("dup_groups"))
    states, country = seen.get("state_total") or 0.0, seen.get("country_total") or 0.0
    return twice.withColumns({
        **{c: F.lit(int(seen.get(c) or 0)).cast("bigint") for c in ("n_rows", "negative", "null_keys", "bad_quarter")},
        "level_ratio": F.lit(float(states / country if country else 0.0)),
    })


def _fact_figures(agg_transaction: DataFrame) -> DataFrame:
    """One row with the figures of every check on the fact table.

    Grouping by the grain once serves the uniqueness check and, as sums of per-group sums,
    all the others: one scan, one shuffle of already combined rows.
    """
    groups = agg_transaction.groupBy(*GRAIN).agg(
        F.count("*").alias("copies"),
        F.count_if(_negative()).alias("negative"),
        F.sum("txn_amount").alias("amount"),
    )
    copies = F.col("copies")

    def tally(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, copies)), F.lit(0))

    def total(level: str) -> Column:
        return F.sum(F.when(F.col("level") == level, F.col("amount")))

    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
        tally(_keyless()).alias("null_keys"),
        F.count_if(copies > 1).alias("dup_groups"),
        tally(~F.col("quarter").between(1, 4)).alias("bad_quarter"),
        F.coalesce(over_nonzero(total("state"), total("country")), F.lit(0.0)).alias("level_ratio"),
    )


def panel_gaps(state_txn_quarter: DataFrame) -> DataFrame:
    """States that lack quarters their peers report, with how many.

    Counting beats building the full grid: missing = all quarters - own quarters.
    """
    everyone = state_txn_quarter.agg(F.count_distinct("period_key")).scalar()
    return (
        state_txn_quarter.groupBy("state")
        .agg(F.count_distinct("period_key").alias("own"))
        .select("state", (everyone - F.col("own")).alias("missing"))
        .filter(F.col("missing") > 0)
    )


def missing_cells(state_txn_quarter: DataFrame) -> DataFrame:
    """The missing (state, quarter) cells themselves: grid of states by quarters, anti-joined.

    The quarters form one short array, so the grid is an explode of the distinct states.
    """
    quarters = state_txn_quarter.agg(F.sort_array(F.collect_set("period_key"))).scalar()
    grid = (
        state_txn_quarter.select("state").distinct()
        .withColumn("quarters", quarters)
        .select("state", F.explode("quarters").alias("period_key"))
    )
    return grid.join(state_txn_quarter, ["state", "period_key"], "left_anti")


def run_checks(warehouse: Warehouse, seen: Mapping | None = None, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Seven rows: name, status, metric, detail.

    ``seen`` are the values of ``row_figures`` if they were observed while the fact table was
    written; then only repeated cells and missing quarters are looked for.
    """
    gaps = panel_gaps(warehouse.state_txn_quarter)
    worst = (
        gaps.orderBy(F.desc("missing"), "state").limit(5)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("missing")).alias("m"), "state"))).alias("w"))
        .select(
            F.array_join(
                F.transform("w", lambda g: F.format_string("%s lacks %d", g["state"], -g["m"])), "; "
            )
        )
        .scalar()
    )
    fact = warehouse.agg_transaction
    facts = (_fact_figures(fact) if seen is None else _seen_figures(fact, seen)).withColumns(
        {"gap_states": gaps.agg(F.count("*")).scalar(), "worst": worst}
    )

    def check(name: str, metric: str, ok: Column, otherwise: str, detail: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.when(ok, F.lit(PASS)).otherwise(F.lit(otherwise)).alias("status"),
            F.col(metric).cast("double").alias("metric"),
            detail.alias("detail"),
        )

    def counted(metric: str, unit: str) -> Column:
        return F.format_string(f"{unit}: %d", F.col(metric))

    ratio = F.col("level_ratio")
    gap_text = F.when(F.col("gap_states") == 0, F.lit("every state reports every quarter")).otherwise(
        F.format_string("%d incomplete, worst first: %s", F.col("gap_states"), F.col("worst"))
    )
    rows = F.array(
        check("facts_present", "n_rows", F.col("n_rows") > 0, FAIL, counted("n_rows", "rows stored")),
        check("figures_not_negative", "negative", F.col("negative") == 0, FAIL, counted("negative", "rows below zero")),
        check("keys_complete", "null_keys", F.col("null_keys") == 0, FAIL, counted("null_keys", "rows lacking a key")),
        check("one_row_per_cell", "dup_groups", F.col("dup_groups") == 0, FAIL,
              counted("dup_groups", "cells stored twice")),
        check("quarter_valid", "bad_quarter", F.col("bad_quarter") == 0, FAIL, counted("bad_quarter", "rows outside")),
        check("no_missing_quarters", "gap_states", F.col("gap_states") == 0, WARN, gap_text),
        check("levels_agree", "level_ratio", ratio.between(low, high), WARN,
              F.format_string("sum of states is %.3f of the country", ratio)),
    )
    return facts.select(F.inline(rows))


def summary(checks: DataFrame) -> DataFrame:
    """One row: number of checks, failures and warnings."""
    return checks.agg(
        F.count("*").alias("checks"),
        F.count_if(F.col("status") == FAIL).alias("fail"),
        F.count_if(F.col("status") == WARN).alias("warn"),
    )


def has_failures(checks: DataFrame) -> bool:
    return not checks.filter(F.col("status") == FAIL).isEmpty()


def format_report(checks: DataFrame) -> str:
    """The checks as text, those that need attention first."""
    order = {FAIL: 0, WARN: 1, PASS: 2}
    rows = sorted(checks.collect(), key=lambda r: order[r.status])
    open_ones = [r for r in rows if r.status != PASS]
    head = f"{len(open_ones)} of {len(rows)} checks need attention" if open_ones else f"all {len(rows)} checks hold"
    return "\n".join([head, *(f"  {r.name} {r.status} - {r.detail}" for r in rows)])
