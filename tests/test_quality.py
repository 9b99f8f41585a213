from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelwright.operators import quality
from panelwright.plans.ingest import QualityError
from panelwright.sources.warehouse import from_tables, load_counts, open_warehouse, write_warehouse
from tests import fixtures


@pytest.fixture(scope="module")
def clean(spark):
    return fixtures.warehouse(spark, n=4)


def changed(spark, w, edit):
    """The warehouse with its fact table edited."""
    return from_tables(spark, {"agg_transaction": edit(w.agg_transaction), "agg_user": w.agg_user})


def status(w):
    return {r.name: r.status for r in quality.run_checks(w).collect()}


def test_clean_warehouse_passes(clean):
    checks = quality.run_checks(clean)
    assert {r.status for r in checks.collect()} == {quality.PASS}
    assert not quality.has_failures(checks)
    assert list(quality.summary(checks).first()) == [7, 0, 0]
    text = quality.format_report(checks)
    assert "all 7 checks hold" in text and "rows stored: 48" in text and "is 1.000 of the country" in text



@pytest.mark.parametrize("name,edit,expected", [
    ("one_row_per_cell", lambda d: d.unionByName(d.limit(1)), quality.FAIL),
    ("figures_not_negative", lambda d: d.withColumn("txn_amount", F.col("txn_amount") - 6e9), quality.FAIL),
    ("keys_complete", lambda d: d.withColumn("category", F.nullif("category", F.lit("Merchant payments"))), quality.FAIL),
    ("quarter_valid", lambda d: d.withColumn("quarter", F.col("quarter") + 1), quality.FAIL),
    ("facts_present", lambda d: d.limit(0), quality.FAIL),
    ("no_missing_quarters", lambda d: d.filter(~((F.col("geo") == "westland") & (F.col("quarter") == 2))), quality.WARN),
    ("levels_agree", lambda d: d.filter((F.col("level") == "country") | (F.col("geo") == "westland")), quality.WARN),
])
def test_each_check_notices(spark, clean, name, edit, expected):
    assert status(changed(spark, clean, edit))[name] == expected


@pytest.mark.parametrize("edit", [
    lambda d: d, lambda d: d.limit(0), lambda d: d.unionByName(d.limit(2)).withColumn("quarter", F.col("quarter") + 1),
    lambda d: d.withColumns({"txn_amount": F.col("txn_amount") - 6e9, "category": F.nullif("category", F.lit("Merchant payments"))}),
])
def test_figures_observed_while_writing_give_the_same_report(spark, clean, tmp_path, edit):
    seen = write_warehouse(changed(spark, clean, edit), str(tmp_path), {"agg_transaction": quality.row_figures()})
    stored = open_warehouse(spark, str(tmp_path))
    report = quality.run_checks(stored, seen=seen["agg_transaction"])
    def lines(checks):  # sums of doubles depend on their order in the last digit
        return sorted((r.name, r.status, round(r.metric, 9), r.detail) for r in checks.collect())

    assert lines(report) == lines(quality.run_checks(stored))


def test_gaps_by_count_equal_the_missing_cells(spark, clean):
    w = changed(spark, clean, lambda d: d.filter((F.col("geo") != "southland") | (F.col("quarter") == 3)))
    gaps = {r.state: r.missing for r in quality.panel_gaps(w.state_txn_quarter).collect()}
    cells = quality.missing_cells(w.state_txn_quarter)
    assert gaps == {"southland": 3}
    assert {r.state: r["count"] for r in cells.groupBy("state").count().collect()} == gaps


def test_stored_tables_round_trip(spark, tmp_path):
    w = fixtures.warehouse(spark, n=4, districts=False)
    write_warehouse(w, str(tmp_path))
    back = open_warehouse(spark, str(tmp_path))
    assert {r.table_name: r.n_rows for r in load_counts(back).collect()} == {
        "agg_transaction": 48, "agg_user": 12, "map_transaction": 0, "map_user": 0, "top_transaction": 0}
    assert back.agg_transaction.exceptAll(w.agg_transaction).isEmpty()
    assert back.state_txn_quarter.count() == 12
    assert issubclass(QualityError, RuntimeError)
