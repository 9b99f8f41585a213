from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from panelwright.operators import quality
from panelwright.plans.ingest import QualityError, ingest
from panelwright.sources import leaves
from panelwright.sources.warehouse import open_warehouse
from panelwright.streaming.refresh import open_refreshed, refresh

BASE = "country/india"  # the feed's own folder name


def paid(name, *metrics, key="paymentInstruments"):
    return {"name": name, key: [{"type": "TOTAL", "count": c, "amount": m} for c, m in metrics]}


def ranked(name, metric):
    return {"entityName": name, "metric": metric and {"type": "TOTAL", "count": metric[0], "amount": metric[1]}}


BODIES = {
    f"aggregated/transaction/{BASE}/state/westland/2022/3.json": {
        "transactionData": [paid("Bills", (40, 12.5), (2, 0.5)), {"name": "Fees", "paymentInstruments": None}]},
    f"aggregated/transaction/{BASE}/2022/3.json": {"transactionData": [paid("Bills", (90, 31.25))]},
    f"aggregated/transaction/{BASE}/2018/2.json": {"transactionData": []},
    f"aggregated/user/{BASE}/state/salt & 5% a+b/2022/3.json": {
        "aggregated": {"registeredUsers": 17, "appOpens": 230}, "usersByDevice": None},
    f"aggregated/user/{BASE}/state/reef/2022/3.json": {"aggregated": {}},
    f"aggregated/user/{BASE}/state/bay/2022/3.json": None,
    f"aggregated/insurance/{BASE}/2022/3.json": {},
    f"map/transaction/hover/{BASE}/state/westland/2022/3.json": {"hoverDataList": [paid("harbour", (6, 9.75), key="metric")]},
    f"map/transaction/hover/{BASE}/2022/3.json": {"hoverDataList": [paid("westland", key="metric")]},
    f"map/user/hover/{BASE}/state/westland/2022/3.json": {
        "hoverData": {"old town": {"registeredUsers": 8, "appOpens": 55}, "new town": None}},
    f"top/transaction/{BASE}/2022/3.json": {
        "states": [ranked("reef", (11, 4.5))], "districts": [ranked("harbour", (5, 2.25))], "pincodes": [ranked("90210", None)]},
    f"top/user/{BASE}/2022/3.json": {},
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    for rel, body in BODIES.items():
        path = folder / "data" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"data": body}, indent=1))
    cut = folder / "data" / f"map/user/hover/{BASE}/state/reef/2022/3.json"
    cut.parent.mkdir(parents=True)
    cut.write_text('{"data": {"hoverData": {"cliff": {"appOpens": 1')
    (folder / "data" / "README.txt").write_text("not a leaf")
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_discovery_filters_and_sorts(spark, root):
    found = leaves.discover_files(spark, root, min_year=2020).collect()
    assert len(found) == 11 and all(r.year == 2022 and r.entity in leaves.ENTITIES for r in found)
    keys = [(r.dataset, r.entity, r.level, r.geo) for r in found]
    assert keys == sorted(keys)
    assert {r.dataset for r in leaves.discover_files(spark, root, ["map"]).collect()} == {"map"}
    assert "salt & 5% a+b" in {r.geo for r in found}


@pytest.mark.parametrize("path,ok", [
    (f"top/user/{BASE}/2031/4.json", True),
    (f"map/user/hover/{BASE}/state/x y/2020/2.json", True),
    (f"aggregated/loans/{BASE}/2022/3.json", False),
    (f"top/user/{BASE}/2022/0.json", False),
    (f"bottom/user/{BASE}/2022/3.json", False),
    ("notes/todo.json", False),
])
def test_classification(spark, path, ok):
    df = leaves.classify_paths(spark.createDataFrame([(path,)], "rel_path string"))
    assert (df.count() == 1) == ok


def test_routing(spark, root):
    files = leaves.discover_files(spark, root)
    routed = {r.rel_path for r in leaves.route_files(files).collect()}
    assert f"top/user/{BASE}/2022/3.json" not in routed
    assert f"map/transaction/hover/{BASE}/2022/3.json" not in routed
    assert f"top/transaction/{BASE}/2022/3.json" in routed


def test_parsers(spark, root):
    t = leaves.parse_tables(leaves.read_bodies(spark, root))
    assert rows(t["agg_transaction"]) == [
        ("country", "india", 2022, 3, "Bills", 90, 31.25),
        ("state", "westland", 2022, 3, "Bills", 42, 13.0),
        ("state", "westland", 2022, 3, "Fees", 0, 0.0),
    ]
    assert rows(t["agg_user"]) == [("state", "salt & 5% a+b", 2022, 3, 17, 230)]
    assert rows(t["map_transaction"]) == [("westland", "harbour", 2022, 3, 6, 9.75)]
    assert rows(t["map_user"]) == [("westland", "new town", 2022, 3, 0, 0), ("westland", "old town", 2022, 3, 8, 55)]
    assert rows(t["top_transaction"]) == [
        ("country", "india", "district", "harbour", 2022, 3, 5, 2.25),
        ("country", "india", "pincode", "90210", 2022, 3, 0, 0.0),
        ("country", "india", "state", "reef", 2022, 3, 11, 4.5)]


def test_malformed_leaf_is_listed_and_gives_no_rows(spark, root):
    bad = leaves.quarantine(leaves.read_bodies(spark, root)).collect()
    assert [(r.rel_path, r.reason) for r in bad] == [
        (f"map/user/hover/{BASE}/state/reef/2022/3.json", "PARSE malformed body for map_user")]


def test_unwanted_bodies_are_not_read(spark, root):
    users = leaves.parse_agg_user(leaves.read_bodies(spark, root))
    users.collect()
    plan = users._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 3


def test_ingest_and_light_mode(spark, root, tmp_path):
    done = ingest(spark, root, str(tmp_path / "full"), min_year=2020, strict=False)
    counts = {r.table_name: r.n_rows for r in done.counts.collect()}
    assert counts == {"agg_transaction": 3, "agg_user": 1, "map_transaction": 1, "map_user": 2, "top_transaction": 3}
    light = ingest(spark, root, str(tmp_path / "light"), datasets=["aggregated"], strict=False)
    counts = {r.table_name: r.n_rows for r in light.counts.collect()}
    assert counts["agg_transaction"] == 3 and counts["map_transaction"] == 0 and counts["top_transaction"] == 0
    assert not quality.has_failures(done.checks)
    with pytest.raises(ValueError):
        ingest(spark, root, str(tmp_path / "none"), min_year=2050)


def test_refresh_reads_each_leaf_once(spark, root, tmp_path):
    out, state = str(tmp_path / "tables"), str(tmp_path / "state")
    refresh(spark, root, out, state)
    refresh(spark, root, out, state)
    want = leaves.parse_tables(leaves.read_bodies(spark, root))
    got = open_refreshed(spark, out)
    for name, df in want.items():
        assert rows(getattr(got.warehouse, name)) == rows(df), name
    assert got.warehouse.agg_transaction.filter(F.col("level") == "state").count() == 2
    assert [r.rel_path for r in got.quarantine.collect()] == [f"map/user/hover/{BASE}/state/reef/2022/3.json"]
    assert got.checks.count() == 7


def test_refresh_takes_late_leaves_however_old(spark, tmp_path):
    def land(state, year, when):
        path = tmp_path / "in" / "data" / f"aggregated/user/{BASE}/state/{state}/{year}/1.json"
        path.parent.mkdir(parents=True)
        path.write_text(json.dumps({"data": {"aggregated": {"registeredUsers": year, "appOpens": 1}}}))
        os.utime(path, (when, when))

    now = time.time()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    land("first", 2021, now)
    refresh(*args)
    land("old", 2015, now - 900 * 86_400)
    land("fresh", 2022, now + 60)
    done = refresh(*args)
    assert {r.geo for r in done.warehouse.agg_user.collect()} == {"first", "old", "fresh"}
    plan = done.warehouse.agg_user.filter("year = 2015")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_failed_checks_leave_the_old_tables_in_place(spark, root, tmp_path):
    out = str(tmp_path / "tables")
    ingest(spark, root, out, min_year=2020, strict=False)
    bad = tmp_path / "bad" / "data" / f"aggregated/transaction/{BASE}/2022/3.json"
    bad.parent.mkdir(parents=True)
    bad.write_text(json.dumps({"data": {"transactionData": [paid("Bills", (-1, -2.0))]}}))
    with pytest.raises(QualityError):
        ingest(spark, str(tmp_path / "bad"), out)
    assert open_warehouse(spark, out).agg_transaction.count() == 3
