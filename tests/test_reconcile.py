"""Refresh by quarter against a full rebuild, and runs that break off at every step."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest

from panelwright.operators import quality
from panelwright.plans import ingest as ingest_job
from panelwright.schemas import TABLES
from panelwright.sources import leaves
from panelwright.sources.folders import Versions
from panelwright.sources.warehouse import from_tables, open_warehouse
from panelwright.streaming import reconcile as job
from panelwright.streaming.reconcile import open_reconciled, reconcile

BASE = "country/india"


class Landing:
    """Leaves of one state and two tables, by quarter."""

    def __init__(self, folder: Path):
        self.root, self.time = folder, 1_600_000_000

    def put(self, kind: str, year: int, quarter: int, value: float, broken: bool = False):
        entry = {"type": "TOTAL", "count": 2, "amount": value}
        body = {
            "user": {"aggregated": {"registeredUsers": value, "appOpens": 1}},
            "transaction": {"transactionData": [{"name": "Bills", "paymentInstruments": [entry]}]},
        }[kind]
        path = self.path(kind, year, quarter)
        path.parent.mkdir(parents=True, exist_ok=True)
        text = json.dumps({"data": body})
        path.write_text(text[: len(text) // 2] if broken else text)
        self.time += 60
        os.utime(path, (self.time, self.time))

    def path(self, kind, year, quarter) -> Path:
        return self.root / "data" / f"aggregated/{kind}/{BASE}/state/reef/{year}/{quarter}.json"


def content(warehouse):
    return {n: sorted(map(tuple, getattr(warehouse, n).collect()), key=repr) for n in TABLES}


def rebuilt(spark, root):
    return content(from_tables(spark, leaves.parse_tables(leaves.read_bodies(spark, str(root)))))


def files(out: Path) -> int:
    return sum(1 for p in out.rglob("*.parquet"))


@pytest.fixture
def landing(tmp_path):
    held = Landing(tmp_path / "in")
    for year in (2020, 2021):
        for quarter in (1, 2, 3, 4):
            held.put("transaction", year, quarter, 10.0 * quarter)
            held.put("user", year, quarter, 5.0 * quarter)
    return held


def test_corrections_follow_the_landing_folder(spark, landing, tmp_path):
    out = tmp_path / "out"
    args = (spark, str(landing.root), str(out))
    first = reconcile(*args)
    assert content(first.warehouse) == rebuilt(spark, landing.root) and first.checks.count() == 7
    untouched = {p: p.stat().st_mtime_ns for p in out.glob("agg_user/run=1/year=2021/**/*.parquet")}

    landing.put("transaction", 2020, 2, 99.0)  # corrected, same length
    landing.path("user", 2020, 3).unlink()  # removed
    landing.put("user", 2020, 4, 20.0)  # touched, same body
    landing.put("transaction", 2022, 1, 7.0)  # new
    landing.put("user", 2021, 1, 5.0, broken=True)
    done = reconcile(*args)
    assert content(done.warehouse) == rebuilt(spark, landing.root)
    assert [r.rel_path.split("/reef/")[1] for r in done.quarantine.collect()] == ["2021/1.json"]
    assert {str(p.relative_to(out)) for p in out.glob("agg_*/run=2/*/*")} == {
        "agg_transaction/run=2/year=2020/quarter=2", "agg_transaction/run=2/year=2022/quarter=1"}
    assert all(p.stat().st_mtime_ns == t for p, t in untouched.items() if p.exists())
    plan = done.warehouse.agg_transaction.filter("year = 2022")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan

    landing.put("user", 2021, 1, 5.0)  # mended
    done = reconcile(*args)
    assert content(done.warehouse) == rebuilt(spark, landing.root) and done.quarantine.isEmpty()


def test_files_do_not_pile_up(spark, landing, tmp_path):
    out = tmp_path / "out"
    reconcile(spark, str(landing.root), str(out))
    sizes = []
    for k in range(5):
        landing.put("transaction", 2020, 1, 50.0 + k)
        done = reconcile(spark, str(landing.root), str(out))
        sizes.append(files(out))
    assert sizes[-1] == sizes[1] and content(done.warehouse) == rebuilt(spark, landing.root)
    before = sorted(out.rglob("*"))
    reconcile(spark, str(landing.root), str(out))  # nothing changed: nothing is written
    assert sorted(out.rglob("*")) == before


@pytest.mark.parametrize("step", ["parse_tables", "publish"])
def test_a_refresh_that_breaks_off_changes_nothing(spark, landing, tmp_path, monkeypatch, step):
    out = tmp_path / "out"
    reconcile(spark, str(landing.root), str(out))
    old = content(open_reconciled(spark, str(out)).warehouse)
    landing.put("transaction", 2020, 1, 77.0)
    landing.path("user", 2021, 4).unlink()

    def fail(*_):
        raise OSError("broken off")

    with monkeypatch.context() as patch:
        patch.setattr(*((job.leaves, "parse_tables", fail) if step == "parse_tables" else (Versions, "publish", fail)))
        with pytest.raises(OSError):
            reconcile(spark, str(landing.root), str(out))
    assert content(open_reconciled(spark, str(out)).warehouse) == old
    assert content(reconcile(spark, str(landing.root), str(out)).warehouse) == rebuilt(spark, landing.root)
    assert len(list((out / "agg_transaction").glob("run=*"))) <= 3


@pytest.mark.parametrize("step", ["write_warehouse", "run_checks", "publish", "tidy"])
def test_an_ingest_that_breaks_off_leaves_the_old_tables(spark, landing, tmp_path, monkeypatch, step):
    out = str(tmp_path / "out")
    ingest_job.ingest(spark, str(landing.root), out, strict=False)
    old = content(open_warehouse(spark, out))
    landing.put("transaction", 2020, 1, 77.0)
    real = {"write_warehouse": (ingest_job, "write_warehouse"), "run_checks": (quality, "run_checks"),
            "publish": (Versions, "publish"), "tidy": (Versions, "tidy")}[step]

    def fail(*args):
        if step == "write_warehouse":  # some of the tables are there
            original(*args)
        raise OSError("broken off")

    original = getattr(*real)
    with monkeypatch.context() as patch:
        patch.setattr(*real, fail)
        with pytest.raises(OSError):
            ingest_job.ingest(spark, str(landing.root), out, strict=False)
    new = rebuilt(spark, landing.root)
    assert content(open_warehouse(spark, out)) == (new if step == "tidy" else old)  # published by then
    done = ingest_job.ingest(spark, str(landing.root), out, strict=False)
    assert content(done.warehouse) == new == content(open_warehouse(spark, out))
    assert len(list(Path(out).glob("version=*"))) == 2


def test_versions(spark, tmp_path):
    held = Versions(spark, str(tmp_path / "v"))
    assert held.newest() is None and held.fresh() == 1
    for k in (1, 2, 9, 10):
        (tmp_path / "v" / f"version={k}").mkdir(parents=True)
        if k != 9:
            held.publish(k)
    assert held.published() == [1, 2, 10] and held.newest().endswith("version=10") and held.fresh() == 11
    held.tidy()
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["version=10", "version=2"]
