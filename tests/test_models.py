from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import normalize_name
from panelwright.operators import growth, kmeans, kpis, outliers, panels, segments, signals
from panelwright.operators.features import build_features
from panelwright.plans import reports, service
from panelwright.session import settle
from panelwright.sources import sinks
from tests import fixtures


@pytest.fixture(scope="module")
def signal_rows(spark):
    """Unremarkable rows and one planted outlier."""
    near = [(F.randn(i) * 0.1 + 1).alias(s) for i, s in enumerate(signals.SIGNALS)]
    rows = spark.range(600).select(
        F.format_string("s%d", F.col("id") % 30).alias("state"), F.lit(2020).alias("year"), F.lit(1).alias("quarter"),
        F.col("id").cast("int").alias("period_ord"), F.lit(1.0).alias("txn_amount"), *near,
    )
    odd = F.col("period_ord") == 77
    return settle(rows.withColumns({s: F.when(odd, F.lit(9.0)).otherwise(F.col(s)) for s in signals.SIGNALS}))


def test_planted_outlier_ranks_first(signal_rows):
    scored = signals.anomaly_scores(signal_rows, trees=60).toPandas().sort_values("anomaly_score", ascending=False)
    assert scored.iloc[0].period_ord == 77
    assert scored.anomaly_score.between(0, 1).all()
    assert abs(scored.is_anomaly.mean() - 0.03) < 0.005


def test_scores_do_not_depend_on_partitioning(signal_rows):
    a, b = (
        signals.anomaly_scores(df, trees=20).orderBy("period_ord").toPandas().anomaly_score
        for df in (signal_rows, signal_rows.repartition(9))
    )
    assert np.allclose(a, b, atol=1e-9)


def test_one_sampling_law(signal_rows):
    """A tree takes each row once at most; few trees over many rows, or all rows in every tree."""
    drawn = signals._samples(signal_rows, 600, trees=3, sample=40, seed=1)
    assert drawn.count() == drawn.select("period_ord", "tree").distinct().count()
    assert all(30 <= r["count"] <= 40 for r in drawn.groupBy("tree").count().collect())
    whole = signals._samples(signal_rows, 600, trees=4, sample=600, seed=1)
    assert [r["count"] for r in whole.groupBy("tree").count().collect()] == [600] * 4
    assert signals.anomaly_scores(signal_rows, trees=3, sample=40).agg(F.max("anomaly_score")).first()[0] < 1
    assert signals.anomaly_scores(signal_rows.limit(0)).count() == 0


def test_draws_follow_the_binomial():
    law = signals._binomial(10, 0.3)
    assert np.isclose(law[0], 0.7**10) and np.isclose(law[-1], 1.0) and signals._binomial(3, 1.0) == [0.0, 0.0, 0.0, 1.0]


def brute_silhouette(x, labels, power=1):
    d = ((x[:, None] - x[None]) ** 2).sum(-1) ** (power / 2)
    out = []
    for i, own in enumerate(labels):
        same = (labels == own).sum()
        if same == 1:
            out.append(0.0)
            continue
        a = d[i][labels == own].sum() / (same - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.fixture(scope="module")
def blobs(spark):
    """Profiles in three clear groups of different sizes."""
    columns = segments.profile_columns()
    centre = F.when(F.col("id") < 12, 0.0).when(F.col("id") < 20, 5.0).otherwise(10.0)
    return settle(spark.range(25).select(
        F.format_string("s%02d", "id").alias("state"), *[(centre + F.rand(i)).alias(c) for i, c in enumerate(columns)]
    ))


def test_silhouette_and_choice_of_k(spark, blobs):
    points = settle(segments.standardised(blobs, segments.profile_columns()))
    choice = segments.choose_k(points, 25)
    assert choice.k == 3 and set(choice.scores) == {2, 3, 4, 5, 6}
    found = choice.model.predict(points).toPandas()
    x = np.array(found.features.tolist())
    assert np.isclose(choice.scores[3], brute_silhouette(x, found.prediction.to_numpy()))
    assert np.isclose(choice.squared[3], brute_silhouette(x, found.prediction.to_numpy(), 2))
    assert segments.choose_k(points.limit(2), 2).k == 2
    assert segments.choose_k_table(choice, spark).filter("chosen").first().k == 3


def scattered(spark, n, width=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) + rng.integers(0, 3, n)[:, None] * 1.5
    rows = [(f"s{i}", [float(v) for v in p]) for i, p in enumerate(x)]
    return x, spark.createDataFrame(rows, "state string, features array<double>").repartition(3)


def test_all_fits_in_the_same_passes(spark):
    """Each model is what Lloyd's steps from its own start points give; the cheapest start wins."""
    x, df = scattered(spark, 60)
    begin = kmeans.start_points(df, 4, 3, 42, "state", "features")
    assert begin.shape == (3, 4, 3) and all(len({tuple(p) for p in b}) == 4 for b in begin)
    fits = kmeans.fit_all(df, [2, 3, 4], starts=3)
    for k, model in fits.items():
        ends = []
        for s in range(3):
            c = begin[s, :k]
            for _ in range(300):
                label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
                moved, c = ((new - c) ** 2).sum(), new
                if moved <= 1e-4 * x.var(axis=0).mean():
                    break
            ends.append((((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum(), c))
        cost, c = min(ends, key=lambda e: e[0])
        assert np.isclose(model.cost, cost) and np.allclose(model.centres, c)
        labels = {r.state: r.prediction for r in model.predict(df).collect()}
        want = ((x[:, None] - model.centres[None]) ** 2).sum(-1).argmin(1)
        assert labels == {f"s{i}": int(v) for i, v in enumerate(want)}


def test_starts_do_not_depend_on_the_rows_order(spark):
    _, df = scattered(spark, 40)
    a, b = (kmeans.start_points(d, 3, 2, 7, "state", "features") for d in (df, df.orderBy("state").coalesce(1)))
    assert (a == b).all()
    same = spark.createDataFrame([(f"s{i}", [1.0, 2.0]) for i in range(5)], "state string, features array<double>")
    assert np.allclose(kmeans.fit_all(same, [2], starts=2)[2].cost, 0)


@pytest.mark.parametrize("n, block", [(7, 4096), (36, 10), (1500, 400)])
def test_silhouette_by_blocks(spark, monkeypatch, n, block):
    monkeypatch.setattr(kmeans, "BLOCK", block)
    x, df = scattered(spark, n, seed=n)
    label = F.when(F.col("state") == "s0", 2).when(F.col("features")[0] > 1, 1).otherwise(0)  # s0 is alone
    rows = df.withColumn("prediction", label)
    labels = {r.state: r.prediction for r in rows.collect()}
    want = brute_silhouette(x, np.array([labels[f"s{i}"] for i in range(n)]))
    assert np.isclose(kmeans.silhouette(rows), want)
    assert kmeans.silhouette(df.withColumn("prediction", F.lit(1))) is None


def test_segments_partition_the_states(blobs, monkeypatch):
    monkeypatch.setattr(segments, "state_profiles", lambda panel, **_: blobs)
    found = segments.segment(blobs)
    rows = segments.members(found).collect()
    assert [r.n_states for r in found.clusters.orderBy("cluster").collect()] == [12, 8, 5]
    assert [r.cluster for r in rows] == [0] * 12 + [1] * 8 + [2] * 5
    assert sorted(r.state for r in rows) == [f"s{i:02d}" for i in range(25)] and -1 <= found.silhouette <= 1
    given = segments.segment(blobs, k=2)
    assert given.choice.k == 2 and given.clusters.count() == 2 and -1 <= given.silhouette <= 1
    monkeypatch.setattr(segments, "state_profiles", lambda panel, **_: blobs.limit(1))
    alone = segments.segment(blobs)
    assert alone.choice.k == 0 and alone.silhouette is None and alone.labelled.first().cluster == 0
    assert reports.segment_report(found.clusters, segments.profile_shares()).count() == 3


def test_profiles_use_the_last_four_quarters(spark):
    panel = fixtures.panel(spark)
    got = {r.state: r for r in segments.state_profiles(panel).collect()}
    pdf = panel.toPandas().sort_values("period_ord")
    for state, part in pdf.groupby("state"):
        tail = part.tail(4)
        assert np.isclose(got[state].avg_ticket, (tail.txn_amount / tail.txn_count).mean())
        assert np.isclose(got[state].yoy_growth, (part.txn_amount / part.txn_amount.shift(4) - 1).tail(4).mean())


def test_signals_against_pandas(spark):
    rows = build_features(fixtures.panel(spark))
    got = signals.behaviour_signals(rows).orderBy("state", "period_ord").toPandas()
    pdf = rows.toPandas().sort_values(["state", "period_ord"])
    g = pdf.groupby("state")
    pdf["qoq"] = g.txn_amount.pct_change(fill_method=None)
    pdf["gap"] = pdf.qoq - g.registered_users.pct_change(fill_method=None)
    pdf = pdf.dropna(subset=["qoq"])
    assert np.allclose(got.qoq_amt, pdf.qoq) and np.allclose(got.value_user_gap, pdf.gap)


@pytest.fixture(scope="module")
def insights(spark):
    places = {f"land{i}": 1e9 * (i + 1) for i in range(6)}
    return service.Insights(fixtures.warehouse(spark, places=places))


def test_descriptive_reads(insights):
    w = insights.warehouse
    assert service.meta(w).first()[:] == ("2019Q1", "2022Q3", 6, True)
    mix = service.category_mix(w).collect()
    assert abs(sum(r.pct_value for r in mix) - 100) < 1e-9
    assert abs(sum(r.pct_value for r in service.category_mix(w, 20201).collect()) - 100) < 1e-9
    labels = [r.label for r in service.available_quarters(w).collect()]
    assert labels == sorted(labels) and len(labels) == 15
    now, then = (service.top_states(w, 1, p).first() for p in (None, 20201))
    assert now.state == then.state == "land5" and now.txn_amount != then.txn_amount
    assert [r.quarter_label for r in service.state_history(w, "land1").collect()] == labels
    assert service.state_history(w, "atlantis").count() == 0
    assert [r.state for r in service.states(w).collect()] == [f"land{i}" for i in range(6)]
    yearly = {r.yoy_pct for r in service.state_map_metrics(w).collect()}
    assert yearly == {26.2}
    tile = kpis.quarter_tiles(w.agg_transaction).first()
    assert tile.quarter_label == "2022Q3" and tile.value_qoq_pct == 6.0
    first = kpis.quarter_tiles(w.agg_transaction, 20191).first()
    assert first.value_qoq_pct is None and first.txn_count > 0
    assert service.growth_leaders(w, 3).columns[-1] == "quarters"


def test_map_names(spark, insights):
    names = spark.createDataFrame([("Land and 1 Island",), ("Nowhere",)], "display_name string")
    metrics = spark.createDataFrame(
        [("land-&-1", 1.0, 2.0), ("elsewhere", 1.0, 2.0)], "state string, txn_amount double, yoy_pct double")
    assert [r.display_name for r in service.map_named(metrics, names).collect()] == ["Land and 1 Island"]
    assert spark.range(1).select(normalize_name(F.lit("A&B Islands"))).first()[0] == "aandb"


def test_model_reads(insights, tmp_path):
    ahead = insights.forecast_next_quarter().collect()
    assert len(ahead) == 6 and {r.quarter for r in ahead} == {"2022Q4"} and ahead[0].state == "land5"
    assert insights.forecast_categories(4).count() == 4
    assert insights.forecast_districts(30, "land1").count() == 2
    assert insights.anomalies(5).count() == 5
    clusters = insights.segments().collect()
    assert sorted(r.state for r in clusters) == [f"land{i}" for i in range(6)] and clusters[0].k >= 2
    detail = insights.state_detail("land2").first()
    assert len(detail.history) == 15 and detail.forecast.quarter == "2022Q4" and detail.cluster is not None
    assert 0 < len(detail.anomalies) <= 5
    scores = [a.anomaly_score for a in detail.anomalies]
    assert scores == sorted(scores, reverse=True)
    assert insights.with_forecast("land2").filter("kind = 'forecast'").first().lo is not None
    assert insights.state_detail("atlantis").count() == 0
    sinks.write_json(insights.snapshot(), str(tmp_path / "snapshot"))
    sinks.write_csv(reports.anomaly_report(insights.anomaly_ranking), str(tmp_path / "anomalies"))
    back = insights.warehouse.agg_user.sparkSession.read.json(str(tmp_path / "snapshot"))
    assert {r[0]: r[1] for r in back.groupBy("section").count().collect()} == {
        "meta": 1, "trend": 15, "category_mix": 3, "top_states": 6, "forecast": 6,
        "segments": len(clusters), "map": 6}


def test_one_document_holds_what_the_lines_hold(insights, tmp_path):
    sinks.write_json(insights.document(), str(tmp_path / "document"))
    files = [p for p in (tmp_path / "document").glob("*.json") if p.stat().st_size]
    text, = files[0].read_text().splitlines()
    held, lines = json.loads(text), {}
    for r in insights.snapshot().collect():
        lines.setdefault(r.section, []).append((r.rank, json.loads(r.entry)))
    assert len(files) == 1 and set(held) == set(lines) and held["meta"] == lines["meta"][0][1]
    for name in ("trend", "category_mix", "top_states", "map"):
        assert held[name] == [e for _, e in sorted(lines[name], key=lambda x: (x[0], x[1].get("state", "")))]
    ahead = [{k: v for k, v in e.items() if k not in ("quarter", "model")} for _, e in sorted(lines["forecast"], key=lambda x: x[0])]
    assert held["forecast"] == {"quarter": "2022Q4", "model": "seasonal_yoy", "rows": ahead}
    states = {e["state"]: e for _, e in lines["segments"]}
    assert held["segments"]["k"] == next(iter(states.values()))["k"]
    for cluster in held["segments"]["clusters"]:
        assert cluster["n"] == len(cluster["states"])
        assert all(states[s]["cluster"] == cluster["cluster"] and states[s]["tpu"] == cluster["tpu"] for s in cluster["states"])


def test_sql_style_analytics(spark):
    w = fixtures.warehouse(spark)
    s, u = w.state_txn_quarter, w.state_user_quarter
    assert {r.median_qoq_pct for r in growth.leaders(s).collect()} == {6.0}
    assert growth.leaders(s, min_quarters=15).count() == 0
    assert {r.yoy_value_pct for r in growth.yoy(s).collect()} == {26.2}
    hhi = growth.category_hhi(w.agg_transaction).first().hhi
    assert hhi == round((2**2 + 5**2 + 0.5**2) / 7.5**2, 3)
    lag_use = s.withColumn("txn_count", F.when(F.col("state") == "westland", 1).otherwise(F.col("txn_count")))
    lead = (F.col("state") == "westland") & (F.col("period_key") == 20223)
    lead_growth = lag_use.withColumn("txn_amount", F.when(lead, F.col("txn_amount") * 2).otherwise(F.col("txn_amount")))
    assert [r.state for r in growth.expansion_signals(lead_growth, u).collect()] == ["westland"]
    assert growth.category_outperformance(w.agg_transaction).filter("outperformance_pts != 0").count() == 0
    at = (F.col("state") == "westland") & (F.col("period_key") == 20213)
    jump = s.withColumn("txn_amount", F.when(at, F.col("txn_amount") * 10).otherwise(F.col("txn_amount")))
    assert "spike" in {r.direction for r in outliers.robust_z(
        jump.withColumn("txn_amount", F.col("txn_amount") * (1 + F.rand(1) / 100))).collect()}
    many = fixtures.warehouse(spark, places={f"p{i}": 1e9 for i in range(8)}).state_txn_quarter
    odd = F.when(F.col("state") == "p3", F.col("txn_amount") * 9).otherwise(F.col("txn_amount") * (1 + F.hash("state") % 7 / 100))
    flags = outliers.ticket_iqr(many.withColumn("txn_amount", odd)).collect()
    assert {(r.state, r.flag) for r in flags} >= {("p3", "high")}
    assert panels.state_panel(w).count() == 45
