import json

import numpy as np
import pytest
from helpers import indexed_panel, matrix, wide_panel, window_returns
from pyspark.sql import functions as F

from pairtide.config import PairSpec, RoleSpec
from pairtide.operators import features, offline, quality, reports, roles, stats
from pairtide.plans import scenario
from pairtide.sources import prices, runs, sinks
from pairtide.streaming.bars import run_to_end, streaming_bars

SPEC = PairSpec(method="signature", lookback=8)


@pytest.fixture(scope="module")
def wide():
    return wide_panel(rows=40, assets=4, seed=9)


@pytest.fixture(scope="module")
def edges(spark, wide):
    return scenario.rolling_edges(indexed_panel(spark, wide), SPEC)


def frame_of(wide):
    rows = []
    for end in range(8, len(wide)):
        m = matrix(SPEC, window_returns(wide, end - 7, end))
        rows.append({f"sig_o2_{a}_{b}": m.loc[a, b] for a in m for b in m if a < b})
    return rows


def test_top_features_and_vectors(edges, wide):
    rows = frame_of(wide)
    names = sorted(rows[0], key=lambda n: (-np.mean([abs(r[n]) for r in rows]), n))[:3]
    model = features.fit_features(edges, ["end_ts"], features.FeatureSpec(top_k=3))
    assert model.names == names
    got = [r.features for r in model.transform(edges).orderBy("end_ts").collect()]
    np.testing.assert_allclose(got, [[r[n] for n in names] for r in rows], atol=1e-9)
    everything = features.fit_features(edges, ["end_ts"], features.FeatureSpec(top_k=None))
    assert len(everything.names) == 6
    one = everything.select(edges.where("end_pos = 8")).collect()
    assert {r.feature: pytest.approx(r.value) for r in one} == rows[0]


def test_components_match_svd(edges, wide):
    model = features.fit_features(edges, ["end_ts"], features.FeatureSpec(top_k=4, compression="pca", components=2))
    got = np.array([r.features for r in model.transform(edges).orderBy("end_ts").collect()])
    raw = np.array([[r[n] for n in model.names] for r in frame_of(wide)])
    scaled = (raw - raw.mean(0)) / raw.std(0)
    _, _, axes = np.linalg.svd(scaled, full_matrices=False)
    want = scaled @ axes[:2].T
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert features.fit_features(edges, ["end_ts"], features.FeatureSpec(top_k=4, compression="pca")).transform(edges).first().features.__len__() == 2


def test_components_by_iteration(spark):
    """More features than directions, absent values, one constant feature: the long form gives the components of the full matrix."""
    rng = np.random.default_rng(2)
    latent = rng.normal(size=(40, 3)) * [6.0, 3.0, 1.5]
    raw = latent @ rng.normal(size=(3, 28)) + 0.05 * rng.normal(size=(40, 28))
    raw[rng.random(raw.shape) < 0.1] = 0.0
    raw[:, 4] = 2.5
    cells = [(w, f"A{k:02d}", "Z", float(raw[w, k])) for w in range(40) for k in range(28) if raw[w, k] != 0]
    edges = spark.createDataFrame(cells, "w int, asset_i string, asset_j string, value double")
    model = features.fit_features(edges, ["w"], features.FeatureSpec(top_k=None, compression="pca", components=3))
    got = np.array([r.features for r in model.transform(edges).orderBy("w").collect()])
    deviation = raw.std(0)
    scaled = np.where(deviation > 1e-12, (raw - raw.mean(0)) / np.where(deviation > 1e-12, deviation, 1), 0.0)
    _, sizes, axes = np.linalg.svd(scaled, full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs(scaled @ axes[:3].T), atol=1e-5)
    np.testing.assert_allclose(model.variances, sizes[:3] ** 2 / 40, rtol=1e-6)
    fresh = edges.where("w < 2")
    np.testing.assert_allclose([r.features for r in model.transform(fresh).orderBy("w").collect()], got[:2], atol=1e-9)


def test_feature_settings():
    assert features.FeatureSpec.from_dict({}) == features.FeatureSpec()
    assert features.FeatureSpec.from_dict({"top_k": None, "orders": 3, "min_magnitude": 1, "compression": None, "sig_method": "levy"}) == features.FeatureSpec(
        orders=(3,), top_k=None, min_magnitude=1.0, signature_form="levy"
    )
    spec = features.FeatureSpec.from_dict({"orders": [2, 3], "top_k": 12, "compression": {"method": "pca", "n_components": 6}})
    assert spec.orders == (2, 3) and spec.components == 6
    with pytest.raises(ValueError):
        features.FeatureSpec(orders=(1,))
    with pytest.raises(ValueError):
        features.FeatureSpec(compression="autoencoder")


def test_pair_settings():
    spec = PairSpec.from_dict({"method": "ccf_auc", "lookback": 30, "ccf_auc": {"max_lag": 5, "correlation_method": "kendall"}})
    assert (spec.max_lag, spec.correlation, spec.lookback) == (5, "kendall", 30)
    for bad in ({"method": "dtw"}, {"method": "x"}, {"correlation": "x"}, {"lookback": 1}, {"update_freq": 0}, {"signature_form": "x"}):
        with pytest.raises(ValueError):
            PairSpec(**bad)
    with pytest.raises(ValueError):
        RoleSpec(top_percentile=101)
    with pytest.raises(ValueError):
        RoleSpec.from_dict({"method": "cluster"})


def test_roles_follow_percentiles(edges, wide):
    spec = RoleSpec(75, 25)
    got = {}
    for r in roles.roles(edges, ["end_pos"], spec).collect():
        got.setdefault((r.end_pos, r.role), set()).add(r.asset)
    for end in range(8, len(wide)):
        sums = matrix(SPEC, window_returns(wide, end - 7, end)).sum(axis=1)
        sums = sums[sums != 0]
        hi, lo = np.percentile(sums, 75), np.percentile(sums, 25)
        assert got.get((end, "leader"), set()) == set(sums.index[sums > hi])
        assert got.get((end, "follower"), set()) == set(sums.index[sums < lo])
    pairs = roles.role_pairs(roles.roles(edges, ["end_pos"], RoleSpec()), ["end_pos"])
    assert pairs.groupBy("end_pos").count().agg(F.max("count")).first()[0] == 2


def test_price_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,B,A\n2024-01-02,2.5,\n2024-01-01,1,3\n")
    got = {(str(r.ts), r.asset): r.price for r in prices.read_prices(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {("2024-01-02 00:00:00", "B"): 2.5, ("2024-01-01 00:00:00", "B"): 1.0, ("2024-01-01 00:00:00", "A"): 3.0}
    (tmp_path / "daily_prices_b.csv").write_text("x,A\n2024-01-01,1\n")
    missing = str(tmp_path / "none.csv")
    assert prices.find_price_file(spark, missing, str(tmp_path)).endswith("daily_prices_b.csv")
    assert prices.find_price_file(spark, missing, str(tmp_path / "no")) is None
    assert prices.read_prices(spark, str(tmp_path / "daily_prices_b.csv")).first().asset == "A"
    (tmp_path / "h.csv").write_text("date,datetime,A\n2024-01-01 00:00:00,x,\n2024-01-01 01:00:00,x,4\n2024-01-01 02:00:00,x,\n")
    assert [r.price for r in prices.read_hourly(spark, str(tmp_path / "h.csv"), fill=True).orderBy("ts").collect()] == [4.0, 4.0]
    assert prices.read_hourly(spark, str(tmp_path / "h.csv")).count() == 1
    (tmp_path / "u.csv").write_text(',date,symbols\n0,2024-01,"A, B, A"\n')
    assert prices.read_universe(spark, str(tmp_path / "u.csv")).first().symbols == ["A", "B", "A"]
    (tmp_path / "t.csv").write_text("date,tbill\n1/2/2021,0.0009\n")
    assert str(prices.read_rates(spark, str(tmp_path / "t.csv")).first().date) == "2021-01-02"
    walk = prices.synthetic_prices(spark)
    assert walk.count() == 900 and walk.exceptAll(prices.synthetic_prices(spark)).count() == 0
    assert abs(walk.agg(F.avg("price")).first()[0] - 100) < 1


def test_run_tree(spark, tmp_path):
    for name, mean in (("x_seed1_2024", 0.2), ("x_seed22_2024", 0.4), ("y_run", 0.3)):
        folder = tmp_path / "runs" / name
        folder.mkdir(parents=True)
        (folder / "summary.csv").write_text(f"metric,mean,median,std,max,min\nmean_abs_matrix,{mean},0.1,0.1,0.5,\n")
        meta = {"config_path": "/c/fixed_30.yaml", "git": {"git_commit": None if mean == 0.4 else "abc"}, "env": {"platform": "p"}}
        (folder / "run_metadata.json").write_text(json.dumps(meta, indent=1) if mean != 0.3 else "{broken")
    (tmp_path / "runs" / "x_seed1_2024" / "metrics_timeseries.csv").write_text("date,mean_abs_matrix\n2024-01-01,0.1\n")
    agg = tmp_path / "runs" / "deep" / "x_aggregate"
    agg.mkdir(parents=True)
    (agg / "stats.csv").write_text("scenario,metric,count,mean_mean\nx,mean_abs_matrix,2,0.3\n")
    root = str(tmp_path / "runs")
    summaries = runs.read_summaries(spark, root)
    assert {r.run: r.seed for r in summaries.collect()} == {"x_seed1_2024": 1, "x_seed22_2024": 22, "y_run": None}
    assert runs.read_metric_series(spark, root).first().run == "x_seed1_2024"
    assert runs.read_aggregate_stats(spark, root).first().aggregate_dir == "x_aggregate"
    meta = {r.run: r for r in runs.read_metadata(spark, root).collect()}
    assert meta["x_seed1_2024"].scenario == "fixed_30" and meta["y_run"].git_commit is None
    joined = reports.with_metadata(stats.run_means(summaries, "run", ["mean_abs_matrix"]), runs.read_metadata(spark, root))
    assert {r.run: r.mean_abs_matrix for r in joined.collect()}["x_seed22_2024"] == 0.4
    files = runs.run_files(spark, root)
    found = quality.run_findings(files.where(runs.is_run(F.col("run"))), runs.read_metadata(spark, root)).collect()
    assert {("x_seed22_2024", "metrics_timeseries.csv"), ("x_seed22_2024", "git_commit")} <= {(r.run, r.subject) for r in found}
    assert reports.run_overview(summaries).first()["mean"] in ("0.2", "0.3", "0.4")
    assert reports.latest_runs(summaries).count() == 3
    both = runs.union_by_name([summaries.select("run"), summaries.select("run", "mean")])
    assert both.columns == ["run", "mean"] and both.count() == 6
    both_sides = stats.long_statistics(summaries.withColumn("scenario", F.lit("x")), ["scenario", "run"])
    assert both_sides.where("stat = 'min'").first().value is None


def test_sinks_and_cloning(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(e, s, [float(a) + float(rng.normal(0, 0.05)), 0.5], int(a), 1.0, False, 9) for e in range(4) for s, a in enumerate(rng.integers(0, 3, 60))]
    log = spark.createDataFrame(rows, "episode int, step int, observation array<float>, action int, reward double, done boolean, lookback int")
    sinks.write_transitions(log, str(tmp_path / "log"), {"seed": 1})
    back = runs.read_transitions(spark, str(tmp_path / "log" / "transitions"))
    assert back.count() == 240
    split = offline.stratified_split(back, 0.25)
    share = split.groupBy("action").agg(F.avg(F.col("is_test").cast("int")).alias("s"))
    assert all(abs(r.s - 0.25) < 0.03 for r in share.collect())
    assert offline.clone_behaviour(back).first().accuracy > 0.9
    assert offline.episode_totals(back).agg(F.sum("total_reward")).first()[0] == 240
    assert offline.reward_gap(spark.sql("SELECT 'other' metric, 1.0D mean"), offline.episode_totals(back)).count() == 0
    metrics = spark.sql("SELECT 'r1' run_id, 1.0D v")
    sinks.write_run(metrics, metrics, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "summary")).first().run_id == "r1"
    tests = spark.sql("SELECT 'm' metric, 0.01D q_value, -0.5D cohens_d UNION ALL SELECT 'm', 0.2D, 1.0D")
    sinks.write_pairs(tests, str(tmp_path / "pairs"))
    assert spark.read.csv(str(tmp_path / "pairs" / "significant_pairs"), header=True).count() == 1
    sinks.write_manifest(tests.limit(1), str(tmp_path))
    assert spark.read.json(str(tmp_path / "data_manifest")).count() == 1


def test_runs_of_a_folder_stay(spark, tmp_path):
    """A second run does not touch the first; a run written again is replaced; aggregates are no runs."""
    folder = str(tmp_path / "results")
    for run, value in (("a_seed3_x", 1.0), ("b_x", 2.0), ("a_aggregate", 9.0), ("a_seed3_x", 5.0)):
        table = spark.createDataFrame([(run, "m", value)], "run_id string, metric string, mean double")
        about = spark.createDataFrame([(run, None, "abc")], "run_id string, data_price_hash string, git_commit string")
        sinks.write_run(table, table, folder, metadata=None if run == "b_x" else about)
    for name in (runs.SUMMARY_TABLE, runs.SERIES_TABLE):
        assert {(r.run, r["mean"], r.seed) for r in runs.read_run_table(spark, folder, name).collect()} == {("a_seed3_x", 5.0, 3), ("b_x", 2.0, None)}
    assert runs.read_run_table(spark, folder, runs_only=False).count() == 3
    assert [(r.run, r.git_commit) for r in runs.read_run_metadata(spark, folder).collect()] == [("a_seed3_x", "abc")]
    files = runs.table_files(spark, folder).where(runs.is_run(F.col("run")))
    found = {tuple(r) for r in quality.run_findings(files, runs.read_run_metadata(spark, folder)).collect()}
    assert found == {("b_x", "ERROR", "no_file", "run_metadata.json"), ("a_seed3_x", "WARN", "no_value", "data_price_hash")}
    sinks.write_run(table, table, str(tmp_path / "csv"), "csv")
    assert runs.read_run_table(spark, str(tmp_path / "csv"), fmt="csv").first()["mean"] == 5.0


def test_event_log(spark):
    rows = [(9, 2, "b", 1.0, 5), (9, 2, "a", 2.0, 4), (9, 1, "b", 3.0, 7), (7, 3, "c", None, 1), (None, 1, "a", 1.0, 2), (7, None, "a", 1.0, 3)]
    events = spark.createDataFrame(rows, "u int, h int, k string, v double, id int").withColumn("t", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, h)"))
    log = {(r.episode, r.step): r for r in offline.logged_events(events, "u", "t", "id", "k", "v").collect()}
    assert sorted(log) == [(7, 0), (9, 0), (9, 1), (9, 2)]
    assert log[9, 0].observation == [0.0, -1.0, 0.0, 0.0] and log[9, 0].action == 1 and not log[9, 0].done
    assert log[9, 1].observation == [3.0, 1.0, 1.0, 1.0] and log[9, 1].reward == 2.0
    assert log[9, 2].observation == [2.0, 0.0, 0.0, 2.0] and log[9, 2].done and log[7, 0].done


def test_manifest_hash(spark, tmp_path):
    import hashlib

    (tmp_path / "f.csv").write_text("date,A\n2024-01-01,1\n2024-01-02,2\n")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f.csv"))
    row = quality.manifest(prices.read_prices(spark, str(tmp_path / "f.csv")), files, "f.csv").first()
    assert row.source_hash_sha256 == hashlib.sha256((tmp_path / "f.csv").read_bytes()).hexdigest()
    assert row.source_size_bytes == (tmp_path / "f.csv").stat().st_size


def test_stream_equals_batch(spark, tmp_path):
    from pairtide.operators.bars import resample

    ticks = spark.sql(
        "SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id / 3 AS INT)) ts, concat('A', id % 3) asset, CAST(id AS DOUBLE) price FROM range(900)"
    )
    ticks.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), "6 hours", "0 seconds")
    got = run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    want = resample(ticks, "6 hours", method="mean")
    rows = {(str(r.ts), r.asset): r.price for r in got.collect()}
    assert len(rows) > 100 and rows == {(str(r.ts), r.asset): r.price for r in want.collect()}


def test_overview_keeps_the_exponent(spark):
    values = [1.5e-10, 1.23456e10, 357.0, 0.0, 100000.0, 0.5, -2.0e20]
    rows = spark.createDataFrame([(f"r{i}", "m", v) for i, v in enumerate(values)], "run string, metric string, mean double")
    shown = [r["mean"] for r in reports.run_overview(rows).collect()]
    assert shown == ["%.6g" % v for v in values]


# the last test of this file: it deletes what the session staged
def test_panels_follow_their_files(spark, tmp_path):
    """A derived panel is built once, again after its files changed, and again after the staged tables were cleared."""
    from pairtide.plans import panels

    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' ts, 'a' event_type, CAST(id AS DOUBLE) value FROM range(4)")
    events.write.parquet(str(tmp_path / "events.parquet"))
    first = panels.event_6h(spark, str(tmp_path))
    assert panels.event_6h(spark, str(tmp_path)) is first and first.first().price == 2.5
    events.where("value > 1").write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert panels.event_6h(spark, str(tmp_path)).first().price == 3.5
    panels.forget_staged(spark)
    assert panels.event_6h(spark, str(tmp_path)).first().price == 3.5
