import math

import numpy as np
import pandas as pd
import pytest
from helpers import wide_panel, long_panel
from pyspark.sql import functions as F

from pairtide.functions.special import two_sided_p
from pairtide.operators import kpis, quality, reports, stats


def test_t_tail_against_known_values():
    # Fixed values from published t tables.
    known = [(12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (2.042272456, 30, 0.05), (1.959963985, 1e9, 0.05), (3.169272673, 10, 0.01)]
    for t, df, p in known:
        assert two_sided_p(np.array([t]), np.array([float(df)]))[0] == pytest.approx(p, rel=1e-6)
    assert two_sided_p(np.array([0.0]), np.array([5.0]))[0] == pytest.approx(1.0)


def test_seed_statistics_and_bootstrap(spark):
    long = spark.createDataFrame([("s1", "m1", "mean", f"r{i}", float(i)) for i in (1, 2, 3)], "scenario string, metric string, stat string, run string, value double")
    row = stats.seed_statistics(long).first()
    assert row["count"] == 3 and row["mean"] == 2.0 and row["std"] == pytest.approx(math.sqrt(2 / 3))
    assert row["ci95"] == pytest.approx(1.96 * math.sqrt(2 / 3) / math.sqrt(3))
    bound = stats.bootstrap_interval(long, ["scenario", "metric", "stat"], "value", "run").first()
    assert 1.0 <= bound.boot_low <= 2.0 <= bound.boot_high <= 3.0 and bound.boot_low < bound.boot_high
    again = stats.bootstrap_interval(long.repartition(3), ["scenario", "metric", "stat"], "value", "run").first()
    assert again == bound
    one = stats.bootstrap_interval(long.limit(1), ["scenario", "metric", "stat"], "value", "run").first()
    assert one.boot_low == one.boot_high
    wide = stats.stats_table(long, "run", resamples=200).first()
    assert wide["mean_mean"] == 2.0 and wide["mean_boot_low"] <= 2.0 and wide["median_mean"] is None


def test_bootstrap_spread_is_right(spark):
    rng = np.random.default_rng(0)
    sample = rng.normal(5, 2, 400)
    rows = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(sample)], "g string, i int, v double")
    bound = stats.bootstrap_interval(rows, ["g"], "v", "i").first()
    half = 1.96 * sample.std() / 20
    assert bound.boot_low == pytest.approx(sample.mean() - half, abs=0.06) and bound.boot_high == pytest.approx(sample.mean() + half, abs=0.06)


def test_pairwise_tests(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(0, 1, 40), "b": rng.normal(0.8, 2, 25), "c": rng.normal(0, 1, 5)}
    frame = pd.DataFrame([(k, float(v)) for k, vs in data.items() for v in vs], columns=["run", "m"])
    got = stats.pairwise_tests(spark.createDataFrame(frame), "run", ["m"]).collect()
    assert [(r.run_a, r.run_b) for r in got] == [("a", "b")]
    a, b = data["a"], data["b"]
    ea, eb = a.var(ddof=1) / 40, b.var(ddof=1) / 25
    assert got[0].t_stat == pytest.approx((a.mean() - b.mean()) / math.sqrt(ea + eb))
    assert got[0].df == pytest.approx((ea + eb) ** 2 / (ea**2 / 39 + eb**2 / 24))
    pooled = math.sqrt((39 * a.var(ddof=1) + 24 * b.var(ddof=1)) / 63)
    assert got[0].cohens_d == pytest.approx((a.mean() - b.mean()) / pooled)
    assert got[0].q_value == pytest.approx(got[0].p_value)


def test_constant_samples_give_no_statistic(spark):
    long = spark.createDataFrame(
        [("m", "mean", s, 1.0) for s in "ab" for _ in range(3)] + [("n", "mean", "a", 1.0), ("n", "mean", "b", 2.0)],
        "metric string, stat string, scenario string, value double",
    )
    rows = stats.welch_by_metric(long).collect()
    assert len(rows) == 2 and all(r.t_stat is None and (r.p_value is None or math.isnan(r.p_value)) for r in rows)


def test_q_values(spark):
    p = [0.01, 0.04, 0.03, 0.5, None]
    tests = spark.createDataFrame([("m", f"t{i}", v) for i, v in enumerate(p)], "metric string, t string, p double")
    got = {r.t: r.q_value for r in stats.q_values(tests, ["metric"], "p").collect()}
    want = {"t0": 0.05, "t1": 0.04 * 5 / 3, "t2": 0.04 * 5 / 3, "t3": 0.5 * 5 / 4, "t4": None}
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_q_values_of_many_tests(spark):
    """Thousands of tests over many ranges, a third of them equal, zeros and ones and missing ones among them, two keys."""
    rng = np.random.default_rng(11)
    values = {"a": np.concatenate([rng.random(2000) ** 6, np.full(1000, 0.03), np.zeros(5), np.ones(5)]), "b": rng.random(3)}
    rows = [(k, float(p)) for k, v in values.items() for p in v] + [("a", None), ("b", None), ("c", None)]
    got = stats.q_values(spark.createDataFrame(rows, "metric string, p double"), ["metric"], "p").collect()
    assert len(got) == len(rows) and all((r.q_value is None) == (r.p is None) for r in got)
    for key, v in values.items():
        order = np.sort(v)
        q = np.minimum.accumulate((order * (len(v) + 1) / np.arange(1, len(v) + 1))[::-1])[::-1]
        want = {}
        for p, x in zip(order, q):
            want[p] = x  # the last of equal ones
        for r in got:
            if r.metric == key and r.p is not None:
                assert abs(r.q_value - want[r.p]) < 1e-12


def test_kpis_choose_columns_per_run(spark):
    frame = pd.DataFrame(
        {"run": ["x"] * 6 + ["y"] * 8 + ["z"] * 2, "t": list(range(6)) + list(range(8)) + [0, 1],
         "reward": [0.01, -0.02, 0.03, 0.01, 0.0, -0.01] + [None] * 10, "mean_abs_matrix": list(np.linspace(1, 2, 16))}
    )
    rows = spark.createDataFrame(frame).withColumn("reward", F.when(~F.isnan("reward"), F.col("reward")))
    got = {r.run: r for r in kpis.kpis(kpis.derive_returns(rows, "run", "t"), "run", "t").collect()}
    assert set(got) == {"x", "y"} and got["x"].returns_column == "reward" and got["y"].returns_column == "mean_abs_matrix_pct_change"
    r = frame.reward[:6]
    grown = (1 + r).cumprod()
    assert got["x"].annualized_return == pytest.approx((1 + r).prod() ** (252 / 6) - 1)
    assert got["x"].sharpe_ratio == pytest.approx(math.sqrt(252) * r.mean() / r.std())
    assert got["x"].max_drawdown == pytest.approx((grown / grown.cummax() - 1).min()) and got["y"].num_points == 7


def test_quality_and_issues(spark):
    wide = wide_panel(rows=30, assets=4, gaps=0.2, odd=False)
    wide["A03"] = 7.0
    panel = long_panel(spark, wide)
    row = quality.quality(panel).first()
    assert not row.duplicate_index and row.monotonic_index and row.zero_variance_assets == ["A03"]
    assert row.missing_ratio == pytest.approx(wide.isna().sum().sum() / wide.size)
    codes = [r.code for r in quality.issues(quality.quality(panel.unionByName(panel))).collect()]
    assert codes == ["repeated_timestamp", "missing_share", "constant_asset"]
    holes = spark.createDataFrame([(i, "x", p) for i, p in enumerate([5.0, 5.0, 5.0, float("nan"), 5.0])] , "ts long, asset string, price double")
    odd = quality.quality(holes).first()
    assert odd.missing_ratio == pytest.approx(0.2) and odd.zero_variance_assets == ["x"]
    many = spark.createDataFrame([(i, f"a{k}", 1.0) for i in range(2) for k in range(9)], "ts long, asset string, price double")
    assert sorted(r.asset for r in quality.issues(quality.quality(many)).collect()) == [f"a{k}" for k in range(9)]
    numbered = panel.withColumn("n", F.monotonically_increasing_id())
    falls = quality.out_of_order(numbered.withColumn("n", -F.col("n")), "n").first()[0]
    assert falls
    described = quality.manifest(panel, source="x").first()
    assert described.row_count == 30 and described.asset_count == 4 and described.step_seconds == 86400.0
    assert described.missing_values == wide.isna().sum().sum()


def test_artifact_contracts(spark):
    stats_table = spark.sql("SELECT 'a' scenario, 'm' metric")
    short = spark.sql("SELECT 'a' scenario, 1.0 mea_boot_low")
    found = quality.artifact_findings(stats_table, short, "p")
    assert sorted(f[1] for f in found) == ["ERROR", "ERROR", "WARN", "WARN"]
    levels = quality.findings_by_level(spark.createDataFrame(found, "path string, level string, message string, details string"))
    assert {r.level: r.findings for r in levels.collect()} == {"ERROR": 2, "WARN": 2}


def test_report_tables(spark):
    table = spark.sql(
        "SELECT * FROM VALUES ('s1', 'mean_abs_matrix', 0.2D, 0.01D, 0.1D, 0.3D), ('s2', 'mean_abs_matrix', 0.4D, 0.02D, 0.3D, 0.5D), "
        "('s1', 'row_sum_std', 1.0D, 0.1D, NULL, NULL) t(scenario, metric, mean_mean, mean_std, mean_boot_low, mean_boot_high)"
    )
    assert [r.scenario for r in reports.scenario_ranking(table, "mean_abs_matrix").collect()] == ["s2", "s1"]
    assert reports.best_scenario(table).first().scenario == "s2"
    assert reports.scenario_names(table).first().scenarios == ["s1", "s2"]
    assert [r.place for r in reports.key_metric_table(table).collect()] == [1, 2, 1]
    assert [r.line for r in reports.interval_lines(table).orderBy("scenario").collect()] == [
        "bootstrap 95% CI [0.1000, 0.3000]", "bootstrap 95% CI [0.3000, 0.5000]"
    ]
    assert "note" in reports.significance_subset(table).columns
    assert reports.run_appendix(spark.sql("SELECT 's' scenario, 3 seed")).first().platform == "n/a"
