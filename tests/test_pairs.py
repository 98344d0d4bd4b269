import numpy as np
import pandas as pd
import pytest
from helpers import edge_dict, indexed_panel, matrix, wide_panel, window_returns
from pyspark.sql import functions as F

from pairtide.config import PairSpec, RoleSpec
from pairtide.functions import measures
from pairtide.operators import roles, metrics, pairs, timeline, windows
from pairtide.plans import scenario

SPECS = [
    PairSpec(lookback=9, lag=1),
    PairSpec(lookback=9, lag=2, correlation="squared_pearson"),
    PairSpec(lookback=9, correlation="spearman"),
    PairSpec(lookback=9, correlation="kendall"),
    PairSpec(lookback=9, correlation="distance"),
    PairSpec(lookback=13, correlation="mutual_information"),
    PairSpec(lookback=9, method="ccf_auc", max_lag=3),
    PairSpec(lookback=9, method="ccf_at_max_lag", max_lag=3, correlation="spearman"),
    PairSpec(lookback=9, method="signature", signature_form="levy"),
    PairSpec(lookback=9, method="signature", scaling="by_std"),
    PairSpec(lookback=5, method="ccf_auc", max_lag=7),
]


@pytest.fixture(scope="module")
def wide():
    frame = wide_panel()
    frame.iloc[10:40, 4] = np.nan  # an asset that is absent from whole windows
    return frame


@pytest.fixture(scope="module")
def indexed(spark, wide):
    return indexed_panel(spark, wide)


def brute(spec, wide, step=1):
    found = {}
    for end in range(spec.lookback, len(wide), step):
        start = end - spec.lookback + 1
        m = matrix(spec, window_returns(wide, start, end))
        found.update({(start, end, a, b): m.loc[a, b] for a in m for b in m if a < b})
    return found


def assert_same(got, want):
    assert got.keys() == want.keys()
    worst = max(abs(got[k] - want[k]) for k in want)
    assert worst < 1e-9, worst


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"{s.method}-{s.correlation}-{s.lookback}")
def test_edges_match_definition(spec, wide, indexed):
    win = windows.rolling_windows(timeline.calendar(indexed), spec)
    assert_same(edge_dict(pairs.pair_edges(indexed, win, spec).collect()), brute(spec, wide))


def test_tiling_does_not_change_values(indexed):
    spec = SPECS[0]
    win = windows.rolling_windows(timeline.calendar(indexed), spec)
    whole = edge_dict(pairs.pair_edges(indexed, win, spec).collect())
    tiled = edge_dict(pairs.pair_edges(indexed, win, spec, stretch=10, block=1).collect())
    assert_same(tiled, whole)
    spec3 = PairSpec(lookback=9, update_freq=4)
    win3 = windows.rolling_windows(timeline.calendar(indexed), spec3)
    assert {k[1] for k in edge_dict(pairs.pair_edges(indexed, win3, spec3).collect())} == set(range(9, 60, 4))


def test_batch_of_windows_equals_single_windows(spark, indexed, wide):
    spec = SPECS[0]
    asked = spark.createDataFrame([(3, 7), (5, 20), (5, 8), (0, 59)], "start_pos int, end_pos int")
    got = edge_dict(pairs.pair_edges(indexed, asked, spec).collect())
    for start, end in ((3, 7), (5, 20), (5, 8), (0, 59)):
        m = matrix(spec, window_returns(wide, start, end))
        for a in m:
            for b in m:
                if a < b:
                    assert got[(start, end, a, b)] == pytest.approx(m.loc[a, b], abs=1e-9)
    assert pairs.pair_edges(indexed, asked.where("false"), spec).count() == 0


def test_explicit_windows_by_timestamp(spark, indexed):
    cal = timeline.calendar(indexed)
    asked = spark.sql(
        "SELECT timestamp_ntz'2023-12-25 00:00:00' start_ts, timestamp_ntz'2024-01-05 12:00:00' end_ts UNION ALL "
        "SELECT timestamp_ntz'2024-01-03 00:00:00', timestamp_ntz'2024-01-03 00:00:00' UNION ALL "
        "SELECT timestamp_ntz'2025-01-03 00:00:00', timestamp_ntz'2025-02-03 00:00:00'"
    )
    got = {(r.start_pos, r.end_pos) for r in windows.explicit_windows(cal, asked).collect()}
    assert got == {(0, 4), (2, 2)}


def test_universe_limits_windows(spark, indexed, wide):
    spec = SPECS[0]
    win = windows.rolling_windows(timeline.calendar(indexed), spec)
    members = win.select("end_pos", F.explode(F.array(F.lit("A00"), F.lit("A02"), F.when(F.col("end_pos") % 2 == 0, F.lit("A03")))).alias("asset"))
    got = edge_dict(pairs.pair_edges(indexed, win, spec, members.where("asset IS NOT NULL"), stretch=16, block=2).collect())
    full = brute(spec, wide)
    want = {k: v for k, v in full.items() if {k[2], k[3]} <= ({"A00", "A02", "A03"} if k[1] % 2 == 0 else {"A00", "A02"})}
    assert_same(got, want)


def reference_metrics(spec, wide):
    rows, before = [], None
    for end in range(spec.lookback, len(wide)):
        m = matrix(spec, window_returns(wide, end - spec.lookback + 1, end)).to_numpy()
        off = ~np.eye(len(m), dtype=bool)
        sums = m.sum(axis=1)
        stable = (np.nan, np.nan) if before is None else (np.corrcoef(m[off], before[off])[0, 1], np.corrcoef(sums, before.sum(axis=1))[0, 1])
        rows.append([end, np.abs(m[off]).mean(), np.abs(m[off]).max(), np.ptp(sums), sums.std(), *stable, len(m)])
        before = m
    return pd.DataFrame(rows, columns=["end_pos", *metrics.WINDOW_METRICS]).set_index("end_pos")


def test_metrics_both_ways(indexed, wide):
    spec = SPECS[0]
    want = reference_metrics(spec, wide)
    fused = metrics.rolling_metrics(indexed, spec).toPandas().set_index("end_pos").sort_index()[list(metrics.WINDOW_METRICS)]
    np.testing.assert_allclose(fused.to_numpy(dtype=float), want.to_numpy(dtype=float), atol=1e-9)
    win = windows.rolling_windows(timeline.calendar(indexed), spec)
    edges = pairs.pair_edges(indexed, win, spec, block=2).withColumn("seq", F.col("end_pos") - spec.lookback)
    stored = metrics.edge_metrics(edges, [], "seq").toPandas().set_index("seq").sort_index()[list(metrics.WINDOW_METRICS)]
    np.testing.assert_allclose(stored.to_numpy(dtype=float), want.to_numpy(dtype=float), atol=1e-9)
    summary = metrics.summarize(metrics.rolling_metrics(indexed, spec)).toPandas().set_index("metric")
    assert summary.loc["mean_abs_matrix", "std"] == pytest.approx(want.mean_abs_matrix.std())
    assert summary.loc["stability_matrix_corr", "median"] == pytest.approx(want.stability_matrix_corr.median())
    assert np.isnan(summary.loc["stability_matrix_corr", "max"]) and summary.loc["n_assets", "min"] == 5


def test_several_lookbacks_in_one_pass(indexed):
    spec = SPECS[0]
    both = metrics.rolling_metrics(indexed, spec, (7, 9)).toPandas()
    for n in (7, 9):
        one = metrics.rolling_metrics(indexed, spec.with_lookback(n)).toPandas().sort_values("end_pos").reset_index(drop=True)
        part = both[both.lookback == n].sort_values("end_pos").reset_index(drop=True)
        pd.testing.assert_frame_equal(part, one, check_exact=False, atol=1e-9)


def test_scores_sum_to_zero(indexed):
    edges = scenario.rolling_edges(indexed, SPECS[0])
    total = metrics.row_scores(edges, ["end_pos"]).groupBy("end_pos").agg(F.sum("score").alias("s"))
    assert total.agg(F.max(F.abs("s"))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        metrics.row_scores(edges, ["end_pos"], "max")


def test_future_rows_leave_past_windows_alone(spark, wide):
    spec = SPECS[0]
    whole = metrics.rolling_metrics(indexed_panel(spark, wide), spec).where("end_pos < 40").toPandas().sort_values("end_pos")
    cut = metrics.rolling_metrics(indexed_panel(spark, wide.iloc[:40]), spec).toPandas().sort_values("end_pos")
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), cut.reset_index(drop=True), check_exact=False, atol=1e-12)


def test_column_measures_agree_with_tiles(indexed):
    cal = timeline.calendar(indexed)
    cases = [
        (PairSpec(lookback=9), lambda x, y: measures.ccf_at_lag(x, y, 1)),
        (PairSpec(lookback=9, correlation="squared_pearson"), lambda x, y: measures.ccf_at_lag(x, y, 1, measures.squared_pearson)),
        (PairSpec(lookback=9, correlation="spearman"), lambda x, y: measures.ccf_at_lag(x, y, 1, measures.spearman)),
        (PairSpec(lookback=9, method="ccf_auc", max_lag=2), lambda x, y: measures.ccf_auc(x, y, 2)),
        (PairSpec(lookback=9, method="ccf_at_max_lag", max_lag=2), lambda x, y: measures.ccf_at_max_lag(x, y, 2)),
        (PairSpec(lookback=9, method="signature", signature_form="levy"), lambda x, y: measures.signed_area(x, y, levy=True)),
    ]
    win = windows.rolling_windows(cal, PairSpec(lookback=9, update_freq=10))
    arrays = pairs.window_returns(indexed, win)
    for spec, measure in cases:
        own = pairs.pair_measure(arrays, ["start_pos", "end_pos"], measure, block=2)
        assert_same(edge_dict(own.collect()), edge_dict(pairs.pair_edges(indexed, win, spec).collect()))


def with_previous(win):
    """Windows of changing length, each after the one before it in ``seq``."""
    before = win.select((F.col("seq") + 1).alias("seq"), F.col("start_pos").alias("prev_start_pos"), F.col("end_pos").alias("prev_end_pos"))
    return win.join(before, "seq", "left")


@pytest.mark.parametrize("mode", ["common", "strict"])
@pytest.mark.parametrize("restricted", [False, True])
def test_tile_sums_equal_edges(spark, indexed, mode, restricted):
    """Universe, previous window of another length, several tiles: sums taken in the tile equal those of stored edges."""
    spec = SPECS[0]
    rows = [(k, max(0, end - (6 + (k * 5) % 7)), end) for k, end in enumerate(range(12, 60, 2))]
    win = spark.createDataFrame(rows, "seq int, start_pos int, end_pos int")
    members = None
    if restricted:
        listed = [(end, a) for k, _, end in rows for a in ["A00", "A01", "A02", "A03", "A04"][k % 4 // 2 : 5 - k // 8 % 2]]
        members = spark.createDataFrame(listed, "end_pos int, asset string")
    edges = pairs.pair_edges(indexed, win.select("start_pos", "end_pos"), spec, members, block=2).join(win, ["start_pos", "end_pos"])
    want = metrics.edge_metrics(edges, [], "seq", mode).toPandas().set_index("seq").sort_index()
    partials = pairs.pair_partials(indexed, with_previous(win), spec, members, stretch=16, block=2)
    found = metrics.tile_metrics(partials, ["start_pos", "end_pos"], mode).join(win, ["start_pos", "end_pos"])
    got = found.toPandas().set_index("seq").sort_index()
    names = [*metrics.WINDOW_METRICS, "cells", "shared_cells", "leader_score", "laggard_score"]
    np.testing.assert_allclose(got[names].to_numpy(dtype=float), want[names].to_numpy(dtype=float), atol=1e-9)
    assert got.stability_matrix_corr.notna().any()
    for agg in ("sum", "mean"):
        tiles = {(r.end_pos, r.asset): r.score for r in metrics.scores_from_partials(partials, ["end_pos"], agg).collect()}
        assert tiles == pytest.approx({(r.end_pos, r.asset): r.score for r in metrics.row_scores(edges, ["end_pos"], agg).collect()}, abs=1e-9)


def test_tile_metrics_move_no_pairs(spark, indexed):
    universe = timeline.calendar(indexed).select("ts", F.array(F.lit("A02"), F.lit("A00"), F.lit("A04")).alias("symbols"))
    found = scenario.universe_metrics(indexed, SPECS[0], universe, "common")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "asset_i" not in plan
    assert found.count() > 0 and found.agg(F.max("n_assets")).first()[0] == 3
    with pytest.raises(ValueError):
        scenario.universe_metrics(indexed, SPECS[0], universe, "loose")


def test_role_pairs_in_given_order(spark):
    assigned = spark.createDataFrame([(1, "leader", a, 1.0) for a in "abc"] + [(1, "follower", a, -1.0) for a in "xyz"], "w int, role string, asset string, score double")
    order = spark.createDataFrame([("c", 1), ("a", 2), ("z", 1), ("x", 2)], "asset string, place int")
    got = roles.role_pairs(assigned, ["w"], order).orderBy("rank").collect()
    assert [(r.leader, r.follower) for r in got] == [("c", "z"), ("a", "x"), ("b", "y")]
    by_window = order.withColumn("w", F.lit(2))
    assert [(r.leader, r.follower) for r in roles.role_pairs(assigned, ["w"], by_window).orderBy("rank").collect()] == [("a", "x"), ("b", "y"), ("c", "z")]


def test_placebo_windows(spark, wide, indexed):
    spec = PairSpec(lookback=9)
    order = timeline.shuffled_calendar(timeline.calendar(indexed), 3)
    shuffled = order.toPandas().sort_values("pos")
    series = pairs.shuffled_series(indexed, order, spec.lookback)
    got = {(r.window_id, r.asset_i, r.asset_j): r.value for r in pairs.pair_edges_of_series(series, spec, block=2).collect()}
    labels, want = list(shuffled.ts), {}
    for i in range(spec.lookback, len(labels)):
        lo, hi = labels[i - spec.lookback + 1], labels[i]
        kept = [t for t in labels if lo <= t <= hi]
        if not kept:
            continue
        with np.errstate(all="ignore"):
            rets = np.log(wide.loc[kept].ffill()).diff().replace([np.inf, -np.inf], np.nan).fillna(0.0)
        m = matrix(spec, rets)
        want.update({(i, a, b): m.loc[a, b] for a in m for b in m if a < b})
    assert_same(got, want)
    control = metrics.rolling_metrics(indexed, spec).agg(F.avg("stability_matrix_corr")).first()[0]
    placebo = scenario.placebo_metrics(indexed, spec, 3).agg(F.avg("stability_matrix_corr")).first()[0]
    assert placebo is None or placebo < control


def test_short_panel_is_refused(indexed):
    with pytest.raises(ValueError):
        scenario.rolling_edges(indexed, PairSpec(lookback=60))
    with pytest.raises(ValueError):
        scenario.window_roles(indexed, PairSpec(lookback=60), RoleSpec())
    scenario.require_history(indexed, PairSpec(lookback=59))


def test_one_dominant_asset(spark):
    """An asset with most of the observations gets the same treatment as any other."""
    wide = wide_panel(rows=200, assets=6, gaps=0.9, odd=False, seed=4)
    wide["A00"] = np.linspace(50, 80, 200) + np.sin(np.arange(200))
    spec = PairSpec(lookback=20)
    got = edge_dict(pairs.pair_edges(indexed_panel(spark, wide), windows.rolling_windows(timeline.calendar(indexed_panel(spark, wide)), spec), spec, block=2).collect())
    assert_same(got, brute(spec, wide))
