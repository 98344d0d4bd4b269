"""One matrix over a whole history, against the definitions with missing rows dropped per pair."""

import numpy as np
import pytest

from helpers import indexed_panel, pair_value, wide_panel, distance, kendall
from pairtide.config import PairSpec
from pairtide.functions import ranks
from pairtide.operators.whole import _Layout, _state, merge, whole_matrix

SPECS = [
    PairSpec(lag=1),
    PairSpec(lag=7),
    PairSpec(lag=2, correlation="squared_pearson"),
    PairSpec(method="ccf_auc", max_lag=4),
    PairSpec(method="ccf_at_max_lag", max_lag=9),
    PairSpec(method="signature", signature_form="levy"),
    PairSpec(method="signature", scaling="by_std"),
    PairSpec(lag=3, correlation="spearman"),
    PairSpec(method="ccf_auc", max_lag=2, correlation="kendall"),
    PairSpec(lag=1, correlation="distance"),
    PairSpec(lag=1, correlation="mutual_information"),
]


def awkward_panel():
    """Gaps, two stretches of nothing, a constant series, one that starts late, one with a single row, one alone on its rows."""
    wide = wide_panel(rows=90, assets=8, gaps=0.3, odd=False, seed=3)
    wide.iloc[:, 3] = np.where(wide.iloc[:, 3].isna(), np.nan, 5.0)
    wide.iloc[:70, 4] = np.nan
    wide.iloc[:, 5] = np.nan
    wide.iloc[11, 5] = 3.0
    wide.iloc[20:60, 0] = np.nan
    wide.iloc[30:33] = np.nan
    wide.iloc[:, 6] = np.where(np.arange(90) % 2, wide.iloc[:, 6], np.nan)
    wide.iloc[:, 7] = np.where(np.arange(90) % 2, np.nan, wide.iloc[:, 7])
    return wide.dropna(how="all")


def wanted(spec, wide):
    out, names = {}, sorted(wide.columns)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = wide[[a, b]].dropna().to_numpy()
            out[a, b] = pair_value(spec, both[:, 0], both[:, 1]) if len(both) > 1 else 0.0
    return out


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"{s.method}-{s.correlation}-{s.lag}-{s.scaling}")
def test_whole_matrix(spark, spec):
    wide = awkward_panel()
    panel = indexed_panel(spark, wide)
    got = {(r.asset_i, r.asset_j): r.value for r in whole_matrix(panel, spec, stretch=4, block=3).collect()}
    want = wanted(spec, wide)
    assert got.keys() == want.keys()
    for pair, value in want.items():
        assert got[pair] == pytest.approx(value, abs=1e-9), pair


def test_one_stretch_or_many(spark):
    panel = indexed_panel(spark, wide_panel(rows=200, assets=5, gaps=0.2, odd=False, seed=8))
    spec = PairSpec(method="ccf_auc", max_lag=12)
    sizes = [{(r.asset_i, r.asset_j): r.value for r in whole_matrix(panel, spec, stretch=s).collect()} for s in (4096, 5)]
    assert sizes[0] == pytest.approx(sizes[1], abs=1e-9)


def test_plan_has_no_product_of_assets(spark):
    panel = indexed_panel(spark, wide_panel(rows=40, assets=4))
    plan = whole_matrix(panel, PairSpec(method="ccf_auc", max_lag=2), stretch=16)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_and_single(spark):
    panel = indexed_panel(spark, wide_panel(rows=20, assets=1, odd=False))
    assert whole_matrix(panel, PairSpec(lag=1)).count() == 0
    assert whole_matrix(panel.where("false"), PairSpec(lag=1)).count() == 0
    assert whole_matrix(panel, PairSpec(lag=1, correlation="kendall")).count() == 0


def test_states_merge_in_any_grouping():
    rng = np.random.default_rng(4)
    x, y = (np.where(rng.random((3, 30)) < 0.5, np.nan, rng.normal(size=(3, 30)).round(1)) for _ in range(2))
    layout = _Layout(PairSpec(method="ccf_auc", max_lag=6))
    cut = [0, 2, 3, 9, 17, 30]
    parts = [_state(layout, x[:, a:b], y[:, a:b]) for a, b in zip(cut, cut[1:])]
    whole = _state(layout, x, y)
    left = parts[0]
    for part in parts[1:]:
        left = merge(layout, left, part)
    right = parts[-1]
    for part in parts[-2::-1]:
        right = merge(layout, part, right)
    np.testing.assert_allclose(left, whole, atol=1e-12)
    np.testing.assert_allclose(right, whole, atol=1e-12)


@pytest.mark.parametrize("digits", [None, 1, 0])
@pytest.mark.parametrize("n", [2, 3, 17, 120])
def test_sorted_rank_measures(n, digits):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    y = x + rng.normal(size=n)
    if digits is not None:
        x, y = x.round(digits), y.round(digits)
    assert ranks.kendall(x, y) == pytest.approx(kendall(x, y), abs=1e-12, nan_ok=True)
    assert ranks.distance(x, y) == pytest.approx(distance(x, y), abs=1e-9)


def test_long_series_use_sorting(spark):
    wide = wide_panel(rows=700, assets=3, gaps=0.05, odd=False, seed=5)
    panel = indexed_panel(spark, wide)
    for correlation in ("kendall", "distance"):
        spec = PairSpec(lag=1, correlation=correlation)
        got = {(r.asset_i, r.asset_j): r.value for r in whole_matrix(panel, spec).collect()}
        want = wanted(spec, wide)
        assert got == pytest.approx(want, abs=1e-9)
