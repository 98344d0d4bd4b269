import numpy as np
import pytest
from helpers import indexed_panel, matrix, wide_panel, window_returns
from pyspark.sql import functions as F

from pairtide.config import PairSpec
from pairtide.operators import lookback, recurrences, rewards, timeline
from pairtide.operators.lookback import LookbackSpec

SPEC = PairSpec(lookback=8)


def test_reward_template_sources(tmp_path):
    (tmp_path / "calm.json").write_text('{"components": {"S": 2}, "params": {"edge": {"jump_threshold": 4}}}')
    calm = rewards.RewardTemplate.load("calm", str(tmp_path))
    assert calm.name == "calm" and calm.weights == {"S": 2.0} and rewards.RewardParams.of(calm.params).jump == 4
    assert rewards.RewardTemplate.load(None) == rewards.RewardTemplate() and rewards.RewardTemplate.load({"components": {"E": 1}}).weights == {"E": 1.0}
    with pytest.raises(FileNotFoundError):
        rewards.RewardTemplate.load("none", str(tmp_path))


def test_reachable_and_validation():
    assert LookbackSpec(8, 16, 2).reachable() == [8, 10, 12, 14, 16]
    assert LookbackSpec(10, 17, 3).reachable() == [10, 11, 13, 14, 16, 17]
    for bad in ((1, 5), (9, 9)):
        with pytest.raises(ValueError):
            LookbackSpec(*bad)
    with pytest.raises(ValueError):
        LookbackSpec(mode="other")


@pytest.mark.parametrize("alpha", [0.05, 0.3, 0.9, 0.999999, 1.0])
def test_exponential_average(spark, alpha):
    values = np.random.default_rng(0).normal(0, 1, 3000)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, t int, v double")
    got = [r.e for r in recurrences.exponential_average(rows, ["k"], "t", "v", alpha, "e").orderBy("t").collect()]
    want, now = [], values[0]
    for i, v in enumerate(values):
        now = v if i == 0 else alpha * v + (1 - alpha) * now
        want.append(now)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_state_walk_spans_stretches(spark):
    rng = np.random.default_rng(3)
    moves = rng.integers(0, 7, (2, 900, 7))
    rows = [(k, t, moves[k, t].tolist()) for k in range(2) for t in range(900)]
    got = recurrences.follow_states(spark.createDataFrame(rows, "k int, t int, m array<int>"), ["k"], "t", "m", 3).collect()
    got = {(r.k, r.t): (r.state_before, r.state_after) for r in got}
    for k in range(2):
        now = 3
        for t in range(900):
            assert got[(k, t)] == (now, moves[k, t, now])
            now = moves[k, t, now]


def test_greedy_path_matches_sequential_walk(spark):
    wide = wide_panel(rows=70, assets=4, seed=5)
    indexed = indexed_panel(spark, wide)
    range_ = LookbackSpec(5, 15, 3)
    path = {r.end_pos: (r.lookback, r.signal) for r in lookback.greedy_path(lookback.candidate_signals(indexed, SPEC, range_), range_).collect()}
    now, off = range_.midpoint, ~np.eye(4, dtype=bool)
    for i in range(15, 70):
        best = None
        for option in sorted({range_.clip(now - 3), now, range_.clip(now + 3)}):
            signal = np.abs(matrix(SPEC, window_returns(wide, i - option + 1, i)).to_numpy()[off]).mean()
            if best is None or signal > best[1] + 1e-12:
                best = (option, signal)
        now = best[0]
        assert path[i][0] == now and path[i][1] == pytest.approx(best[1], abs=1e-9)


def test_missing_signals_keep_the_lookback(spark):
    rows = [(t, n, None if t == 5 else float(n)) for t in range(10) for n in (8, 10, 12, 14, 16)]
    signals = spark.createDataFrame(rows, "end_pos int, lookback int, signal double").withColumn("end_ts", F.col("end_pos"))
    got = {r.end_pos: r.lookback for r in lookback.greedy_path(signals, LookbackSpec(8, 16, 2)).collect()}
    assert got == {0: 14, 1: 16, 2: 16, 3: 16, 4: 16, 6: 16, 7: 16, 8: 16, 9: 16}


def walk(range_, actions, targets=None):
    now, out = range_.midpoint, []
    for i, a in enumerate(actions):
        if range_.mode == "absolute":
            want = range_.min_lookback + int(a) if range_.discrete else int(np.round(a))
        elif range_.mode == "relative":
            want = now + (int(a) - 1) * range_.step if range_.discrete else int(now + a * range_.step)
        elif range_.discrete:
            want = {0: range_.min_lookback, 4: range_.max_lookback}.get(int(a), now + (int(a) - 2) * range_.step)
        else:
            want = int(0.5 * (targets[i] + now + a * range_.step))
        before, now = now, range_.clip(want)
        out.append((before, now))
    return out


@pytest.mark.parametrize("mode", ["absolute", "relative", "hybrid"])
@pytest.mark.parametrize("discrete", [True, False])
def test_action_paths(spark, mode, discrete):
    range_ = LookbackSpec(8, 40, 5, mode, discrete)
    rng = np.random.default_rng(8)
    sizes = {"absolute": 33, "relative": 3, "hybrid": 5}
    if discrete:
        actions = rng.integers(0, sizes[mode], 400).tolist()
    else:
        actions = (rng.uniform(5, 45, 400) if mode == "absolute" else rng.uniform(-1, 1, 400)).round(2).tolist()
    targets = rng.uniform(8, 40, 400).round(2).tolist()
    kind = "int" if discrete else "double"
    log = spark.createDataFrame([(0, i, a, t) for i, (a, t) in enumerate(zip(actions, targets))], f"e int, step int, action {kind}, target double")
    got = lookback.lookback_path(log, ["e"], "step", range_).orderBy("step").collect()
    assert [(r.prev_lookback, r.lookback) for r in got] == walk(range_, actions, targets)


def test_episode_bounds(spark):
    cal = timeline.calendar(indexed_panel(spark, wide_panel(rows=60, assets=2)))
    rows = lookback.episodes(cal, 20, 25, 15, 1).groupBy("episode").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"), F.sum(F.col("done").cast("int")).alias("d")
    ).collect()
    assert len(rows) == 20 and all(15 <= r.lo <= 35 and r.n == 25 and r.hi == r.lo + 24 and r.d == 1 for r in rows)
    assert len({r.lo for r in rows}) > 3


def test_reward_values(spark):
    state = spark.sql(
        "SELECT 0.6D mean_abs, 0.4D row_range, 0.2D stability_matrix, 0.1D stability_rows, 0.05D delta_mean, "
        "0.02D returns_mean, 0.01D returns_vol, 30 lookback, 25 prev_lookback"
    )
    range_ = LookbackSpec(10, 50)
    row = rewards.with_reward(state, range_, rewards.RewardTemplate.from_dict({"components": {"S": 1.0, "C": 0.5}})).first()
    assert (row.S, row.C, row.E, row.LookbackPenalty) == pytest.approx((0.5, 0.15, 0.0, 0.0))
    assert row.Sharpe == pytest.approx(2.0) and row.reward == pytest.approx(0.575)
    far = state.withColumn("lookback", F.lit(50)).withColumn("prev_lookback", F.lit(10))
    row = rewards.with_reward(far, range_, rewards.RewardTemplate()).first()
    assert row.E == pytest.approx(1.0 + 4.0) and row.LookbackPenalty == pytest.approx(1.0)
    row = rewards.with_legacy_reward(state.withColumn("prev_lookback", F.lit(30)), range_).first()
    assert row.E == pytest.approx(0.05) and row.reward == pytest.approx(0.5 + 0.3 * 0.15 - 0.05 * 0.05)
    with pytest.raises(ValueError):
        rewards.RewardTemplate.from_dict({"components": 3})


def test_states_follow_the_chosen_windows(spark):
    wide = wide_panel(rows=40, assets=4, seed=6)
    indexed = indexed_panel(spark, wide)
    range_ = LookbackSpec(5, 11, 2)
    cal = timeline.calendar(indexed).where("pos >= 11")
    log = cal.selectExpr("0 AS episode", "pos - 11 AS step", "pos", "ts", "pos % 7 AS action", "false AS done")
    decisions = lookback.with_reset(lookback.lookback_path(log, ["episode"], "step", range_), range_)
    got = {r.seq: r for r in lookback.decision_states(indexed, decisions, SPEC, range_).collect()}
    off, before, mean = ~np.eye(4, dtype=bool), None, 0.0
    steps = [(0, 11, 8)] + [(i - 10, i, 5 + i % 7) for i in range(11, 40)]
    for seq, pos, n in steps:
        returns = window_returns(wide, pos - n + 1, pos)
        m = matrix(SPEC, returns).to_numpy()
        row = got[seq]
        assert row.lookback == n and row.mean_abs == pytest.approx(np.abs(m[off]).mean(), abs=1e-9)
        assert row.delta_mean == pytest.approx(row.mean_abs - mean, abs=1e-9)
        if before is not None:
            assert row.stability_matrix == pytest.approx(np.corrcoef(m[off], before[off])[0, 1], abs=1e-9)
            assert row.stability_rows == pytest.approx(np.corrcoef(m.sum(1), before.sum(1))[0, 1], abs=1e-9)
        assert row.returns_vol == pytest.approx(returns.stack().std(), abs=1e-9)
        assert row.cross_sectional_vol == pytest.approx(returns.std(axis=1, ddof=0).mean(), abs=1e-9)
        assert row.dispersion == pytest.approx(returns.std(axis=0, ddof=0).mean(), abs=1e-9)
        before, mean = m, row.mean_abs
    scored = rewards.with_legacy_reward(lookback.decision_states(indexed, decisions, SPEC, range_, ema_alpha=0.4), range_)
    moved = lookback.transitions(scored).orderBy("step").collect()
    assert len(moved) == 29 and all(len(r.observation) == 14 for r in moved)
