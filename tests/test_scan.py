"""Prefix scans in levels, and the recurrences built on them, against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairtide.operators import kpis, lookback
from pairtide.operators.scan import before_each


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_scan_of_an_order_sensitive_operation(spark, fan):
    """Joining texts tells the order: every key, gaps in the numbers, one key much longer than the others."""
    rows = [("long", 2 * i + (i > 50) * 7, chr(97 + i % 26)) for i in range(130)] + [("one", 9, "x"), ("two", 300, "p"), ("two", 20, "q")]
    frame = spark.createDataFrame(rows, "k string, n int, v string")
    got = {(r.k, r.n): r.b for r in before_each(frame, ["k"], "n", "v", lambda a, b: F.concat(a, b), F.lit(""), "b", fan).collect()}
    want = {}
    for k in ("long", "one", "two"):
        text = ""
        for _, n, v in sorted(r for r in rows if r[0] == k):
            want[k, n] = text
            text += v
    assert got == want


def test_scan_without_keys_and_rows(spark):
    frame = spark.createDataFrame([(i, float(i)) for i in range(10)], "n int, v double")
    got = {r.n: r.b for r in before_each(frame, [], "n", "v", lambda a, b: a + b, F.lit(0.0), "b", 3).collect()}
    assert got == {i: float(sum(range(i))) for i in range(10)}
    assert before_each(frame.where("false"), [], "n", "v", lambda a, b: a + b, F.lit(0.0), "b").count() == 0


def test_drawdowns_over_many_stretches(spark):
    """A run with gains, total losses and losses beyond all value; stretches of seven numbers."""
    rng = np.random.default_rng(6)
    returns = {"a": rng.normal(0, 0.05, 200), "b": np.where(rng.random(40) < 0.1, -1.5, 0.2), "c": np.array([0.1, -1.0, 0.5]), "d": np.array([-0.5])}
    rows = [(k, i, float(x)) for k, v in returns.items() for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "run string, n int, ret double")
    got = {(r.run, r.n): (r.cumulative, r.drawdown) for r in kpis.drawdowns(frame, ["run"], "n", F.floor(F.col("n") / 7)).collect()}
    for k, v in returns.items():
        value = np.cumprod(1 + v)
        high = np.maximum.accumulate(value)
        for i in range(len(v)):
            assert got[k, i][0] == pytest.approx(value[i])
            assert (got[k, i][1] is None) if high[i] == 0 else got[k, i][1] == pytest.approx(value[i] / high[i] - 1)


def test_unknown_actions_are_refused(spark):
    relative = lookback.LookbackSpec(min_lookback=8, max_lookback=16, step=2, mode="relative")
    log = spark.createDataFrame([(0, 0, 1), (0, 1, 3)], "run int, step int, action int")
    with pytest.raises(Exception, match="action outside 0 .. 2"):
        lookback.lookback_path(log, ["run"], "step", relative).collect()
    absolute = lookback.LookbackSpec(min_lookback=8, max_lookback=16, step=2, mode="absolute")
    path = lookback.lookback_path(log.withColumn("action", F.lit(99)), ["run"], "step", absolute).orderBy("step").collect()
    assert [(r.prev_lookback, r.lookback) for r in path] == [(12, 16), (16, 16)]
