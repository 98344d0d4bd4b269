import numpy as np
import pandas as pd
import pytest
from helpers import indexed_panel, long_panel, wide_panel
from pyspark.sql import functions as F

from pairtide.operators import bars, timeline, universe


def test_positions_are_dense_across_buckets(spark):
    rows = spark.range(500).select((F.col("id") * 3).alias("v"))
    got = timeline.dense_positions(rows, ["v"], F.floor(F.col("v") / 70)).orderBy("v").collect()
    assert [r.pos for r in got] == list(range(500))


def test_last_known_crosses_stretches(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": np.repeat(["a", "b"], 300), "t": np.tile(np.arange(300), 2), "v": rng.random(600)})
    frame.loc[rng.random(600) < 0.95, "v"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    for inclusive in (True, False):
        got = timeline.last_known(rows, ["k"], "t", "v", "filled", timeline.pos_span(16, "t"), inclusive).toPandas()
        want = frame.copy()
        want["filled"] = want.groupby("k").v.transform(lambda s: s.ffill() if inclusive else s.shift().ffill())
        got = got.sort_values(["k", "t"]).filled.to_numpy(dtype=float)
        np.testing.assert_allclose(got, want.sort_values(["k", "t"]).filled.to_numpy(), equal_nan=True)


def test_as_of_takes_latest_not_later(spark):
    left = spark.sql("SELECT explode(sequence(1, 100)) d").selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(d) ts", "d")
    right = left.where("d % 17 = 0").selectExpr("ts", "d AS v")
    got = {r.d: r.seen for r in timeline.as_of(left, right, "v", "seen").collect()}
    assert got == {d: (d // 17 * 17 or None) for d in range(1, 101)}


def test_returns_carry_over_gaps(spark):
    wide = wide_panel(rows=80, assets=3, gaps=0.4)
    got = {(r.ts, r.asset): r.ret for r in timeline.returns(indexed_panel(spark, wide)).collect()}
    for asset in wide:
        seen = wide[asset].dropna()
        with np.errstate(all="ignore"):
            want = np.log(seen / seen.shift()).where((seen > 0) & (seen.shift() > 0), 0.0).fillna(0.0)
        for ts, value in want.items():
            assert got[(ts.to_pydatetime(), asset)] == pytest.approx(value, abs=1e-12)


def test_bar_methods(spark):
    ticks = spark.sql(
        "SELECT timestamp_ntz'2024-01-03 00:00:00' + make_dt_interval(0, id) ts, 'A' asset, CAST(id AS DOUBLE) price FROM range(48)"
    )
    daily = {m: [r.price for r in bars.resample(ticks, "day", method=m).orderBy("ts").collect()] for m in bars.BAR_METHODS}
    assert daily == {"first": [0, 24], "last": [23, 47], "mean": [11.5, 35.5], "median": [11.5, 35.5], "min": [0, 24], "max": [23, 47]}
    assert bars.resample(ticks, "week").count() == 1 and bars.resample(ticks, "6 hours").count() == 8
    with pytest.raises(ValueError):
        bars.resample(ticks, "day", method="mode")
    with pytest.raises(ValueError):
        bars.resample(ticks, "day", price_type="vwap")


def test_panel_check(spark):
    assert timeline.panel_is_usable(long_panel(spark, wide_panel())).first().usable
    assert not timeline.panel_is_usable(long_panel(spark, wide_panel(assets=1, odd=False))).first().usable


def test_symbol_parsing_and_trim(spark):
    row = spark.sql("SELECT 'A, B,,C , A' s, array('X', NULL, 'Y, Z', ' ') l")
    got = row.select(
        universe.parse_symbols(F.col("s")).alias("a"),
        universe.parse_symbol_list(F.col("l")).alias("b"),
        universe.trim_symbols(universe.parse_symbols(F.col("s"))).alias("c"),
        universe.trim_symbols(F.array(F.lit("Q"))).alias("d"),
        universe.trim_symbols(universe.parse_symbols(F.col("s")), 2).alias("e"),
    ).first()
    assert (got.a, got.b, got.c, got.d, got.e) == (["A", "B", "C", "A"], ["X", "Y", "Z"], ["A", "B"], ["Q"], ["A", "B"])


def test_universe_filter_and_gated_fill(spark):
    wide = wide_panel(rows=120, assets=8, gaps=0.35, odd=False, seed=2)
    indexed = indexed_panel(spark, wide)
    months = spark.sql(
        "SELECT date'2023-12-01' month, split('A03,A01,A09,A00,A02,A05,A01,A06', ',') symbols UNION ALL "
        "SELECT date'2024-01-01', split('A07,A01,A04', ',') UNION ALL SELECT date'2024-02-01', split('A00,A01,A02,A03,A04,A05,A06', ',')"
    )
    chosen = universe.select_universe(indexed, timeline.calendar(indexed), months, maximum=7, window=25)
    got = {pd.Timestamp(r.ts): r.symbols for r in chosen.collect()}
    lists = {r.month.strftime("%Y-%m"): r.symbols for r in months.collect()}
    want = {}
    for i, ts in enumerate(wide.index):
        symbols = lists.get((ts - pd.DateOffset(months=1)).strftime("%Y-%m"))
        if symbols is None:
            continue
        symbols = list(dict.fromkeys(symbols))[:7]
        symbols = symbols[: len(symbols) - len(symbols) % 2]
        if i:
            past = wide.iloc[max(0, i - 25) : i]
            symbols = [s for s in symbols if s in wide and past[s].isna().sum() <= 10]
            if len(symbols) > 1:
                symbols = symbols[: len(symbols) - len(symbols) % 2]
        if symbols:
            want[ts] = symbols
    assert got == want
    filled = {(pd.Timestamp(r.ts), r.asset): r.price for r in universe.gated_fill(indexed, chosen).collect()}
    start, last, expected = min(want), {}, {}
    for ts, row in wide[wide.index >= start].iterrows():
        last.update(row.dropna().to_dict())
        expected.update({(ts, a): v for a, v in row.dropna().items()})
        expected.update({(ts, a): last[a] for a in want.get(ts, []) if a in wide and np.isnan(row[a]) and a in last})
    assert filled == expected
