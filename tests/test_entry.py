import pytest

import __spark_entry__ as spark_entry
from tools.check_oracle import canonical, compare, connect

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
CHECKED = [
    ("bars_ohlc", SMALL), ("returns", SMALL), ("universe_prev_month", SMALL), ("ccf_lag_kendall", SMALL), ("metrics_timeseries", SMALL),
    ("adaptive_lookback", SMALL), ("quality", SMALL), ("manifest", SMALL), ("universe_edges", MIDDLE), ("gated_ffill", MIDDLE),
]


def test_registry():
    queries, oracle = spark_entry.queries(), spark_entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(oracle) >= 60


def test_entry_runs(spark):
    frame = spark_entry.entry(spark)
    assert frame.columns == ["end_ts", "rank", "leader", "follower"] and frame.count() > 0


@pytest.mark.parametrize("name,folder", CHECKED)
def test_query_matches_sql(spark, name, folder):
    frame = spark_entry.queries()[name](spark, folder)
    result = connect(folder).sql(spark_entry.oracle_sql()[name])
    rows = [tuple(r) for r in frame.collect()]
    assert rows
    assert compare(canonical(frame.columns, rows), canonical(result.columns, result.fetchall())) is None
