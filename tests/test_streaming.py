"""Streams with state that outlives a batch and a query."""

import random

import pytest
from pyspark.sql import functions as F

from pairtide.operators import reports
from pairtide.streaming.bars import run_to_end
from pairtide.streaming.series import keep_state_on_disk, streaming_average, streaming_summaries

ALPHA = 0.3


def averages(values, alpha=ALPHA):
    out = []
    for v in values:
        out.append(v if not out else alpha * v + (1 - alpha) * out[-1])
    return out


def test_average_over_batches_restarts_and_any_order(spark, tmp_path):
    draw = random.Random(5)
    series = {k: [draw.uniform(-1, 1) for _ in range(n)] for k, n in (("long", 700), ("short", 3), ("one", 1))}
    rows = [(k, i, v, None if i % 5 == 2 else 2 * v) for k, all_ in series.items() for i, v in enumerate(all_)]
    draw.shuffle(rows)
    # a repeated row, a row without key, one before the start, and one behind a gap that is never filled
    awkward = [rows[0], (None, 0, 1.0, 1.0), ("short", -1, 9.0, 9.0), ("short", 4, 9.0, 9.0)]
    shape = "run string, seq long, x double, y double"
    folder = str(tmp_path / "in")
    keep_state_on_disk(spark)

    def go(part):
        spark.createDataFrame(part, shape).repartition(2).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)
        found = streaming_average(arriving, "run", "seq", ["x", "y"], ALPHA)
        return run_to_end(found, str(tmp_path / "out"), str(tmp_path / "progress"), ["run", "seq"], "append")

    half = len(rows) // 2
    go(rows[:half] + awkward)
    got = go(rows[half:] + rows[:3])
    assert got.count() == len(rows)
    for name, at in (("x", lambda k: series[k]), ("y", lambda k: [0.0 if i % 5 == 2 else 2 * v for i, v in enumerate(series[k])])):
        for k in series:
            found = got.where(F.col("run") == k).orderBy("seq").select(name, f"delta_{name}").collect()
            want = averages(at(k))
            assert [r[0] for r in found] == pytest.approx(want, abs=1e-12)
            assert [r[1] for r in found] == pytest.approx([0.0, *(b - a for a, b in zip(want, want[1:]))], abs=1e-12)


def test_average_refuses_a_weight_outside_its_range(spark):
    with pytest.raises(ValueError):
        streaming_average(spark.createDataFrame([], "run string, seq long, x double"), "run", "seq", ["x"], 0.0)


def test_summaries_are_replaced_by_newer_ones(spark, tmp_path):
    shape = "run string, metric string, mean double, modified timestamp"
    at = "timestamp'2024-01-0{} 00:00:00'"
    folder = str(tmp_path / "in")

    def go(rows):
        spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{r}', '{m}', CAST({v} AS DOUBLE), {at.format(d)})" for r, m, v, d in rows) + " AS t(run, metric, mean, modified)").write.mode("append").parquet(folder)
        newest = streaming_summaries(spark.readStream.schema(shape).parquet(folder))
        return reports.run_overview(run_to_end(newest, str(tmp_path / "out"), str(tmp_path / "progress"), ["run", "metric"])).collect()

    first = go([("a", "m", 1, 1), ("b", "m", 2, 2), ("a", "n", "NULL", 1)])
    assert [(r.run, r.metric, r["mean"]) for r in first][0] == ("b", "m", "2") and len(first) == 3
    # run a again, and an older summary of b that arrives late
    second = go([("a", "m", 5, 4), ("b", "m", 7, 1)])
    assert [(r.run, r.metric, r["mean"]) for r in second] == [("a", "m", "5"), ("b", "m", "2"), ("a", "n", None)]
