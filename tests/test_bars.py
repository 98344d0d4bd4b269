"""Exact medians of groups of any shape."""

import random
import statistics

from pyspark.sql import functions as F

from pairtide.operators import bars


def test_medians_of_skewed_tied_and_large_groups(spark):
    draw = random.Random(3)
    groups = {
        "one": [5.0],
        "two": [1.0, 2.0],
        "ties": [1.0] * 30 + [2.0] * 30,
        "same": [7.0] * 101,
        "far": [draw.random() for _ in range(400)] + [1e300, -1e300],  # equal ranges of values would hold all but two
        "exponential": [10 ** draw.uniform(-200, 200) for _ in range(501)],
        "infinite": [float("-inf"), 1.0, 2.0, float("inf"), float("inf")],
        "signs": [draw.uniform(-1, 1) for _ in range(1000)],
    }
    rows = spark.createDataFrame([(k, v) for k, all_ in groups.items() for v in all_], "k string, v double").repartition(7)
    got = {r.k: r.median for r in bars.exact_medians(rows, ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_median_of_a_group_larger_than_its_sketch(spark):
    """Five million rows, most of them within a millionth of the range of their values."""
    rows = spark.range(0, 5_000_001, 1, 16).select(F.lit("hot").alias("k"), F.exp(((F.col("id") * 48271) % 5_000_001) / 50_000.0).alias("v"))
    want = rows.orderBy("v").offset(2_500_000).first().v
    assert bars.exact_medians(rows, ["k"], "v").first().median == want


def test_medians_of_nothing(spark):
    assert bars.exact_medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0
