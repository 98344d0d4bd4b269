"""Resampling of raw observations into bars."""

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.session import stage

# The default aggregate of each price type.
DEFAULT_METHODS = {"open": "first", "high": "max", "low": "min", "close": "last"}
SKETCH = 10_000  # accuracy of the quantile sketch that surrounds a median
MARGIN = 4 / SKETCH  # share of a group taken in on either side of its median
MEDIAN_RANGES = 1024  # value ranges in which the values around a median are counted before they are sorted
BAR_METHODS = ("first", "last", "mean", "median", "min", "max")


def bar_aggregate(method: str, value: Column, order: Column) -> Column:
    """The aggregate that turns the observations of one bar into its value.

    ``order`` must be a total order for first and last to be repeatable.
    """
    if method == "mean":
        return F.avg(value)
    if method == "median":
        return F.median(value)
    if method == "min":
        return F.min(value)
    if method == "max":
        return F.max(value)
    if method == "first":
        return F.min_by(value, order)
    if method == "last":
        return F.max_by(value, order)
    raise ValueError(f"unknown bar method {method!r}; expected one of {', '.join(BAR_METHODS)}")


def bar_start(ts: str, timeframe: str) -> Column:
    """Start of the bar: a calendar unit (day, week from Monday, month, ...) or a fixed span like '6 hours'."""
    if " " in timeframe:
        return F.window(ts, timeframe).start
    return F.date_trunc(timeframe, ts).cast("timestamp_ntz")


def resample(
    observations: DataFrame,
    timeframe: str,
    price_type: str = "close",
    method: str = None,
    order: Column = None,
) -> DataFrame:
    """Bars ``(ts, asset, price)`` from observations ``(ts, asset, price)``.

    Missing values are skipped, so a bar without any observation does not exist.
    Partial aggregation runs before the shuffle, which also absorbs hot assets.
    """
    if price_type not in DEFAULT_METHODS:
        raise ValueError(f"unknown price type {price_type!r}")
    method = method or DEFAULT_METHODS[price_type]
    value = bar_aggregate(method, F.col("price"), F.col("ts") if order is None else order)
    known = observations.where(F.col("price").isNotNull() & ~F.isnan("price"))
    if method == "median":
        placed = known.select(bar_start("ts", timeframe).alias("ts"), "asset", "price")
        return exact_medians(placed, ["ts", "asset"], "price").withColumnRenamed("median", "price")
    return (
        known.groupBy(bar_start("ts", timeframe).alias("bar_ts"), "asset")
        .agg(value.alias("price"))
        .select(F.col("bar_ts").alias("ts"), "asset", "price")
    )


def ohlc(observations: DataFrame, timeframe: str, order: Column = None) -> DataFrame:
    """The four bar values and the median. The observations are read twice: for the values, and for what lies around the medians."""
    by = F.col("ts") if order is None else order
    known = observations.where(F.col("price").isNotNull() & ~F.isnan("price"))
    keys = ["bar_ts", "asset"]
    whole = known.withColumn("bar_ts", bar_start("ts", timeframe))
    kinds = ("open", "high", "low", "close")
    values = [bar_aggregate(DEFAULT_METHODS[kind], F.col("price"), by).alias(kind) for kind in kinds]
    bars = stage(whole.groupBy(*keys).agg(*values, *_surroundings("price")), "bars")
    return bars.select(*keys, *kinds).join(_medians_inside(whole, bars.drop(*kinds), keys, "price"), keys)


def exact_medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, median)`` for groups of any size, of values that are neither null nor NaN.

    A mergeable sketch per group gives two values between which the median must lie. Smaller values are only counted;
    those between, a share of ``2 * MARGIN`` and the sketch's error whatever their distribution, are counted by value and by range
    of values, and the range that holds the middle is sorted. No task holds a bar with a large share of all observations.
    """
    return _medians_inside(rows, stage(rows.groupBy(*keys).agg(*_surroundings(value)), "medians"), list(keys), value)


def _surroundings(value: str) -> list[Column]:
    """Size of a group and values below and above its median. The sketch is off by a share of 1 / SKETCH of the rows at most."""
    return [F.count(F.lit(1)).alias("_size"), F.percentile_approx(value, [0.5 - MARGIN, 0.5 + MARGIN], SKETCH).alias("_around")]


def _medians_inside(rows: DataFrame, groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    low_value, high_value = F.get("_around", F.lit(0)), F.get("_around", F.lit(1))
    near = rows.select(*keys, F.col(value).alias("_v")).join(groups.select(*keys, "_around"), keys).where(F.col("_v") <= high_value)
    # one row for all values below (null), and one for each value inside
    counted = stage(near.groupBy(*keys, F.when(F.col("_v") >= low_value, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "median_counts")
    share = F.coalesce(F.try_divide(F.col("_v") - low_value, high_value - low_value), F.lit(0.0))
    ranged = counted.join(groups, keys).withColumn("_range", F.when(F.col("_v").isNotNull(), F.floor(share * MEDIAN_RANGES)).otherwise(-1)).drop("_around")
    per_range = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_n"), F.max("_size").alias("_size"))
    so_far = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    middle = (
        per_range.withColumn("_before", F.sum("_n").over(so_far) - F.col("_n"))
        .where((F.col("_before") < high) & (F.col("_before") + F.col("_n") >= low))
        .select(*keys, "_range", "_before")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(middle, [*keys, "_range"]).withColumn("_last", F.col("_before") + F.sum("_n").over(inside))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_last") - F.col("_n") < rank) & (F.col("_last") >= rank), F.col("_v")))

    return placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))
