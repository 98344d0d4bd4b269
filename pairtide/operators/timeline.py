"""Time axis of a panel: positions, forward fill, as-of lookups, row filters.

A panel is a long table ``(ts, asset, price)`` with one row per observed value. Its
calendar is the set of timestamps with at least one observation; windows count rows
of that calendar, so every timestamp gets a dense position.
"""

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.functions.measures import text_hash


def dense_positions(
    rows: DataFrame, order: Sequence[str], bucket: Column, name: str = "pos", keys: Sequence[str] = ()
) -> DataFrame:
    """Number distinct rows 0, 1, ... in ``order`` (per ``keys``) without sorting a group in one task.

    ``bucket`` must grow with the order. Rows are counted per bucket, the counts (one row
    per bucket) are accumulated, and rows are numbered inside their bucket.
    """
    cut = [*keys, "_bucket"]
    marked = rows.withColumn("_bucket", bucket)
    counts = marked.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*cut).orderBy(*order)
    return (
        marked.join(offsets, cut)
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("int"))
        .drop("_bucket", "_offset")
    )


def index_panel(panel: DataFrame) -> DataFrame:
    """``(ts, pos, asset, price)``; missing and NaN values are dropped, not stored."""
    known = panel.where(F.col("price").isNotNull() & ~F.isnan("price"))
    positions = dense_positions(known.select("ts").distinct(), ["ts"], F.date_trunc("month", "ts"))
    return known.join(positions, "ts").select("ts", "pos", "asset", "price")


def calendar(indexed: DataFrame) -> DataFrame:
    """``(ts, pos)`` of an indexed panel."""
    return indexed.select("ts", "pos").distinct()


def last_known(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    span: Column,
    inclusive: bool = True,
) -> DataFrame:
    """Latest non-null ``value`` per key up to (or strictly before) each row.

    ``span`` cuts each key's timeline into stretches, so a key with very many rows is
    spread over tasks. Only one row per stretch crosses from one to the next.
    """
    keys = list(keys)
    end = Window.currentRow if inclusive else -1
    cut = rows.withColumn("_span", span)
    inside = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    known = cut.where(F.col(value).isNotNull())
    tails = known.groupBy(*keys, "_span").agg(F.max_by(value, order).alias("_tail"))
    stretches = cut.select(*keys, "_span").distinct().join(tails, [*keys, "_span"], "left")
    across = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(*keys, "_span", F.last("_tail", ignorenulls=True).over(across).alias("_carried"))
    return (
        cut.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*keys, "_span"], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried", "_span")
    )


def pos_span(length: int = 512, column: str = "pos") -> Column:
    return F.floor(F.col(column) / F.lit(length)).cast("int")


def with_previous(indexed: DataFrame) -> DataFrame:
    """Add the latest earlier observation of the asset as ``prev_pos`` and ``prev_price``."""
    packed = indexed.withColumn("_obs", F.struct("pos", "price"))
    return (
        last_known(packed, ["asset"], "pos", "_obs", "_prev", pos_span(), inclusive=False)
        .withColumn("prev_pos", F.col("_prev.pos"))
        .withColumn("prev_price", F.col("_prev.price"))
        .drop("_obs", "_prev")
    )


def log_return(price: Column, previous: Column) -> Column:
    """``ln(price / previous)``; 0 without a previous value or where either is not positive."""
    return F.when((price > 0) & (previous > 0), F.ln(price / previous)).otherwise(F.lit(0.0))


def returns(indexed: DataFrame) -> DataFrame:
    """Log return of each observation against the asset's latest earlier one."""
    return with_previous(indexed).withColumn("ret", log_return(F.col("price"), F.col("prev_price")))


def percent_change(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """``value / previous value - 1`` along each key's own timeline."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn(name, F.try_divide(F.col(value), previous) - 1)


def limit_days(indexed: DataFrame, days: int) -> DataFrame:
    """Keep the first ``days`` timestamps of the calendar."""
    return indexed.where(F.col("pos") < days) if days and days > 0 else indexed


def before(panel: DataFrame, end: str) -> DataFrame:
    """Rows strictly earlier than ``end``."""
    return panel.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def forward_fill(panel: DataFrame, column: str, name: str) -> DataFrame:
    """Fill gaps of ``column`` per asset from its latest earlier value."""
    return last_known(panel, ["asset"], "ts", column, name, F.date_trunc("month", "ts"))


def as_of(left: DataFrame, right: DataFrame, value: str, name: str, time: str = "ts") -> DataFrame:
    """Attach the ``value`` of the latest ``right`` row at or before each ``left`` row."""
    keys = left.columns
    stacked = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn(
        "_side", F.lit(1)
    ).unionByName(right.select(time, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    stacked = stacked.withColumn("_at", F.struct(F.col(time), F.col("_side")))
    filled = last_known(stacked, [], "_at", "_v", name, F.date_trunc("month", time))
    return filled.where(F.col("_side") == 1).select(*keys, name)


def shuffled_calendar(cal: DataFrame, seed: int) -> DataFrame:
    """Placebo order: rows keep their timestamp but get a hash-random position."""
    keyed = cal.select("ts", text_hash(F.col("ts"), F.lit(seed)).alias("_h"))
    return dense_positions(keyed, ["_h", "ts"], F.shiftright("_h", 52)).drop("_h")


def panel_is_usable(panel: DataFrame) -> DataFrame:
    """One row: at least two assets, and some timestamp with at least two observations."""
    per_ts = panel.where("price IS NOT NULL AND NOT isnan(price)").groupBy("ts").agg(F.count_distinct("asset").alias("n"))
    assets = panel.agg(F.count_distinct("asset").alias("asset_count"))
    return assets.select(
        F.col("asset_count"),
        per_ts.agg(F.max("n")).scalar().alias("max_observed"),
    ).withColumn("usable", (F.col("asset_count") >= 2) & (F.col("max_observed") >= 2))
