"""Point-in-time universes: which assets count on which date."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.operators.timeline import as_of, last_known, pos_span

# Defaults of universe selection.
DEFAULT_MAXIMUM = 50
DEFAULT_WINDOW = 210
MISSING_ALLOWED = 10


def parse_symbols(cell: Column) -> Column:
    """Symbols of a comma-separated cell, trimmed, without empty entries."""
    return F.coalesce(
        F.filter(F.transform(F.split(cell, ","), lambda s: F.trim(s)), lambda s: s != ""), F.array().cast("array<string>")
    )


def parse_symbol_list(cell: Column) -> Column:
    """The same for an array cell, whose entries may themselves hold several symbols."""
    return F.flatten(F.transform(F.filter(cell, lambda s: s.isNotNull()), parse_symbols))


def trim_symbols(symbols: Column, maximum: int = DEFAULT_MAXIMUM) -> Column:
    """First occurrences only, at most ``maximum``, and an even number unless just one is left."""
    unique = F.array_distinct(symbols)
    count = F.size(unique)
    capped = F.least(count, F.lit(maximum))
    return F.when(count < 2, unique).otherwise(F.slice(unique, F.lit(1), capped - capped % 2))


def previous_month_universe(cal: DataFrame, monthly: DataFrame, maximum: int = DEFAULT_MAXIMUM) -> DataFrame:
    """``(ts, pos, symbols)``: each date gets the trimmed list of the month before; NULL where there is none."""
    asked = cal.withColumn("month", F.trunc(F.add_months(F.to_date("ts"), -1), "MM"))
    trimmed = monthly.select("month", trim_symbols(F.col("symbols"), maximum).alias("symbols"))
    joined = asked.join(trimmed, "month", "left")
    return joined.select("ts", "pos", F.when(F.size("symbols") > 0, F.col("symbols")).alias("symbols"))


def membership(universe: DataFrame) -> DataFrame:
    """One row per (date, asset), with the asset's rank in the list."""
    return universe.select("ts", "pos", F.posexplode("symbols").alias("rank", "asset"))


def filtered_universe(
    indexed: DataFrame, universe: DataFrame, window: int = DEFAULT_WINDOW, allowed: int = MISSING_ALLOWED
) -> DataFrame:
    """Drop assets with more than ``allowed`` gaps in the ``window`` rows before a date.

    Gaps are rows of the calendar minus observations, so no dense grid is built. Member
    rows and observations are stacked per asset; each observation also goes to the
    stretches that look back on it, which bounds the rows any one window function sees.
    The first date has no history and keeps its list as it is.
    """
    length = max(window, 512)
    members = membership(universe)
    seen = indexed.select("asset").distinct().withColumn("in_panel", F.lit(True))
    asked = members.join(seen, "asset", "left").select(
        "asset", "pos", "ts", "rank", F.coalesce("in_panel", F.lit(False)).alias("in_panel"),
        pos_span(length).alias("stretch"), F.lit(0).alias("hit"),
    )
    told = indexed.select(
        "asset",
        "pos",
        F.explode(
            F.sequence(pos_span(length), F.floor((F.col("pos") + window) / F.lit(length)).cast("int"))
        ).alias("stretch"),
        F.lit(1).alias("hit"),
    )
    back = Window.partitionBy("asset", "stretch").orderBy("pos").rangeBetween(-window, -1)
    counted = (
        asked.unionByName(told, allowMissingColumns=True)
        .withColumn("observed", F.coalesce(F.sum("hit").over(back), F.lit(0)))
        .where(F.col("hit") == 0)
    )
    gaps = F.least(F.col("pos"), F.lit(window)) - F.col("observed")
    kept = counted.withColumn("keep", (F.col("pos") == 0) | (F.col("in_panel") & (gaps <= allowed)))
    lists = kept.groupBy("ts", "pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("rank", "asset")))).alias("r")
    )
    unique = F.array_distinct(F.col("r.asset"))
    even = F.when(F.size(unique) > 1, F.slice(unique, F.lit(1), F.size(unique) - F.size(unique) % 2)).otherwise(unique)
    return (
        lists.select("ts", "pos", F.when(F.col("pos") == 0, F.col("r.asset")).otherwise(even).alias("symbols"))
        .where(F.size("symbols") > 0)
    )


def select_universe(
    indexed: DataFrame, cal: DataFrame, monthly: DataFrame, maximum: int = DEFAULT_MAXIMUM, window: int = DEFAULT_WINDOW
) -> DataFrame:
    """Monthly lists to a clean universe per date."""
    daily = previous_month_universe(cal, monthly, maximum)
    return filtered_universe(indexed, daily.where(F.col("symbols").isNotNull()), window)


def universe_on(cal: DataFrame, universe: DataFrame) -> DataFrame:
    """Exact-date lookup; dates without a list get an empty one."""
    return cal.join(universe.select("ts", "symbols"), "ts", "left").withColumn(
        "symbols", F.coalesce("symbols", F.array().cast("array<string>"))
    )


def gated_fill(indexed: DataFrame, universe: DataFrame) -> DataFrame:
    """Fill an asset's gap from its last observed value, but only on dates whose universe holds it.

    Dates before the first non-empty universe are dropped, and values seen before it do
    not fill. Filled values never fill further gaps.
    """
    first = universe.where(F.size("symbols") > 0).agg(F.min("ts")).scalar()
    observed = indexed.where(F.col("ts") >= first).select("ts", "pos", "asset", "price")
    members = membership(universe).select("ts", "pos", "asset").distinct()
    gaps = members.where(F.col("ts") >= first).join(observed.select("pos", "asset"), ["pos", "asset"], "left_anti")
    stacked = observed.unionByName(gaps, allowMissingColumns=True)
    filled = last_known(stacked, ["asset"], "pos", "price", "filled_price", pos_span())
    return filled.where(F.col("filled_price").isNotNull()).select(
        "ts", "pos", "asset", F.col("filled_price").alias("price"), F.col("price").isNull().alias("filled")
    )


def window_members(windows: DataFrame, universe: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(end_pos, end_ts, rank, asset)``: the universe in force at each window's end, panel assets only."""
    listed = as_of(windows.select("end_pos", F.col("end_ts").alias("ts")), universe, "symbols", "symbols")
    rows = listed.select("end_pos", F.col("ts").alias("end_ts"), F.posexplode("symbols").alias("rank", "asset"))
    return rows.join(indexed.select("asset").distinct(), "asset", "left_semi")
