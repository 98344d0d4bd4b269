"""Return statistics of runs and of their drawdowns."""

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.operators.scan import before_each
from pairtide.operators.timeline import percent_change
from pairtide.session import stage

SPAN = 256  # numbers of an integer order per stretch

# Columns that may hold returns, in order of preference; trading days per year.
RETURN_COLUMNS = ("portfolio_return", "strategy_return", "reward", "reward_step_mean", "pnl")
FALLBACK_COLUMN = "mean_abs_matrix"
DAYS_PER_YEAR = 252
MINIMUM_RETURNS = 2
MINIMUM_FALLBACK = 5


def derive_returns(series: DataFrame, run: str, order: str) -> DataFrame:
    """``(run, order, returns_column, ret)``: per run the first usable return column.

    A column is usable with more than two numeric values; otherwise the percentage change
    of the fallback column is taken where it has more than five. Runs with neither vanish.
    """
    present = [c for c in RETURN_COLUMNS if c in series.columns]
    parts = [
        series.select(run, order, F.lit(rank).alias("rank"), F.lit(name).alias("returns_column"),
                      F.col(name).cast("string").try_cast("double").alias("ret"))
        for rank, name in enumerate(present)
    ]
    if FALLBACK_COLUMN in series.columns:
        base = series.select(run, order, F.col(FALLBACK_COLUMN).cast("string").try_cast("double").alias("v"))
        base = base.where(F.col("v").isNotNull() & ~F.isnan("v"))
        enough = base.groupBy(run).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MINIMUM_FALLBACK)
        changed = percent_change(base.join(enough, run, "left_semi"), [run], order, "v", "ret")
        parts.append(
            changed.select(run, order, F.lit(len(RETURN_COLUMNS)).alias("rank"),
                           F.lit(f"{FALLBACK_COLUMN}_pct_change").alias("returns_column"), "ret")
        )
    if not parts:
        raise ValueError("no column that could hold returns")
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    candidates = candidates.where(F.col("ret").isNotNull() & ~F.isnan("ret"))
    usable = candidates.groupBy(run, "rank").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MINIMUM_RETURNS)
    chosen = usable.groupBy(run).agg(F.min("rank").alias("rank"))
    return candidates.join(chosen, [run, "rank"]).select(run, order, "returns_column", "ret")


def drawdowns(returns: DataFrame, keys: Sequence[str], order: str, span: Optional[Column] = None) -> DataFrame:
    """Compounded value and its fall below the highest value so far.

    ``span`` cuts a timeline into stretches (an integer that grows with the order; months or ``SPAN`` numbers unless
    given). Products and extremes of a stretch combine, so a run of any length is spread over its stretches.
    """
    if span is None:
        dated = returns.schema[order].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        span = F.year(order) * 12 + F.month(order) if dated else F.floor(F.col(order) / F.lit(SPAN))
    cut = stage(returns.withColumn("_span", span.cast("long")), "drawdown_spans")
    so_far = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = stage(cut.withColumn("_own", F.product(1 + F.col("ret")).over(so_far)), "drawdown_products")
    part = F.struct(F.product(1 + F.col("ret")).alias("grown"), F.max("_own").alias("high"), F.min("_own").alias("low"))
    summaries = inside.groupBy(*keys, "_span").agg(part.alias("_part"))

    def combine(a: Column, b: Column) -> Column:
        up, down = a["grown"] * b["high"], a["grown"] * b["low"]
        return F.struct(
            (a["grown"] * b["grown"]).alias("grown"), F.greatest(a["high"], up, down).alias("high"), F.least(a["low"], up, down).alias("low")
        )

    none = F.lit(None).cast("double")
    neutral = F.struct(F.lit(1.0).alias("grown"), none.alias("high"), none.alias("low"))
    before = before_each(summaries, keys, "_span", "_part", combine, neutral, "_before")
    value = F.col("_before.grown") * F.col("_own")
    known = inside.join(before, [*keys, "_span"]).withColumn("cumulative", value)
    highest = F.greatest(F.col("_before.high"), F.max("cumulative").over(so_far))
    return known.withColumn("drawdown", F.try_divide(F.col("cumulative"), highest) - 1).drop("_span", "_own", "_before")


def kpis(returns: DataFrame, run: str, order: str) -> DataFrame:
    """Annualised return, Sharpe ratio (NULL without variance), deepest drawdown and size per run."""
    n = F.count(F.lit(1))
    deviation = F.stddev_samp("ret")
    return drawdowns(returns, [run], order).groupBy(run, "returns_column").agg(
        (F.pow(F.product(1 + F.col("ret")), F.lit(float(DAYS_PER_YEAR)) / n) - 1).alias("annualized_return"),
        F.when(deviation > 0, F.sqrt(F.lit(float(DAYS_PER_YEAR))) * F.avg("ret") / deviation).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        n.alias("num_points"),
    )
