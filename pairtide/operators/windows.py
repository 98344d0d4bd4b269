"""Window lists: rolling, explicit, candidate grids; window return arrays."""

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.config import PairSpec
from pairtide.operators.timeline import as_of


def rolling_windows(cal: DataFrame, spec: PairSpec, lookbacks: Optional[Sequence[int]] = None) -> DataFrame:
    """Windows of ``spec.lookback`` rows ending at positions lookback, lookback + step, ...

    The first full window, ending one row earlier, is left out on purpose. Each window also
    names the one before it, so measures that compare neighbours need no self-join. Several
    ``lookbacks`` give the windows of all those lengths, to be measured in one pass.
    """
    step = F.lit(spec.update_freq)
    lengths = F.array(*[F.lit(int(n)) for n in (lookbacks or [spec.lookback])])
    rows = cal.select("ts", "pos", F.explode(lengths).alias("lookback"))
    ends = rows.where((F.col("pos") >= F.col("lookback")) & ((F.col("pos") - F.col("lookback")) % step == 0))
    previous = F.when(F.col("pos") - step >= F.col("lookback"), F.col("pos") - step)
    return ends.select(
        F.col("ts").alias("end_ts"),
        F.col("pos").alias("end_pos"),
        (F.col("pos") - F.col("lookback") + 1).alias("start_pos"),
        previous.alias("prev_end_pos"),
        (previous - F.col("lookback") + 1).alias("prev_start_pos"),
    )


def candidate_windows(cal: DataFrame, lookbacks: Sequence[int], first_pos: int) -> DataFrame:
    """Every (date, lookback) combination for dates from ``first_pos`` on."""
    ends = cal.where(F.col("pos") >= first_pos)
    lengths = F.array(*[F.lit(int(n)) for n in sorted(set(lookbacks))])
    return ends.select("ts", "pos", F.explode(lengths).alias("lookback")).select(
        F.col("ts").alias("end_ts"),
        F.col("pos").alias("end_pos"),
        F.greatest(F.col("pos") - F.col("lookback") + 1, F.lit(0)).alias("start_pos"),
        "lookback",
    )


def explicit_windows(cal: DataFrame, windows: DataFrame) -> DataFrame:
    """Positions of windows given as ``(start_ts, end_ts)``, both ends inclusive.

    Bounds need not be calendar dates. Windows that cover no row are dropped.
    """
    last = as_of(windows.withColumn("ts", F.col("end_ts")), cal, "pos", "end_pos")
    earlier = cal.select((F.col("ts") + F.expr("INTERVAL 1 MICROSECOND")).alias("ts"), "pos")
    both = as_of(last.withColumn("ts", F.col("start_ts")), earlier, "pos", "_before").drop("ts")
    return (
        both.withColumn("start_pos", F.coalesce(F.col("_before") + 1, F.lit(0)))
        .drop("_before")
        .where(F.col("end_pos") >= F.col("start_pos"))
    )
