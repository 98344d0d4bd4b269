"""Per-window metrics: signal size, net scores, stability against the window before."""

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.config import PairSpec
from pairtide.operators.pairs import mirrored, pair_partials
from pairtide.operators.timeline import calendar, dense_positions
from pairtide.operators.windows import rolling_windows

# Metrics of the summary table and the statistics each one gets.
SIZE_METRICS = ("mean_abs_matrix", "max_abs_matrix", "row_sum_range", "row_sum_std")
STABILITY_METRICS = ("stability_matrix_corr", "stability_rowsum_corr")
WINDOW_METRICS = SIZE_METRICS + STABILITY_METRICS + ("n_assets",)

_SUMS = ("pairs", "row_sum", "abs_sum", "prev_pairs", "shared_pairs", "shared_sum", "shared_prev_sum", "cross", "sq", "prev_sq")


def edge_partials(edges: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Row sums per (window, asset) from edges, paired with the window before.

    ``seq`` numbers the windows of each ``keys`` group without gaps. The earlier value
    of a pair comes from ``lag`` over the pair's own timeline.
    """
    timeline = Window.partitionBy(*keys, "asset_i", "asset_j").orderBy(seq)
    paired = edges.withColumn(
        "prev", F.when(F.lag(seq).over(timeline) == F.col(seq) - 1, F.lag("value").over(timeline))
    )
    cell = F.struct
    both = paired.select(
        *keys,
        seq,
        F.explode(
            F.array(
                cell(F.col("asset_i").alias("asset"), F.col("value").alias("v"), F.col("prev").alias("p")),
                cell(F.col("asset_j").alias("asset"), (-F.col("value")).alias("v"), (-F.col("prev")).alias("p")),
            )
        ).alias("c"),
    ).select(*keys, seq, "c.*")
    shared = F.col("p").isNotNull()

    def over_shared(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(shared, value)), F.lit(0.0))

    return both.groupBy(*keys, seq, "asset").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("v").alias("row_sum"),
        F.sum(F.abs("v")).alias("abs_sum"),
        F.max(F.abs("v")).alias("max_abs"),
        F.count("p").alias("prev_pairs"),
        F.count("p").alias("shared_pairs"),
        over_shared(F.col("v")).alias("shared_sum"),
        over_shared(F.col("p")).alias("shared_prev_sum"),
        over_shared(F.col("v") * F.col("p")).alias("cross"),
        over_shared(F.col("v") * F.col("v")).alias("sq"),
        over_shared(F.col("p") * F.col("p")).alias("prev_sq"),
    )


def metrics_from_partials(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per window from row sums of any number of tiles.

    Matrices are antisymmetric, so cells and row sums have mean zero and a correlation is
    ``sum(ab) / sqrt(sum(aa) sum(bb))``. It is NULL without an earlier window or variance.
    """
    assets = partials.groupBy(*keys, "asset").agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("max_abs").alias("max_abs"))
    return assets.groupBy(*keys).agg(
        (F.sum("abs_sum") / F.sum("pairs")).alias("mean_abs_matrix"),
        F.max("max_abs").alias("max_abs_matrix"),
        (F.max("row_sum") - F.min("row_sum")).alias("row_sum_range"),
        F.stddev_pop("row_sum").alias("row_sum_std"),
        _correlation(F.sum("cross"), F.sum("sq"), F.sum("prev_sq")).alias("stability_matrix_corr"),
        _correlation(
            F.sum(F.col("shared_sum") * F.col("shared_prev_sum")),
            F.sum(F.col("shared_sum") * F.col("shared_sum")),
            F.sum(F.col("shared_prev_sum") * F.col("shared_prev_sum")),
        ).alias("stability_rowsum_corr"),
        F.count(F.lit(1)).alias("n_assets"),
        F.sum("pairs").alias("cells"),
        F.sum("shared_pairs").alias("shared_cells"),
        F.sum("prev_pairs").alias("prev_cells"),
        F.max("row_sum").alias("leader_score"),
        F.min("row_sum").alias("laggard_score"),
    )


def _correlation(cross: Column, left: Column, right: Column) -> Column:
    return F.try_divide(cross, F.sqrt(left * right))


def tile_metrics(partials: DataFrame, keys: Sequence[str], mode: str = "common") -> DataFrame:
    """Metrics of windows whose assets may change, from the sums of ``pair_partials``.

    ``common`` compares the pairs that both windows hold; ``strict`` gives a stability only if both hold the same assets.
    """
    _check_mode(mode)
    metrics = metrics_from_partials(partials.repartition(*keys), keys)
    return _only_where(metrics, (F.col("shared_cells") == F.col("cells")) & (F.col("prev_cells") == F.col("cells"))) if mode == "strict" else metrics


def _check_mode(mode: str) -> None:
    if mode not in ("strict", "common"):
        raise ValueError(f"unknown stability mode {mode!r}")


def _only_where(metrics: DataFrame, same: Column) -> DataFrame:
    return metrics.withColumn("_same", same).withColumns({name: F.when(F.col("_same"), F.col(name)) for name in STABILITY_METRICS}).drop("_same")


def scores_from_partials(partials: DataFrame, keys: Sequence[str], agg_func: str = "sum") -> DataFrame:
    """``(…, asset, score)`` from the sums of ``pair_partials``: what ``row_scores`` gives from edges, without edges."""
    _check_agg(agg_func)
    count = F.sum("pairs") + 1 if agg_func == "mean" else F.lit(1)
    return partials.groupBy(*keys, "asset").agg((F.sum("row_sum") / count).alias("score"))


def _check_agg(agg_func: str) -> None:
    if agg_func not in ("sum", "mean"):
        raise ValueError(f"invalid agg_func {agg_func!r}; use 'sum' or 'mean'")


def rolling_metrics(indexed: DataFrame, spec: PairSpec, lookbacks: Optional[Sequence[int]] = None) -> DataFrame:
    """Metric time series of the rolling windows of a whole panel, without storing edges.

    Several ``lookbacks`` share one scan and one tile stage; ``lookback`` tells them apart.
    """
    windows = rolling_windows(calendar(indexed), spec, lookbacks)
    metrics = metrics_from_partials(pair_partials(indexed, windows, spec).repartition("start_pos", "end_pos"), ["start_pos", "end_pos"])
    dated = metrics.join(calendar(indexed).select(F.col("ts").alias("end_ts"), F.col("pos").alias("end_pos")), "end_pos")
    return dated.select("end_ts", "end_pos", (F.col("end_pos") - F.col("start_pos") + 1).alias("lookback"), *WINDOW_METRICS)


def edge_metrics(edges: DataFrame, keys: Sequence[str], seq: str, mode: str = "strict") -> DataFrame:
    """Metrics from stored edges, also where the assets of a window change.

    ``strict`` gives a stability only if both windows hold the same assets, ``common``
    compares the block of assets both windows share.
    """
    _check_mode(mode)
    metrics = metrics_from_partials(edge_partials(edges, keys, seq), [*keys, seq])
    if mode == "common":
        return metrics
    before = F.lag("cells").over(Window.partitionBy(*keys).orderBy(seq))
    same = (F.col("shared_cells") == F.col("cells")) & (before == F.col("cells"))
    return _only_where(metrics, same)


def numbered(windows: DataFrame) -> DataFrame:
    """Number windows 0, 1, ... by end position."""
    return dense_positions(windows, ["end_pos"], F.floor(F.col("end_pos") / F.lit(4096)), "seq")


def row_scores(edges: DataFrame, keys: Sequence[str], agg_func: str = "sum") -> DataFrame:
    """Net lead score of every asset: the sum (or mean, counting the diagonal) of its matrix row."""
    _check_agg(agg_func)
    rows = mirrored(edges, *keys).groupBy(*keys, "asset")
    if agg_func == "sum":
        return rows.agg(F.sum("value").alias("score"))
    return rows.agg((F.sum("value") / (F.count(F.lit(1)) + 1)).alias("score"))


def summarize(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(metric, mean, median, std, max, min)`` per run, NULL where a statistic is not asked for."""
    names = [m for m in WINDOW_METRICS if m in metrics.columns]
    long = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(keys), names, "metric", "value"
    )
    sized, counted = F.col("metric").isin(*SIZE_METRICS), F.col("metric") == "n_assets"
    stats = long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.stddev_samp("value").alias("std"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
    )
    return stats.select(
        *keys,
        "metric",
        "mean",
        F.when(~counted, F.col("median")).alias("median"),
        F.when(sized, F.col("std")).alias("std"),
        F.when(sized | counted, F.col("max")).alias("max"),
        F.when(counted, F.col("min")).alias("min"),
    )


def regime(window_rets: DataFrame, keys: Sequence[str] = ("start_pos", "end_pos")) -> DataFrame:
    """Return statistics of each window: overall mean and deviation, spread across assets and over time."""
    cells = window_rets.select(*keys, "asset", F.posexplode("rets").alias("row", "r"))
    by_row = cells.groupBy(*keys, "row").agg(
        F.count("r").alias("n"),
        F.avg("r").alias("m"),
        F.var_pop("r").alias("v"),
        F.stddev_pop("r").alias("across"),
    )
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    overall = by_row.groupBy(*keys).agg(
        mean.alias("returns_mean"),
        F.sqrt(
            (F.sum(F.col("n") * F.col("v")) + F.regr_sxx("m", "m") * F.max("n")) / (F.sum("n") - 1)
        ).alias("returns_vol"),
        F.avg("across").alias("cross_sectional_vol"),
    )
    size = F.size("rets")
    mid = F.aggregate("rets", F.lit(0.0), lambda a, x: a + x) / size
    spread = F.sqrt(F.aggregate("rets", F.lit(0.0), lambda a, x: a + (x - mid) * (x - mid)) / size)
    over_time = window_rets.select(*keys, spread.alias("s")).groupBy(*keys).agg(F.avg("s").alias("dispersion"))
    return overall.join(over_time, list(keys))


def score_features(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest and smallest net score, their distance, and the strongest pair of each window."""
    scores = row_scores(edges, keys).groupBy(*keys).agg(
        F.max("score").alias("leader_score"), F.min("score").alias("laggard_score")
    )
    top = edges.groupBy(*keys).agg(F.max(F.abs("value")).alias("top_pair"))
    return scores.join(top, list(keys)).withColumn("spread", F.col("leader_score") - F.col("laggard_score"))
