"""Report tables: comparisons, audits, rankings, run overviews."""

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairtide.operators.pairs import mirrored

# Metrics of the report in order, columns of the comparison table, probe metrics.
KEY_METRICS = ("mean_abs_matrix", "row_sum_std", "row_sum_range", "stability_matrix_corr", "reward_episode_mean")
COMPARISON_COLUMNS = (
    "run", "mean_abs_matrix", "max_abs_matrix", "row_sum_range", "stability_matrix_corr", "stability_rowsum_corr",
)
PROBE_METRICS = ("stability_matrix_corr", "stability_rowsum_corr", "mean_abs_matrix", "row_sum_std")


def matrix_snapshot(edges: DataFrame, assets: Sequence[str], key: str = "end_ts") -> DataFrame:
    """Square matrices of the first and last window, one column per asset."""
    bounds = edges.agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = bounds.select(F.explode(F.array("first", "last")).alias(key)).distinct()
    kept = edges.join(ends, key, "left_semi")
    cells = mirrored(kept, key)
    return cells.groupBy(key, "asset").pivot("other", list(assets)).agg(F.first("value")).fillna(0.0, subset=list(assets))


def compare_at_pivot(full: DataFrame, truncated: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of the last truncated window beside the full run's: ``(metric, truncated, full, delta)``."""
    shared = [m for m in metrics if m in full.columns and m in truncated.columns]
    pivot = truncated.agg(F.max(key)).scalar()

    def at_pivot(run: DataFrame, name: str) -> DataFrame:
        row = run.where(F.col(key) == pivot).select(key, *[F.col(m).cast("double").alias(m) for m in shared])
        return row.unpivot([key], shared, "metric", name)

    both = at_pivot(truncated, "truncated").join(at_pivot(full, "full"), [key, "metric"])
    return both.withColumn("delta", F.col("full") - F.col("truncated"))


def largest_delta(comparison: DataFrame) -> DataFrame:
    return comparison.agg(F.max(F.abs("delta")).alias("max_abs_delta"))


def probe(control: DataFrame, placebo: DataFrame) -> DataFrame:
    """Mean metrics of a run beside those of its shuffled placebo."""

    def means(run: DataFrame, name: str) -> DataFrame:
        row = run.agg(*[F.avg(m).alias(f"{m}_mean") for m in PROBE_METRICS])
        return row.unpivot([], [f"{m}_mean" for m in PROBE_METRICS], "metric", name)

    return means(control, "control").join(means(placebo, "placebo"), "metric").withColumn(
        "delta", F.col("placebo") - F.col("control")
    )


def scenario_ranking(stats: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric per scenario, best first."""
    return (
        stats.where(F.col("metric") == metric).groupBy("scenario").agg(F.avg("mean_mean").alias("mean_mean"))
        .orderBy(F.col("mean_mean").desc(), "scenario")
    )


def best_scenario(stats: DataFrame, metric: str = "mean_abs_matrix") -> DataFrame:
    return stats.where(F.col("metric") == metric).agg(
        F.max_by("scenario", "mean_mean").alias("scenario"), F.max("mean_mean").alias("score")
    )


def scenario_names(stats: DataFrame) -> DataFrame:
    """Sorted names of all scenarios in one array."""
    return stats.agg(F.array_sort(F.collect_set("scenario")).alias("scenarios"))


def key_metric_table(stats: DataFrame) -> DataFrame:
    """Mean and deviation of the key metrics per scenario, in report order."""
    place = F.array_position(F.array(*[F.lit(m) for m in KEY_METRICS]), F.col("metric"))
    return stats.where(F.col("metric").isin(*KEY_METRICS)).select(
        "scenario", place.alias("place"), "metric", F.col("mean_mean").alias("mean"), F.col("mean_std").alias("std")
    ).orderBy("scenario", "place")


def interval_lines(stats: DataFrame) -> DataFrame:
    """Bootstrap interval of the key metrics as text."""
    return stats.where(F.col("metric").isin(*KEY_METRICS) & F.col("mean_boot_low").isNotNull()).select(
        "scenario", "metric",
        F.format_string("bootstrap 95%% CI [%.4f, %.4f]", F.col("mean_boot_low"), F.col("mean_boot_high")).alias("line"),
    )


def welch_lines(welch: DataFrame) -> DataFrame:
    """Welch results as text."""
    return welch.where(F.col("p_value").isNotNull()).select(
        "metric", "column",
        F.format_string("Welch test (%s) %s vs %s: p=%.4f", "column", "scenario_a", "scenario_b", "p_value").alias("line"),
    )


def significance_subset(stats: DataFrame, note: str = "Bootstrap CI at 95%") -> DataFrame:
    """Only the interval columns of the statistics table."""
    bounds = [c for c in stats.columns if c.endswith(("_boot_low", "_boot_high"))]
    return stats.select("scenario", "metric", *bounds, F.lit(note).alias("note"))


def comparison_table(run_means: DataFrame) -> DataFrame:
    return run_means.select(*[c for c in COMPARISON_COLUMNS if c in run_means.columns])


def with_metadata(runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach run metadata; runs without any keep NULLs."""
    return runs.join(metadata, "run", "left")


def run_appendix(runs: DataFrame) -> DataFrame:
    """Scenario, seed and environment of every run, 'n/a' where unknown."""
    shown = ("scenario", "seed", "created_at", "config_path", "data_path", "python_version", "platform")
    return runs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) if c in runs.columns else F.lit("n/a").alias(c) for c in shown]
    )


def run_overview(summaries: DataFrame, columns: Sequence[str] = ("metric", "mean", "median", "max", "std")) -> DataFrame:
    """Dashboard rows: the preferred columns, or every numeric one, newest run first."""
    shown = [c for c in columns if c in summaries.columns]
    if not shown:
        shown = [f.name for f in summaries.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    text = [
        _six_digits(c).alias(c) if summaries.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
        for c in shown
    ]
    newest = F.col("modified").desc() if "modified" in summaries.columns else F.col("run").asc()
    return summaries.orderBy(newest, "run").select("run", *text)


def _six_digits(column: str) -> Column:
    """Six significant digits without trailing zeros."""
    text = F.format_string("%.6g", F.col(column))
    short = F.regexp_replace(text, r"^([^e]*?)\.?0+(e.*)?$", "$1$2")
    return F.when(F.col(column).isNotNull(), F.when(text.contains("."), short).otherwise(text))


def latest_runs(summaries: DataFrame) -> DataFrame:
    """Runs by time of their last change, newest first."""
    return summaries.groupBy("run").agg(F.max("modified").alias("modified")).orderBy(F.col("modified").desc(), "run")


def decisions_beside_metrics(metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    return metrics.join(decisions, "end_ts", "left")

