"""Comparison of runs: seed statistics, bootstrap, Welch tests, false discovery, effect size."""

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.functions.measures import text_hash
from pairtide.functions.special import t_test_p
from pairtide.operators.scan import before_each
from pairtide.operators.timeline import dense_positions
from pairtide.session import stage

# Bootstrap size, normal quantile of the 95 % interval, smallest sample of a pairwise test.
RESAMPLES = 2000
NORMAL_95 = 1.96
PAIR_TEST_MINIMUM = 5
P_RANGES = 64  # ranges of p-values per halving
STATISTICS = ("mean", "median", "std", "max", "min")


def long_statistics(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries ``(keys, metric, mean, …)`` as ``(keys, metric, stat, value)``."""
    names = [s for s in STATISTICS if s in summaries.columns]
    return summaries.select(*keys, "metric", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        [*keys, "metric"], names, "stat", "value"
    )


def seed_statistics(long: DataFrame) -> DataFrame:
    """Mean, population deviation and normal 95 % half-width per (scenario, metric, stat).

    ``count`` counts runs, including those whose value is missing.
    """
    return long.groupBy("scenario", "metric", "stat").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        (NORMAL_95 * F.stddev_pop("value") / F.sqrt(F.count(F.lit(1)))).alias("ci95"),
    )


def bootstrap_interval(
    values: DataFrame, keys: Sequence[str], value: str, order: str, resamples: int = RESAMPLES, seed: int = 0, alpha: float = 0.05
) -> DataFrame:
    """Percentile interval of the resampled mean per group.

    Draw k of resample b goes to the value whose rank is a hash of (group, b, k), so the
    interval is the same on every run. Draws are counted per value before they meet the
    values, and a resample is summed where its rows are: no group is gathered in one row.
    """
    keys = list(keys)
    known = values.where(F.col(value).isNotNull())
    slot = F.pmod(text_hash(F.col(order)), F.lit(256))
    ranked = dense_positions(known, [order], slot, "_rank", keys)
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"))
    draws = (
        ranked.select(*keys, F.col("_rank").alias("_k"))
        .join(sizes, keys)
        .where("_n >= 2")
        .withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
        .withColumn("_rank", F.pmod(text_hash(*[F.col(c) for c in (*keys, "_b", "_k")], F.lit(seed)), F.col("_n")).cast("int"))
        .groupBy(*keys, "_b", "_rank")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    means = (
        draws.join(ranked.select(*keys, "_rank", value), [*keys, "_rank"])
        .groupBy(*keys, "_b")
        .agg((F.sum(F.col(value) * F.col("_times")) / F.sum("_times")).alias("_resampled"))
    )
    bounds = means.groupBy(*keys).agg(
        F.percentile("_resampled", F.lit(alpha / 2)).alias("boot_low"),
        F.percentile("_resampled", F.lit(1 - alpha / 2)).alias("boot_high"),
    )
    return sizes.join(bounds, keys, "left").select(
        *keys, F.coalesce("boot_low", "_mean").alias("boot_low"), F.coalesce("boot_high", "_mean").alias("boot_high")
    )


def stats_table(long: DataFrame, order: str, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """The wide table: ``<stat>_mean, _std, _ci95, _boot_low, _boot_high`` per (scenario, metric)."""
    keys = ["scenario", "metric", "stat"]
    joined = seed_statistics(long).join(bootstrap_interval(long, keys, "value", order, resamples, seed), keys, "left")
    wide = joined.groupBy("scenario", "metric").pivot("stat", list(STATISTICS)).agg(
        *[F.first(c).alias(c) for c in ("mean", "std", "ci95", "boot_low", "boot_high")]
    )
    counts = joined.groupBy("scenario", "metric").agg(F.max("count").alias("count"))
    return counts.join(wide, ["scenario", "metric"])


def moments(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Size, mean and sample variance of each group; missing values are left out."""
    known = F.when(~F.isnan(value), F.col(value))
    return samples.groupBy(*keys).agg(
        F.count(known).alias("n"), F.avg(known).alias("mean"), F.var_samp(known).alias("var"), F.count(F.lit(1)).alias("rows")
    )


def scenario_pairs(stats: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """Each unordered pair of scenarios side by side, per ``by`` group."""
    sides = [
        stats.select(*by, *[F.col(c).alias(t) for c, t in
                            ((name, f"{name}_{s}"), ("n", f"n_{s}"), ("mean", f"mean_{s}"), ("var", f"var_{s}"), ("rows", f"rows_{s}"))])
        for s in ("a", "b")
    ]
    ordered = F.col(f"{name}_a") < F.col(f"{name}_b")
    return sides[0].join(sides[1], list(by)).where(ordered)


def welch_columns() -> dict:
    """t statistic and Satterthwaite degrees of freedom from the moments of two samples."""
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    valid = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (ea + eb > 0)
    t = F.when(valid, F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(ea + eb)))
    shares = ea * ea / F.nullif(F.col("n_a") - 1, F.lit(0)) + eb * eb / F.nullif(F.col("n_b") - 1, F.lit(0))
    return {"t_stat": t, "df": F.when(valid, F.try_divide((ea + eb) * (ea + eb), shares))}


def cohens_d() -> Column:
    """Difference of means in pooled standard deviations."""
    valid = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    pooled = F.sqrt(
        F.try_divide(
            (F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), F.col("n_a") + F.col("n_b") - 2
        )
    )
    return F.when(valid, F.try_divide(F.col("mean_a") - F.col("mean_b"), F.nullif(pooled, F.lit(0.0))))


def welch_by_metric(long: DataFrame) -> DataFrame:
    """Welch tests between scenarios for every (metric, stat)."""
    stats = moments(long, ["metric", "stat", "scenario"], "value")
    tested = scenario_pairs(stats, "scenario", ["metric", "stat"]).withColumns(welch_columns())
    return tested.withColumn("p_value", t_test_p("t_stat", "df")).select(
        "metric", F.col("stat").alias("column"), "scenario_a", "scenario_b", "mean_a", "mean_b",
        F.col("rows_a").alias("n_a"), F.col("rows_b").alias("n_b"), "t_stat", "df", "p_value",
    )


def pairwise_tests(series: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
    """Welch tests between whole metric series, with effect size and q-values per metric.

    Only pairs with more than five values on both sides are tested.
    """
    long = series.select(name, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [name], list(metrics), "metric", "value"
    )
    pairs = scenario_pairs(moments(long, ["metric", name], "value"), name, ["metric"])
    tested = (
        pairs.where((F.col("n_a") > PAIR_TEST_MINIMUM) & (F.col("n_b") > PAIR_TEST_MINIMUM))
        .withColumns({**welch_columns(), "cohens_d": cohens_d()})
        .withColumn("p_value", t_test_p("t_stat", "df"))
    )
    return q_values(tested, ["metric"], "p_value").select(
        "metric", f"{name}_a", f"{name}_b", "n_a", "n_b", "t_stat", "df", "p_value", "cohens_d", "q_value"
    )


def q_values(tests: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Benjamini-Hochberg q-values. Missing p-values count as tests and get no q-value.

    Equal p-values have equal q-values, so tests are counted by p-value first. Ranges of p-values (``P_RANGES`` an octave) are
    ranked and searched on their own; the tests before a range and the least value behind it come from prefix scans, so any
    number of tests of one key is spread over its ranges.
    """
    keys = list(keys)
    counted = tests.groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_tests"))
    octave = F.when(F.col("_p") > 0, F.floor(F.log2("_p") * P_RANGES)).otherwise(F.lit(-1100 * P_RANGES))
    known = stage(counted.where(F.col("_p").isNotNull()).withColumn("_range", octave.cast("long")), "p_values")
    sums = known.groupBy(*keys, "_range").agg(F.sum("_n").alias("_held"))
    earlier = before_each(sums, keys, "_range", "_held", lambda a, b: a + b, F.lit(0), "_before")
    line = Window.partitionBy(*keys, "_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("_before") + F.sum("_n").over(line)
    placed = known.join(earlier, [*keys, "_range"]).join(sizes, keys).withColumn("_q", F.col("_p") * F.col("_tests") / rank)
    placed = stage(placed.select(*keys, "_p", "_range", "_q"), "q_values")
    least = placed.groupBy(*keys, (-F.col("_range")).alias("_back")).agg(F.min("_q").alias("_least"))
    behind = before_each(least, keys, "_back", "_least", lambda a, b: F.least(a, b), F.lit(None).cast("double"), "_behind")
    onward = Window.partitionBy(*keys, "_range").orderBy("_p").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = placed.join(behind.withColumn("_range", -F.col("_back")).drop("_back"), [*keys, "_range"])
    found = found.select(*keys, F.col("_p").alias(p), F.least(F.min("_q").over(onward), "_behind").alias("q_value"))
    return tests.join(found, [*keys, p], "left").select(*tests.columns, "q_value")


def p_matrix(tests: DataFrame, name: str, names: Sequence[str]) -> DataFrame:
    """Square table of p-values for one metric; both triangles, empty diagonal."""
    a, b = f"{name}_a", f"{name}_b"
    both = tests.select(F.col(a).alias(name), F.col(b).alias("other"), "p_value").unionByName(
        tests.select(F.col(b).alias(name), F.col(a).alias("other"), "p_value")
    )
    return both.groupBy(name).pivot("other", list(names)).agg(F.first("p_value"))


def significant(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Tests below the level, most significant first, then by effect size."""
    return sorted_pairs(tests).where(F.col("q_value") < level)


def sorted_pairs(tests: DataFrame) -> DataFrame:
    return tests.withColumn("abs_d", F.abs("cohens_d")).orderBy(F.col("q_value").asc_nulls_last(), F.col("abs_d").desc())


def run_means(summaries: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    """One row per run: the mean of every metric as its own column."""
    return summaries.groupBy(run).pivot("metric", list(metrics)).agg(F.first("mean"))
