"""Writing results: run tables, statistics, manifests, transitions."""

import json
from typing import Any, Mapping, Optional

from pyspark.sql import DataFrame

from pairtide.operators.stats import significant, sorted_pairs
from pairtide.sources.runs import METADATA_TABLE, SERIES_TABLE, SUMMARY_TABLE


def write_run(metrics: DataFrame, summary: DataFrame, folder: str, fmt: str = "parquet", metadata: Optional[DataFrame] = None) -> None:
    """Metric series, summary and (as JSON) metadata: one table each, one partition per ``run_id``.

    Writing a run again replaces that run; other runs in the folder stay. ``sources.runs.read_run_table`` and
    ``read_run_metadata`` read the tables back.
    """
    _by_run(metrics, fmt, f"{folder}/{SERIES_TABLE}")
    _by_run(summary, fmt, f"{folder}/{SUMMARY_TABLE}")
    if metadata is not None:
        _by_run(metadata, "json", f"{folder}/{METADATA_TABLE}")


def _by_run(table: DataFrame, fmt: str, path: str) -> None:
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    writer.format(fmt).option("header", True).option("ignoreNullFields", False).save(path)


def write_table(table: DataFrame, folder: str, name: str, fmt: str = "csv") -> None:
    """A result table such as stats, significance, welch or a comparison."""
    table.write.mode("overwrite").format(fmt).option("header", True).save(f"{folder}/{name}")


def write_manifest(manifest: DataFrame, folder: str, name: str = "data_manifest") -> None:
    manifest.write.mode("overwrite").json(f"{folder}/{name}")


def write_pairs(tests: DataFrame, folder: str) -> None:
    """All tests and the significant ones, both sorted by q-value and effect size."""
    write_table(sorted_pairs(tests), folder, "all_pairs")
    write_table(significant(tests), folder, "significant_pairs")


def write_transitions(transitions: DataFrame, folder: str, metadata: Mapping[str, Any]) -> None:
    """Logged transitions by episode, with the settings that produced them."""
    transitions.write.mode("overwrite").partitionBy("episode").parquet(f"{folder}/transitions")
    spark = transitions.sparkSession
    spark.createDataFrame([(json.dumps(dict(metadata)),)], "value string").write.mode("overwrite").text(f"{folder}/metadata")
