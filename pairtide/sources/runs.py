"""Reading the results of earlier runs: trees with one folder per run, and tables with one partition per run."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File names of a run folder.
SUMMARY_FILE = "summary.csv"
SERIES_FILE = "metrics_timeseries.csv"
METADATA_FILE = "run_metadata.json"
STATS_FILE = "stats.csv"

# Tables of a folder that ``sinks.write_run`` fills, and the file of a run folder each stands for.
SERIES_TABLE, SUMMARY_TABLE, METADATA_TABLE = "metrics_timeseries", "summary", "run_metadata"
TABLE_FILES = {SUMMARY_TABLE: SUMMARY_FILE, SERIES_TABLE: SERIES_FILE, METADATA_TABLE: METADATA_FILE}

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("config_path", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("data_price_path", T.StringType()),
        T.StructField("data_price_hash", T.StringType()),
        T.StructField("git", T.StructType([T.StructField("git_commit", T.StringType()), T.StructField("git_branch", T.StringType())])),
        T.StructField("env", T.StructType([T.StructField("python_version", T.StringType()), T.StructField("platform", T.StringType())])),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def run_name(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def seed_of(name: Column) -> Column:
    """Seed in a run name like ``x_seed42_2025``; NULL without one."""
    return F.regexp_extract(name, r"_seed(\d+)(?:_|$)", 1).try_cast("int")


def is_run(name: Column) -> Column:
    """Run folders carry an underscore and are not aggregates."""
    return name.contains("_") & ~name.endswith("_aggregate")


def _files(spark: SparkSession, root: str, name: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of all runs with run name, seed and time of change."""
    rows = _files(spark, root, SUMMARY_FILE).csv(root, header=True, inferSchema=True)
    named = rows.select("*", run_name(F.col("_metadata.file_path")).alias("run"), F.col("_metadata.file_modification_time").alias("modified"))
    return named.withColumn("seed", seed_of(F.col("run")))


def read_metric_series(spark: SparkSession, root: str) -> DataFrame:
    """Metric time series of all runs."""
    rows = _files(spark, root, SERIES_FILE).csv(root, header=True, inferSchema=True)
    return rows.select("*", run_name(F.col("_metadata.file_path")).alias("run"))


def read_aggregate_stats(spark: SparkSession, root: str) -> DataFrame:
    """Statistics tables of every ``*_aggregate`` folder at any depth."""
    rows = _files(spark, root, STATS_FILE).csv(root, header=True, inferSchema=True)
    named = rows.select("*", run_name(F.col("_metadata.file_path")).alias("aggregate_dir"))
    return named.where(F.col("aggregate_dir").endswith("_aggregate"))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Run metadata; a file that does not parse gives a row with NULLs."""
    rows = _files(spark, root, METADATA_FILE).schema(METADATA_SCHEMA).json(root, multiLine=True, mode="PERMISSIVE")
    return rows.select(
        run_name(F.col("_metadata.file_path")).alias("run"),
        F.coalesce(F.regexp_extract("config_path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1), F.col("scenario")).alias("scenario"),
        "config_path",
        "created_at",
        F.col("data_price_path").alias("data_path"),
        "data_price_hash",
        F.col("git.git_commit").alias("git_commit"),
        F.col("git.git_branch").alias("git_branch"),
        F.col("env.python_version").alias("python_version"),
        F.col("env.platform").alias("platform"),
    )


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """``(run, file)`` of every file in the tree, from listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return listed.select(run_name(F.col("path")).alias("run"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


def read_run_table(spark: SparkSession, folder: str, table: str = SUMMARY_TABLE, fmt: str = "parquet", runs_only: bool = True) -> DataFrame:
    """A table of ``sinks.write_run`` with ``run``, ``seed`` and ``modified`` (time of the run's last file).

    ``runs_only`` leaves out aggregates and folders that are no run (``is_run``). Files of other runs are not opened
    when the result is filtered by ``run``.
    """
    rows = spark.read.format(fmt).option("header", True).option("inferSchema", True).load(f"{folder}/{table}")
    run = F.col("run_id").cast("string")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "run_id"]
    named = rows.select(*kept, run.alias("run"), seed_of(run).alias("seed"), F.col("_metadata.file_modification_time").alias("modified"))
    return named.where(is_run(F.col("run"))) if runs_only else named


def read_run_metadata(spark: SparkSession, folder: str, runs_only: bool = True) -> DataFrame:
    """Metadata of ``sinks.write_run``, one row per run, with ``run`` and ``seed``."""
    return read_run_table(spark, folder, METADATA_TABLE, "json", runs_only).drop("modified")


def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(run, file)`` for every run in the tables of a folder, each table named by the file it stands for; from listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    table = F.regexp_extract("path", r"([^/]+)/run_id=[^/]+/[^/]+$", 1)
    file = F.element_at(F.create_map(*[F.lit(v) for pair in TABLE_FILES.items() for v in pair]), table)
    found = listed.select(F.url_decode(F.regexp_extract("path", r"/run_id=([^/]+)/[^/]+$", 1)).alias("run"), file.alias("file"))
    return found.where("run <> '' AND file IS NOT NULL").distinct()


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_by_name(frames: list) -> DataFrame:
    """Stack tables whose columns differ."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole
