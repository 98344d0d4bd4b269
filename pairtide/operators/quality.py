"""Dataset quality findings, manifest and artifact checks."""

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.operators.timeline import last_known

#: Fixed value: tolerated share of missing values.
MISSING_TOLERANCE = 0.01

#: Which columns a result table must have (``need``), should have one or all of (``any``, ``all``), must not have
#: under these beginnings (``not``), by table and level.
CONTRACTS = (
    ("stats", "need", "ERROR", ("scenario", "metric", "count")),
    ("stats", "any", "WARN", ("mean_mean", "median_mean", "std_mean", "max_mean")),
    ("significance", "not", "ERROR", ("mea_boot_", "media_boot_", "st_boot_", "ma_boot_", "mi_boot_")),
    ("significance", "all", "WARN", ("mean_boot_low", "mean_boot_high")),
)

#: Files of a run by level, and metadata fields that should be filled.
RUN_FILES = (("summary.csv", "ERROR"), ("run_metadata.json", "ERROR"), ("metrics_timeseries.csv", "WARN"))
RUN_FIELDS = ("data_price_hash", "git_commit")


def known(panel: DataFrame) -> DataFrame:
    """The panel with NaN prices as missing ones."""
    return panel.withColumn("price", F.nanvl(F.col("price").cast("double"), F.lit(None).cast("double")))


def out_of_order(rows: DataFrame, sequence: str) -> DataFrame:
    """One row: whether ``ts`` falls anywhere when rows are read in ``sequence``."""
    stretch = F.floor(F.col(sequence) / F.lit(1 << 20))
    previous = last_known(rows.select(sequence, "ts"), [], sequence, "ts", "prev_ts", stretch, inclusive=False)
    return previous.agg(F.coalesce(F.max(F.col("ts") < F.col("prev_ts")), F.lit(False)).alias("falls"))


def quality(panel: DataFrame, sequence: str = None) -> DataFrame:
    """One row of findings on ``(ts, asset, price)``, read as a grid of timestamps by assets.

    A timestamp an asset holds k times counts as k rows of the grid. NaN counts as missing.

    ``sequence`` is the ingestion order, needed only to judge whether timestamps ascend.
    """
    panel = known(panel)
    repeated = panel.groupBy("ts", "asset").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("known"))
    by_ts = repeated.groupBy("ts").agg(F.max("n").alias("rows"), F.sum("known").alias("known"))
    assets = panel.agg(F.count_distinct("asset")).scalar()
    grid = by_ts.agg(
        F.coalesce(F.max("rows") > 1, F.lit(False)).alias("duplicate_index"),
        F.sum("known").alias("known"),
        (F.sum("rows") * assets).alias("cells"),
    )
    flat = (
        panel.where(F.col("price").isNotNull()).groupBy("asset").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
        .where(F.col("lo") == F.col("hi"))
        .agg(F.array_sort(F.collect_list("asset")).alias("names"))
    )
    monotonic = F.lit(True) if sequence is None else ~out_of_order(panel, sequence).scalar()
    return grid.select(
        "duplicate_index",
        (1 - F.col("known") / F.greatest("cells", F.lit(1))).alias("missing_ratio"),
        flat.scalar().alias("zero_variance_assets"),
        monotonic.alias("monotonic_index"),
    )


def issues(findings: DataFrame, tolerance: float = MISSING_TOLERANCE) -> DataFrame:
    """``(code, asset, amount)``: one row per finding beyond its threshold, and one per asset of one value."""
    whole = F.lit(None).cast("string")
    rows = lambda bad, code, amount: F.when(bad, F.array(F.struct(F.lit(code).alias("code"), whole.alias("asset"), amount.cast("double").alias("amount")))).otherwise(F.array())
    shape = "array<struct<code:string,asset:string,amount:double>>"
    flat = F.transform("zero_variance_assets", lambda a: F.struct(F.lit("constant_asset").alias("code"), a.alias("asset"), F.lit(0.0).alias("amount")))
    listed = [
        rows(F.col("duplicate_index"), "repeated_timestamp", F.lit(None)),
        rows(F.col("missing_ratio") > tolerance, "missing_share", F.col("missing_ratio")),
        rows(~F.col("monotonic_index"), "unordered_timestamps", F.lit(None)),
    ]
    return findings.select(F.inline(F.concat(*[part.cast(shape) for part in listed], flat.cast(shape))))


def manifest(panel: DataFrame, files: DataFrame = None, source: str = None) -> DataFrame:
    """One row describing the dataset: size, span, modal spacing, gaps, and its file's hash."""
    cells = known(panel).groupBy("ts", "asset").agg(F.count("price").alias("known"))
    span = cells.agg(
        F.count_distinct("ts").alias("row_count"),
        F.count_distinct("asset").alias("asset_count"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.sum(F.when(F.col("known") > 0, 1).otherwise(0)).alias("known"),
        F.array_sort(F.collect_set("asset")).alias("columns"),
    )
    steps = last_known(
        cells.select("ts").distinct(), [], "ts", "ts", "prev", F.date_trunc("month", "ts"), inclusive=False
    ).select((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp"))).alias("step"))
    spacing = steps.where("step IS NOT NULL").groupBy("step").count().agg(
        F.max_by((F.col("step") / 1e6), F.struct("count", -F.col("step")))
    )
    described = span.select(
        "row_count", "asset_count", "columns", "start", "end",
        (F.col("row_count") * F.col("asset_count") - F.col("known")).alias("missing_values"),
        spacing.scalar().alias("step_seconds"),
        F.lit(source).alias("source"),
    )
    if files is None:
        return described
    return described.withColumns(
        {
            "source_hash_sha256": files.agg(F.max(F.sha2("content", 256))).scalar(),
            "source_size_bytes": files.agg(F.sum("length")).scalar(),
        }
    )


def logged_metrics(summaries: DataFrame, run: str, stats: Sequence[str]) -> DataFrame:
    """How many statistics each run logs per metric and in total."""
    per_metric = summaries.groupBy(run, "metric").agg((F.count(F.lit(1)) * len(stats)).alias("columns"))
    total = per_metric.groupBy(run).agg(F.sum("columns").alias("total"))
    return per_metric.join(total, run)


def artifact_findings(stats: DataFrame = None, significance: DataFrame = None, path: str = "") -> list:
    """``(path, level, code, columns)`` for every contract that the columns of a result table break."""
    tables = {"stats": stats, "significance": significance}
    found = []
    for table, rule, level, names in CONTRACTS:
        if tables[table] is None:
            continue
        have = tables[table].columns
        absent = [n for n in names if n not in have]
        short = [c for c in have if c.startswith(names)]
        broken = {"need": absent, "all": absent, "any": absent if len(absent) == len(names) else [], "not": short}[rule]
        if broken:
            found.append((path, level, f"{table}:{rule}", ",".join(broken)))
    return found


def run_findings(files: DataFrame, metadata: DataFrame = None) -> DataFrame:
    """``(run, level, code, subject)``: files a run lacks and metadata fields left empty, from ``files(run, file)`` and ``metadata``."""
    wanted = F.array(*[F.struct(F.lit(n).alias("file"), F.lit(level).alias("level")) for n, level in RUN_FILES])
    have = files.groupBy("run").agg(F.collect_set("file").alias("have"))
    asked = have.select("run", "have", F.inline(wanted)).toDF("run", "have", "file", "level")
    found = asked.where(~F.array_contains("have", F.col("file"))).select("run", "level", F.lit("no_file").alias("code"), F.col("file").alias("subject"))
    if metadata is None:
        return found
    blank = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in RUN_FIELDS]
    empty = metadata.select("run", F.explode(F.array_compact(F.array(*blank))).alias("subject"))
    return found.unionByName(empty.select("run", F.lit("WARN").alias("level"), F.lit("no_value").alias("code"), "subject"))


def findings_by_level(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level").agg(F.count(F.lit(1)).alias("findings"))

