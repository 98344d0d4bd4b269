"""Reading price panels, universes and rate series."""

from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairtide.operators.timeline import forward_fill
from pairtide.operators.universe import parse_symbols

# Names of the time column in order of preference; file pattern of the fallback.
TIME_COLUMNS = ("date", "Date")
FALLBACK_PATTERN = "daily_prices_*.csv"
SYNTHETIC_DAYS = 300
SYNTHETIC_ASSETS = ("AssetA", "AssetB", "AssetC")


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A wide file, CSV or parquet by its extension."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True)


def time_column(columns: Sequence[str]) -> str:
    return next((c for c in TIME_COLUMNS if c in columns), columns[0])


def long_prices(wide: DataFrame, time: Optional[str] = None) -> DataFrame:
    """``(ts, asset, price)`` from one column per asset; empty cells vanish."""
    time = time or time_column(wide.columns)
    assets = [c for c in wide.columns if c != time]
    cells = wide.select(
        F.to_timestamp_ntz(F.col(f"`{time}`").cast("string")).alias("ts"),
        *[F.col(f"`{a}`").cast("string").try_cast("double").alias(a) for a in assets],
    ).unpivot(["ts"], [f"`{a}`" for a in assets], "asset", "price")
    return cells.where(F.col("price").isNotNull() & ~F.isnan("price"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return long_prices(read_wide(spark, path))


def find_price_file(spark: SparkSession, path: str, folder: str) -> Optional[str]:
    """``path`` if it exists, else the first fallback file of ``folder``, else None."""
    if _matches(spark, path):
        return path
    found = _matches(spark, f"{folder}/{FALLBACK_PATTERN}")
    return sorted(found)[0] if found else None


def _matches(spark: SparkSession, pattern: str) -> list:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in (system.globStatus(target) or [])]


def synthetic_prices(spark: SparkSession, seed: int = 42, days: int = SYNTHETIC_DAYS) -> DataFrame:
    """Random walks around 100 for when there is no file; repeatable for a seed."""
    from pyspark.sql import Window

    noise = spark.range(0, days * len(SYNTHETIC_ASSETS), numPartitions=1).select(
        (F.col("id") / len(SYNTHETIC_ASSETS)).cast("int").alias("day"),
        F.get(F.array(*[F.lit(a) for a in SYNTHETIC_ASSETS]), (F.col("id") % len(SYNTHETIC_ASSETS)).cast("int")).alias("asset"),
        (F.randn(seed) * 0.01).alias("step"),
    )
    walk = F.sum("step").over(Window.partitionBy("asset").orderBy("day"))
    start = F.lit("2020-01-01").cast("timestamp_ntz")
    return noise.select((start + F.make_dt_interval(F.col("day"))).alias("ts"), "asset", (walk + 100).alias("price"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """``(month, symbols)`` from the monthly file with its quoted comma lists."""
    rows = spark.read.csv(path, header=True, quote='"')
    return rows.select(F.to_date("date", "yyyy-MM").alias("month"), parse_symbols(F.col("symbols")).alias("symbols"))


def read_hourly(spark: SparkSession, path: str, fill: bool = False) -> DataFrame:
    """Hourly prices or turnover; a second ``datetime`` column is dropped, turnover is filled forward.

    Filled series keep every timestamp of the file after an asset's first value.
    """
    wide = read_wide(spark, path).drop("datetime")
    if not fill:
        return long_prices(wide)
    time = time_column(wide.columns)
    assets = [c for c in wide.columns if c != time]
    cells = wide.select(
        F.to_timestamp_ntz(F.col(f"`{time}`").cast("string")).alias("ts"),
        *[F.col(f"`{a}`").cast("string").try_cast("double").alias(a) for a in assets],
    ).unpivot(["ts"], [f"`{a}`" for a in assets], "asset", "raw")
    filled = forward_fill(cells, "raw", "price")
    return filled.where(F.col("price").isNotNull()).select("ts", "asset", "price")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Daily risk-free rate."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.to_date("date", "M/d/yyyy").alias("date"), F.col("tbill").try_cast("double").alias("tbill"))
