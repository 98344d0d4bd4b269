"""Session helpers: building a session, staging tables, sizing parallelism."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "pairtide") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="pairtide-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several branches of a plan read the same derived table: the raw
    scan runs once, later reads prune columns, the file sizes give the optimizer
    statistics, and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{staged_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_folder(spark: SparkSession) -> str:
    """Where this application's staged tables lie."""
    return f"{staging_root(spark)}/pairtide/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> bool:
    """Delete the tables this application staged, when none of its results is read any more; whether there were any.

    Results are lazy, so nothing is deleted by itself.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(staged_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession) -> int:
    """Partitions for stages that are heavy in compute but small in bytes.

    Adaptive execution merges partitions by size, which would put such a stage on
    one core; an explicit count from the cluster's own parallelism avoids that.
    """
    return max(3 * spark.sparkContext.defaultParallelism, 8)
