"""Bars from a stream of observations."""

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def streaming_bars(observations: DataFrame, span: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Mean bars per asset; rows later than ``lateness`` are dropped once their bar is closed.

    On a stream that has ended, :func:`run_to_end` gives what :func:`pairtide.operators.bars.resample`
    gives. ``ts`` must be a timestamp with time zone.
    """
    return (
        observations.where(F.col("price").isNotNull() & ~F.isnan("price"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", span), "asset")
        .agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("observations"))
        .select(F.col("window.start").alias("ts"), "asset", "price", "observations")
    )


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = ("ts", "asset"), mode: str = "update") -> DataFrame:
    """Process everything available now into a parquet table and return it: the last state of every bar, or of what ``keys`` name.

    Bars are sent whenever they change, so the bars that the watermark has not passed at the end of a closed input are there too.
    """
    spark: SparkSession = stream.sparkSession

    def send(changed: DataFrame, batch: int) -> None:
        # one folder per batch: a batch that is run again replaces its own
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(send).start()
    query.awaitTermination()
    kept = [c for c in stream.columns if c not in keys]
    sent = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", folder).parquet(folder)
    last = sent.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch").alias("last"))
    return last.select(*keys, "last.*")
