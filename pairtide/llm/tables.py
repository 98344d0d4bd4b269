"""Small helpers that the operators of this subpackage share."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def split_of(id_col: str, parts: int):
    """``crc32`` of the id as text, modulo ``parts``: the fold that tells training rows from held-out ones."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def fresh(columns: list[str], *names: str) -> list[str]:
    """These names, each with as many underscores more as it takes to meet none of ``columns`` in any case."""
    held, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
