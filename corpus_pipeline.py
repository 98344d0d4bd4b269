"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet in the
session's shared folder and hands the reread table to the next. All but the last return the columns of
``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from pairtide.llm import steps
from pairtide.session import stage

STAGES = [
    ("language", steps.language),
    ("near_duplicates", steps.near_duplicates),
    ("decontamination", steps.decontamination),
    ("personal_data", steps.personal_data),
    ("packing", steps.packing),
]

#: Learned classifiers and token ids are beyond SQL; the tests hold every stage to a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
