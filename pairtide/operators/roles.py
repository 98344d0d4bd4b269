"""Leaders and followers of each window from percentiles of the net scores."""

from typing import Optional, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairtide.config import RoleSpec
from pairtide.operators.metrics import row_scores


def roles(edges: DataFrame, keys: Sequence[str], spec: RoleSpec) -> DataFrame:
    """``(…, role, asset, score)`` from edges."""
    return roles_of_scores(row_scores(edges, keys, spec.agg_func), keys, spec)


def roles_of_scores(scored: DataFrame, keys: Sequence[str], spec: RoleSpec) -> DataFrame:
    """``(…, role, asset, score)``: scores strictly beyond the percentiles; zero scores do not count."""
    scores = scored.where(F.col("score") != 0)
    cuts = scores.groupBy(*keys).agg(
        F.percentile("score", F.lit(spec.top_percentile / 100.0)).alias("upper"),
        F.percentile("score", F.lit(spec.bottom_percentile / 100.0)).alias("lower"),
    )
    marked = scores.join(cuts, list(keys)).withColumn(
        "role",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("score") > F.col("upper"), F.lit("leader")),
                    F.when(F.col("score") < F.col("lower"), F.lit("follower")),
                ),
                lambda r: r.isNotNull(),
            )
        ),
    )
    return marked.select(*keys, "role", "asset", "score")


def role_pairs(assigned: DataFrame, keys: Sequence[str], order: Optional[DataFrame] = None) -> DataFrame:
    """Leaders beside followers by their order in the window; the longer list loses its tail.

    ``order(asset, place)``, with any of ``keys`` beside, gives the order of the panel's columns or of each window's
    universe; without it, and for assets it does not name, assets go by name.
    """
    by = [F.col("asset")]
    if order is not None:
        on = [k for k in keys if k in order.columns] + ["asset"]
        assigned, by = assigned.join(order.select(*on, "place"), on, "left"), [F.col("place").asc_nulls_last(), F.col("asset")]
    place = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(*by))
    placed = assigned.withColumn("rank", place)
    leaders = placed.where("role = 'leader'").select(*keys, "rank", F.col("asset").alias("leader"))
    followers = placed.where("role = 'follower'").select(*keys, "rank", F.col("asset").alias("follower"))
    return leaders.join(followers, [*keys, "rank"])
