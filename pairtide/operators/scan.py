"""Prefix sums of any associative kind along keyed timelines of any length.

A timeline is cut into stretches, each summarised on its own. What stands before a stretch is the combination of all
earlier summaries; it is found in levels, as a tree with ``FAN`` children: summaries of ``FAN`` neighbours are combined
on the way up, and on the way down every group hands its children what stands before them. No task and no row holds
more than ``FAN`` summaries, whatever the length of a timeline.
"""

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairtide.session import stage

FAN = 64


def before_each(
    summaries: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    combine: Callable[[Column, Column], Column],
    neutral: Column,
    name: str,
    fan: int = FAN,
) -> DataFrame:
    """``(keys, at, name)``: the combination of ``value`` over all rows of the key with a smaller ``at``.

    ``summaries`` has one row per (keys, ``at``), ``at`` an integer that may have gaps. ``combine(earlier, later)`` is
    associative with ``neutral`` on its left, and of the type of ``value``, as is ``neutral``.
    """
    kind = summaries.schema[value].dataType
    level = stage(summaries.select(*keys, F.col(at).cast("long").alias("_at"), F.col(value).alias("_value")), "scan")
    first, last = level.agg(F.min("_at"), F.max("_at")).first()
    first, last = first or 0, (last or 0) - (first or 0)
    level = level.withColumn("_at", F.col("_at") - first)
    groups = []
    while True:
        parent = F.floor(F.col("_at") / F.lit(fan)).alias("_parent")
        gathered = level.groupBy(*keys, parent).agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_all"))
        groups.append(stage(gathered, "scan_groups"))
        last //= fan
        if last == 0:
            break
        whole = F.aggregate("_all", neutral.cast(kind), lambda acc, s: combine(acc, s["_value"]).cast(kind))
        level = groups[-1].select(*keys, F.col("_parent").alias("_at"), whole.alias("_value"))
    entry = groups[-1].select(*keys, "_parent", "_all", neutral.cast(kind).alias("_entry"))
    for below in [*groups[-2::-1], None]:
        # the children of every group, each with what stands before it
        seen = F.struct(F.col("_entry").alias("now"), F.array().cast(f"array<struct<_at:bigint,_entry:{kind.simpleString()}>>").alias("seen"))
        placed = F.aggregate(
            "_all",
            seen,
            lambda acc, s: F.struct(
                combine(acc["now"], s["_value"]).cast(kind).alias("now"),
                F.concat(acc["seen"], F.array(F.struct(s["_at"].alias("_at"), acc["now"].alias("_entry")))).alias("seen"),
            ),
            lambda acc: acc["seen"],
        )
        children = entry.select(*keys, F.inline(placed))
        if below is None:
            return children.select(*keys, (F.col("_at") + first).alias(at), F.col("_entry").alias(name))
        entry = below.join(children.withColumnRenamed("_at", "_parent"), [*keys, "_parent"])
