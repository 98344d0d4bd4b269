"""Recurrences along a timeline, written so that no timeline has to fit in one task.

Both cut the timeline into stretches and solve each stretch on its own. Sums pass one small value from a stretch to
the next; state machines pass the composition of all earlier stretches, by a prefix scan.
"""

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairtide.operators.scan import before_each
from pairtide.session import stage

STATE_STRETCH = 256


def discounted_sum(rows: DataFrame, keys: Sequence[str], order: str, value: str, decay: float, name: str) -> DataFrame:
    """``s[t] = value[t] + decay * s[t - 1]`` along the gap-free integer ``order``.

    A stretch is as long as ``decay ** length`` stays near 1e-100. What an earlier stretch
    adds beyond its neighbour is below that factor and lost to double precision anyway.
    """
    if not 0 <= decay < 1:
        raise ValueError("decay must lie in [0, 1)")
    if decay == 0:
        return rows.withColumn(name, F.col(value))
    length = max(1, int(100 / -math.log10(decay)))
    place = F.col(order) % length
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / F.lit(length)))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = F.sum(F.col(value) * F.pow(F.lit(decay), -place)).over(inside) * F.pow(F.lit(decay), place)
    local = cut.withColumn("_local", grown)
    ends = local.groupBy(*keys, "_stretch").agg(F.max_by("_local", order).alias("_carry"))
    carry = ends.withColumn("_stretch", F.col("_stretch") + 1)
    carried = F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(decay), place + 1)
    return (
        local.join(carry, [*keys, "_stretch"], "left").withColumn(name, F.col("_local") + carried).drop("_local", "_carry", "_stretch")
    )


def exponential_average(rows: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float, name: str) -> DataFrame:
    """Exponential moving average that starts at the first value."""
    weighted = F.when(F.col(order) == 0, F.col(value)).otherwise(F.col(value) * alpha)
    return discounted_sum(rows.withColumn("_w", weighted), keys, order, "_w", 1.0 - alpha, name).drop("_w")


def follow_states(steps: DataFrame, keys: Sequence[str], order: str, moves: str, start: int) -> DataFrame:
    """Walk a state machine along ``order``: adds ``state_before`` and ``state_after``.

    ``moves`` is an array with the next state of every state (numbered from 0), ``order`` an integer from 0. Maps
    compose, so each stretch first becomes one map, the maps before it give every stretch its
    entry state, and the stretches are then walked in parallel.
    """
    keys = list(keys)
    stretches = (
        steps.withColumn("_stretch", F.floor(F.col(order) / F.lit(STATE_STRETCH)))
        .groupBy(*keys, "_stretch")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(moves).alias("to")))).alias("_walk"))
    )
    stretches = stage(stretches, "state_stretches")
    states = F.sequence(F.lit(0), F.size(F.element_at("_walk", 1)["to"]) - 1)
    composed = F.transform(states, lambda s: F.aggregate("_walk", s, lambda now, step: F.get(step["to"], now)))
    maps = stretches.select(*keys, "_stretch", composed.alias("_map"))
    size = maps.agg(F.max(F.size("_map"))).first()[0] or 1
    same = F.sequence(F.lit(0), F.lit(size - 1))
    earlier = before_each(maps, keys, "_stretch", "_map", lambda a, b: F.transform(a, lambda s: F.get(b, s)), same, "_before")
    entered = earlier.select(*keys, "_stretch", F.get("_before", F.lit(start)).alias("_entry"))
    begin = F.struct(F.col("_entry").alias("now"), F.array().cast("array<struct<at:int,before:int,after:int>>").alias("seen"))
    walked = F.aggregate(
        "_walk",
        begin,
        lambda acc, step: F.struct(
            F.get(step["to"], acc["now"]).alias("now"),
            F.concat(
                acc["seen"],
                F.array(
                    F.struct(step["at"].cast("int").alias("at"), acc["now"].alias("before"), F.get(step["to"], acc["now"]).alias("after"))
                ),
            ).alias("seen"),
        ),
        lambda acc: acc["seen"],
    )
    path = stretches.join(entered, [*keys, "_stretch"]).select(*keys, F.explode(walked).alias("_step"))
    return path.select(
        *keys, F.col("_step.at").alias(order), F.col("_step.before").alias("state_before"), F.col("_step.after").alias("state_after")
    )
