"""Adaptive lookbacks: candidate signals, greedy path, action logs, episodes, state vectors."""

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.config import PairSpec
from pairtide.functions.measures import text_hash
from pairtide.operators.metrics import metrics_from_partials, regime, tile_metrics
from pairtide.operators.pairs import pair_edges, pair_partials, window_returns
from pairtide.operators.recurrences import exponential_average, follow_states
from pairtide.operators.timeline import calendar
from pairtide.operators.windows import candidate_windows
from pairtide.session import stage

# Order of the state vector.
STATE_FEATURES = (
    "norm_lookback", "mean_abs", "row_range", "stability_matrix", "stability_rows", "delta_mean", "returns_mean",
    "returns_vol", "cross_sectional_vol", "leader_score", "laggard_score", "spread", "delta_norm", "ema_mean_abs",
)
ACTION_MODES = ("absolute", "relative", "hybrid")


@dataclass(frozen=True)
class LookbackSpec:
    """Range and step of the lookback, and how actions move it."""

    min_lookback: int = 10
    max_lookback: int = 120
    step: int = 5
    mode: str = "absolute"
    discrete: bool = True

    def __post_init__(self):
        if self.min_lookback < 2:
            raise ValueError("min_lookback must be at least 2")
        if self.max_lookback <= self.min_lookback:
            raise ValueError("max_lookback must exceed min_lookback")
        if self.mode not in ACTION_MODES:
            raise ValueError(f"mode must be one of {', '.join(ACTION_MODES)}")
        if self.step < 1:
            raise ValueError("step must be at least 1")

    @property
    def midpoint(self) -> int:
        return (self.min_lookback + self.max_lookback) // 2

    def clip(self, value: int) -> int:
        return max(self.min_lookback, min(self.max_lookback, value))

    def reachable(self) -> list:
        """Every lookback the greedy walk can visit: clipped steps from the midpoint."""
        found, frontier = {self.midpoint}, [self.midpoint]
        while frontier:
            at = frontier.pop()
            for target in (self.clip(at - self.step), self.clip(at + self.step)):
                if target not in found:
                    found.add(target)
                    frontier.append(target)
        return sorted(found)


def candidate_signals(indexed: DataFrame, spec: PairSpec, range_: LookbackSpec) -> DataFrame:
    """``(end_ts, end_pos, lookback, signal)`` for every date and reachable lookback."""
    first = max(range_.max_lookback, spec.lookback)
    windows = candidate_windows(calendar(indexed), range_.reachable(), first)
    metrics = metrics_from_partials(pair_partials(indexed, windows, spec).repartition("start_pos", "end_pos"), ["start_pos", "end_pos"])
    return windows.join(metrics, ["start_pos", "end_pos"]).select(
        "end_ts", "end_pos", "lookback", F.col("mean_abs_matrix").alias("signal")
    )


def greedy_path(signals: DataFrame, range_: LookbackSpec) -> DataFrame:
    """``(end_ts, end_pos, lookback, signal)``: each date moves by at most one step to the strongest signal.

    Ties go to the smallest lookback; a date without any valid candidate keeps the
    lookback and yields no row.
    """
    states = range_.reachable()
    number = {lookback: i for i, lookback in enumerate(states)}
    signal_of = F.map_from_entries(F.collect_list(F.struct("lookback", "signal")))
    dated = signals.where(F.col("signal").isNotNull()).groupBy("end_pos", "end_ts").agg(signal_of.alias("signal_of"))

    def best_move(at: int) -> Column:
        options = sorted({range_.clip(at - range_.step), at, range_.clip(at + range_.step)})
        offered = F.array(*[F.struct(F.try_element_at("signal_of", F.lit(o)).alias("s"), F.lit(-number[o]).alias("n")) for o in options])
        valid = F.filter(offered, lambda o: o["s"].isNotNull())
        return F.coalesce(-F.array_max(valid)["n"], F.lit(number[at]))

    moves = dated.withColumn("to", F.array(*[best_move(at) for at in states]))
    walked = follow_states(moves, [], "end_pos", "to", number[range_.midpoint])
    lookbacks = F.array(*[F.lit(s) for s in states])
    chosen = walked.select("end_pos", F.get(lookbacks, F.col("state_after")).alias("lookback"))
    return chosen.join(dated, "end_pos").select(
        "end_ts", "end_pos", "lookback", F.try_element_at("signal_of", F.col("lookback")).alias("signal")
    ).where(F.col("signal").isNotNull())


def action_target(range_: LookbackSpec, current: Column, action: Column, target: Optional[Column] = None) -> Column:
    """Unclipped lookback an action asks for.

    Discrete: absolute counts up from the minimum; relative is 0, 1, 2 for down, stay, up;
    hybrid is 0 .. 4 for minimum, down, stay, up, maximum. Continuous: absolute rounds half
    to even; relative is a factor of the step; hybrid averages ``target`` with the relative move.
    """
    step = range_.step
    if range_.mode == "absolute":
        return action.cast("int") + range_.min_lookback if range_.discrete else F.rint(action).cast("int")
    if range_.mode == "relative":
        if range_.discrete:
            return current + (action.cast("int") - 1) * step
        return (current + action * step).cast("int")
    if range_.discrete:
        return (
            F.when(action == 0, F.lit(range_.min_lookback))
            .when(action == 4, F.lit(range_.max_lookback))
            .otherwise(current + (action.cast("int") - 2) * step)
        )
    return (0.5 * (target + current + action * step)).cast("int")


def checked_action(range_: LookbackSpec, action: Column) -> Column:
    """``action``, or an error at run time for a discrete action outside the mode's range; NULL stays NULL."""
    if not range_.discrete or range_.mode == "absolute":  # absolute actions are clipped instead
        return action
    last = 2 if range_.mode == "relative" else 4
    message = F.concat(F.lit(f"action outside 0 .. {last} in mode {range_.mode}: "), action.cast("string"))
    return F.when(action.isNull() | action.between(0, last), action).otherwise(F.raise_error(message).cast("int"))


def lookback_path(actions: DataFrame, keys: list, order: str, range_: LookbackSpec) -> DataFrame:
    """Lookback after each action: adds ``lookback`` and ``prev_lookback`` to the action log.

    ``actions`` has ``action`` and, for continuous hybrid actions, ``target``. Every timeline
    starts at the midpoint. ``order`` counts up by one per key. A discrete action that the mode does not know is an error
    of the job that meets it.
    """
    actions = actions.withColumn("action", checked_action(range_, F.col("action")))
    low, high = range_.min_lookback, range_.max_lookback
    target = F.col("target") if "target" in actions.columns else None

    def clipped(current: Column) -> Column:
        wanted = action_target(range_, current, F.col("action"), target)
        return (F.greatest(F.lit(low), F.least(F.lit(high), wanted)) - low).cast("int")

    if range_.mode == "absolute":
        moved = actions.withColumn("lookback", clipped(F.lit(0)) + low)
        before = moved.select(*keys, (F.col(order) + 1).cast(moved.schema[order].dataType).alias(order), F.col("lookback").alias("_before"))
        return moved.join(before, [*keys, order], "left").select(*moved.columns, F.coalesce("_before", F.lit(range_.midpoint)).alias("prev_lookback"))
    steps = actions.withColumn("_to", F.transform(F.sequence(F.lit(low), F.lit(high)), clipped))
    walked = follow_states(steps, keys, order, "_to", range_.midpoint - low)
    return actions.join(walked, [*keys, order]).select(
        *actions.columns, (F.col("state_after") + low).alias("lookback"), (F.col("state_before") + low).alias("prev_lookback")
    )


def random_actions(rows: DataFrame, seed: int, actions: int, *identity: str) -> DataFrame:
    """A repeatable random action per row, from a hash of its identity and the seed."""
    salted = text_hash(*[F.col(c) for c in identity], F.lit(seed))
    return rows.withColumn("action", F.pmod(salted, F.lit(actions)).cast("int"))


def episodes(cal: DataFrame, count: int, length: int, first_pos: int, seed: int) -> DataFrame:
    """``(episode, step, pos, ts, done)``: slices of ``length`` rows from hash-random starts."""
    size = cal.agg(F.max("pos") + 1).scalar()
    spark = cal.sparkSession
    last_start = F.greatest(F.lit(first_pos), size - length)
    starts = spark.range(count).select(
        F.col("id").cast("int").alias("episode"),
        (F.lit(first_pos) + F.pmod(F.xxhash64("id", F.lit(seed)), last_start - first_pos + 1)).cast("int").alias("start"),
    )
    end = F.least(size, F.col("start") + length)
    steps = starts.select("episode", "start", end.alias("end"), F.explode(F.sequence(F.col("start"), end - 1)).alias("pos"))
    return steps.join(cal, "pos").select(
        "episode", (F.col("pos") - F.col("start")).alias("step"), "pos", "ts", (F.col("pos") == F.col("end") - 1).alias("done")
    )


def with_reset(decisions: DataFrame, range_: LookbackSpec) -> DataFrame:
    """Add the state before the first action: the first date seen at the midpoint, numbered seq 0."""
    numbered = decisions.withColumn("seq", F.col("step") + 1)
    reset = decisions.where("step = 0").withColumns(
        {
            "seq": F.lit(0),
            "lookback": F.lit(range_.midpoint),
            "prev_lookback": F.lit(range_.midpoint),
            "action": F.lit(None).cast(decisions.schema["action"].dataType),
            "done": F.lit(False),
        }
    )
    return numbered.unionByName(reset)


def decision_states(
    indexed: DataFrame, decisions: DataFrame, spec: PairSpec, range_: LookbackSpec, ema_alpha: Optional[float] = None
) -> DataFrame:
    """What each decision sees: metrics, regime and scores of the window it chose.

    ``decisions(episode, seq, pos, lookback, prev_lookback, …)``. A window chosen by several
    episodes is measured once. Undefined stabilities count as 0.
    """
    placed = decisions.withColumns(
        {"end_pos": F.col("pos"), "start_pos": F.greatest(F.col("pos") - F.col("lookback") + 1, F.lit(0))}
    )
    placed = stage(placed, "placed_decisions")
    before = placed.select(
        "episode", (F.col("seq") + 1).alias("seq"), F.col("start_pos").alias("prev_start_pos"), F.col("end_pos").alias("prev_end_pos")
    )
    followed = placed.select("episode", "seq", "start_pos", "end_pos").join(before, ["episode", "seq"], "left")
    keys = ["start_pos", "end_pos", "prev_start_pos", "prev_end_pos"]
    found = tile_metrics(pair_partials(indexed, followed.select(*keys).distinct(), spec), keys)
    windows = placed.select("start_pos", "end_pos").distinct()
    measured = followed.fillna(-1, ["prev_start_pos", "prev_end_pos"]).join(found, keys).select(
        "episode",
        "seq",
        F.col("mean_abs_matrix").alias("mean_abs"),
        F.col("max_abs_matrix").alias("max_abs"),
        F.col("row_sum_range").alias("row_range"),
        F.col("row_sum_std").alias("row_std"),
        F.coalesce("stability_matrix_corr", F.lit(0.0)).alias("stability_matrix"),
        F.coalesce("stability_rowsum_corr", F.lit(0.0)).alias("stability_rows"),
        "leader_score",
        "laggard_score",
        F.col("max_abs_matrix").alias("top_pair"),
        (F.col("leader_score") - F.col("laggard_score")).alias("spread"),
    )
    measured = smoothed(measured, ["episode"], "seq", ema_alpha)
    returns = regime(window_returns(indexed, windows))
    span = float(range_.max_lookback - range_.min_lookback)
    return (
        placed.join(measured, ["episode", "seq"])
        .join(returns, ["start_pos", "end_pos"])
        .withColumn("norm_lookback", (F.col("lookback") - range_.min_lookback) / span)
        .withColumn("delta_norm", (F.col("lookback") - F.col("prev_lookback")) / span)
    )


def smoothed(metrics: DataFrame, keys: list, seq: str, alpha: Optional[float] = None) -> DataFrame:
    """Exponential smoothing of the metrics, and the change of the (smoothed) mean signal.

    Without ``alpha`` values stay raw and the first change is the value itself; smoothed
    series start with a change of 0.
    """
    names = ["mean_abs", "max_abs", "row_range", "row_std", "stability_matrix", "stability_rows"]
    timeline = Window.partitionBy(*keys).orderBy(seq)
    if alpha is None:
        change = F.col("mean_abs") - F.coalesce(F.lag("mean_abs").over(timeline), F.lit(0.0))
        return metrics.withColumn("delta_mean", change).withColumn("ema_mean_abs", F.col("mean_abs"))
    long = metrics.unpivot([*keys, seq], names, "metric", "value")
    averaged = exponential_average(long, [*keys, "metric"], seq, "value", alpha, "ema")
    wide = averaged.groupBy(*keys, seq).pivot("metric", names).agg(F.first("ema"))
    change = F.coalesce(F.col("mean_abs") - F.lag("mean_abs").over(timeline), F.lit(0.0))
    others = [c for c in metrics.columns if c not in names]
    return metrics.select(*others).join(wide, [*keys, seq]).withColumn("delta_mean", change).withColumn(
        "ema_mean_abs", F.col("mean_abs")
    )


def state_vector(states: DataFrame) -> DataFrame:
    """The fourteen state features as one float array."""
    return states.withColumn("observation", F.array(*[F.col(f).cast("float") for f in STATE_FEATURES]))


def transitions(rewarded: DataFrame) -> DataFrame:
    """``(episode, step, observation, action, reward, done, lookback)``: each action with the state before it."""
    timeline = Window.partitionBy("episode").orderBy("seq")
    seen = state_vector(rewarded).withColumn("before", F.lag("observation").over(timeline))
    return seen.where("seq > 0").select(
        "episode", "step", F.col("before").alias("observation"), "action", "reward", "done", "lookback"
    )


def decision_history(rewarded: DataFrame) -> DataFrame:
    """Flat decision log with prefixed metric, regime and score columns."""
    metric = ("mean_abs", "max_abs", "row_range", "row_std", "stability_matrix", "stability_rows", "delta_mean", "ema_mean_abs")
    market = ("returns_mean", "returns_vol", "cross_sectional_vol", "dispersion")
    score = ("leader_score", "laggard_score", "spread", "top_pair")
    return rewarded.where("seq > 0").select(
        "episode", F.col("ts").alias("date"), "lookback", "reward", "delta_norm",
        *[F.col(c).alias(f"metric_{c}") for c in metric],
        *[F.col(c).alias(f"regime_{c}") for c in market],
        *[F.col(c).alias(f"signature_{c}") for c in score],
    )


def chosen_edges(indexed: DataFrame, path: DataFrame, spec: PairSpec) -> DataFrame:
    """Matrices of the lookback each date settled on."""
    windows = path.select("end_ts", "end_pos", (F.col("end_pos") - F.col("lookback") + 1).alias("start_pos"))
    return pair_edges(indexed, windows, spec).join(windows, ["start_pos", "end_pos"])


def adaptive_metrics(indexed: DataFrame, spec: PairSpec, range_: LookbackSpec) -> DataFrame:
    """Metric time series along the greedy path, with the lookback and signal of each date."""
    path = stage(greedy_path(candidate_signals(indexed, spec, range_), range_), "greedy_path")
    placed = path.withColumn("start_pos", F.col("end_pos") - F.col("lookback") + 1)
    before = placed.select((F.col("end_pos") + 1).alias("end_pos"), F.col("start_pos").alias("prev_start_pos"), F.col("end_pos").alias("prev_end_pos"))
    windows = placed.select("start_pos", "end_pos").join(before, "end_pos", "left")
    metrics = tile_metrics(pair_partials(indexed, windows, spec), ["start_pos", "end_pos"])
    return placed.join(metrics, ["start_pos", "end_pos"], "left").drop("start_pos", "cells", "shared_cells", "prev_cells", "leader_score", "laggard_score")
