"""Whole analyses: fixed lookback, universe-aware, placebo."""

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.config import PairSpec, RoleSpec
from pairtide.operators.metrics import edge_metrics, numbered, rolling_metrics, scores_from_partials, tile_metrics
from pairtide.operators.pairs import pair_edges, pair_edges_of_series, pair_partials, shuffled_series
from pairtide.operators.roles import roles_of_scores
from pairtide.operators.timeline import calendar, shuffled_calendar
from pairtide.operators.universe import window_members
from pairtide.operators.windows import rolling_windows
from pairtide.session import stage


def require_history(indexed: DataFrame, spec: PairSpec) -> None:
    """Raise if the panel is too short for a single window; costs one small aggregation."""
    rows = indexed.agg(F.max("pos") + 1).first()[0] or 0
    if spec.lookback >= rows:
        raise ValueError(f"lookback {spec.lookback} must be less than the {rows} rows of the panel")


def rolling_edges(indexed: DataFrame, spec: PairSpec, universe: Optional[DataFrame] = None) -> DataFrame:
    """Edges of all rolling windows with their end timestamp; with a universe, of its members only.

    A panel too short for a single window is an error, here and in the metrics and roles of a universe.
    """
    require_history(indexed, spec)
    windows = rolling_windows(calendar(indexed), spec)
    members = None if universe is None else window_members(windows, universe, indexed).select("end_pos", "asset")
    plain = windows.select("start_pos", "end_pos", "end_ts")
    return pair_edges(indexed, plain, spec, members).join(plain.select("end_pos", "end_ts"), "end_pos")


def fixed_metrics(indexed: DataFrame, lookbacks: Sequence[int], spec: PairSpec) -> DataFrame:
    """Metric series of several fixed lookbacks, one run each: ``run_id`` is ``fixed_<lookback>``."""
    return rolling_metrics(indexed, spec, lookbacks).withColumn("run_id", F.format_string("fixed_%02d", "lookback"))


def universe_windows(indexed: DataFrame, spec: PairSpec, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows with at least two members, each with the one before it, and their members ``(end_pos, asset, place)``."""
    require_history(indexed, spec)
    windows = rolling_windows(calendar(indexed), spec).select("start_pos", "end_pos", "end_ts")
    listed = window_members(windows, universe, indexed).groupBy("end_pos", "asset").agg(F.min("rank").alias("place"))
    members = stage(listed, "window_members")
    alive = members.groupBy("end_pos").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("end_pos")
    placed = stage(windows.join(numbered(alive), "end_pos"), "universe_windows")
    before = placed.select((F.col("seq") + 1).alias("seq"), F.col("start_pos").alias("prev_start_pos"), F.col("end_pos").alias("prev_end_pos"))
    return placed.join(before, "seq", "left"), members


def universe_metrics(indexed: DataFrame, spec: PairSpec, universe: DataFrame, mode: str = "strict") -> DataFrame:
    """Metric series when every window has its own universe; windows with fewer than two members vanish."""
    windows, members = universe_windows(indexed, spec, universe)
    partials = pair_partials(indexed, windows, spec, members.select("end_pos", "asset"))
    return tile_metrics(partials, ["start_pos", "end_pos"], mode).join(windows.select("end_pos", "end_ts", "seq"), "end_pos")


def window_roles(indexed: DataFrame, spec: PairSpec, role: RoleSpec, universe: Optional[DataFrame] = None) -> DataFrame:
    """Leaders and followers ``(end_pos, end_ts, role, asset, score)`` of all rolling windows, without storing edges."""
    require_history(indexed, spec)
    if universe is None:
        windows, members = rolling_windows(calendar(indexed), spec).select("start_pos", "end_pos", "end_ts"), None
    else:
        windows, members = universe_windows(indexed, spec, universe)
        windows, members = windows.select("start_pos", "end_pos", "end_ts"), members.select("end_pos", "asset")
    scores = scores_from_partials(pair_partials(indexed, windows, spec, members), ["end_pos"], role.agg_func)
    return roles_of_scores(scores, ["end_pos"], role).join(windows.select("end_pos", "end_ts"), "end_pos")


def placebo_metrics(indexed: DataFrame, spec: PairSpec, seed: int) -> DataFrame:
    """Metric series on shuffled rows; only windows whose first date does not come last exist."""
    order = shuffled_calendar(calendar(indexed), seed)
    series = stage(shuffled_series(indexed, order, spec.lookback, spec.update_freq), "placebo_series")
    ends = series.select(F.col("window_id").alias("end_pos"), "end_ts").distinct()
    sequence = numbered(ends.select("end_pos"))
    edges = pair_edges_of_series(series, spec).withColumnRenamed("window_id", "end_pos").join(sequence, "end_pos")
    return edge_metrics(edges, [], "seq").join(sequence, "seq").join(ends, "end_pos")
