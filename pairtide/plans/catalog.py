"""Every query of the repository by name: ``(spark, sf_dir) -> DataFrame``."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairtide.config import PairSpec, RoleSpec
from pairtide.functions import measures
from pairtide.operators import bars, features, kpis, lookback, metrics, offline, pairs, quality, reports, rewards, roles
from pairtide.operators import stats, timeline, universe, windows
from pairtide.operators.whole import whole_matrix
from pairtide.plans import panels, scenario
from pairtide.session import stage, staged_folder, task_count
from pairtide.sources import runs, sinks
from pairtide.streaming import series
from pairtide.streaming.bars import run_to_end, streaming_bars

SPEC = PairSpec(lookback=12, lag=1)
RANGE = lookback.LookbackSpec(min_lookback=8, max_lookback=16, step=2, mode="absolute")
RELATIVE = lookback.LookbackSpec(min_lookback=8, max_lookback=16, step=2, mode="relative")
RUN_LOOKBACKS = (8, 12, 16)
MAXIMUM = 15
GAP_WINDOW = 20
DAYS = 120
EMA_ALPHA = 0.3


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six decimals without negative zero, timestamps to dates, integers to long."""
    columns = []
    for field in frame.schema:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("integer", "short", "byte"):
            column = column.cast("long")
        elif kind == "array":
            column = F.array_join(column, ",")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def _week(spark, sf):
    return panels.brand_week(spark, sf)


def _edges(spark, sf, spec=SPEC):
    return scenario.rolling_edges(_week(spark, sf), spec)


def _edge_rows(edges: DataFrame) -> DataFrame:
    return rounded(edges.select("end_ts", "asset_i", "asset_j", "value"))


def _edge_query(spec: PairSpec):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _edge_rows(_edges(spark, sf, spec))

    return run


# ------------------------------------------------------------------ panels


def bars_weekly(spark, sf):
    return rounded(_week(spark, sf).select("ts", "asset", "price"))


def bars_ohlc(spark, sf):
    order = F.struct("ts", "l_orderkey", "l_linenumber", "price")
    weekly = bars.ohlc(panels.brand_prices(spark, sf), "week", order)
    values = [panels.six_decimals(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "median")]
    return rounded(weekly.select(F.col("bar_ts").alias("ts"), "asset", *values))


def bars_resampled(spark, sf):
    daily = panels.nation_day(spark, sf).select("ts", "asset", "price")
    kinds = [bars.resample(daily, "month", kind).withColumn("kind", F.lit(kind)) for kind in bars.DEFAULT_METHODS]
    return rounded(reduce(DataFrame.unionByName, kinds))


def panel_usable(spark, sf):
    return rounded(timeline.panel_is_usable(panels.brand_day(spark, sf)))


def returns(spark, sf):
    return rounded(timeline.returns(panels.brand_day(spark, sf)).select("ts", "asset", "prev_pos", "ret"))


def limit_days(spark, sf):
    return rounded(timeline.limit_days(_week(spark, sf), DAYS).select("ts", "asset", "price"))


def before_date(spark, sf):
    return rounded(timeline.before(panels.nation_day(spark, sf), "1998-01-01").select("ts", "asset", "price"))


def rolling_windows(spark, sf):
    cal = timeline.calendar(_week(spark, sf))
    listed = windows.rolling_windows(cal, PairSpec(lookback=12, update_freq=3))
    starts = cal.select(F.col("pos").alias("start_pos"), F.col("ts").alias("start_ts"))
    return rounded(listed.join(starts, "start_pos").select("start_ts", "end_ts", "start_pos", "end_pos", "prev_end_pos"))


def window_returns(spark, sf):
    week = _week(spark, sf)
    arrays = pairs.window_returns(week, windows.rolling_windows(timeline.calendar(week), SPEC))
    return rounded(arrays.select("end_pos", "asset", F.posexplode("rets").alias("row", "ret")))


# ------------------------------------------------------------------ universe


def _daily_universe(spark, sf):
    day = panels.brand_day(spark, sf)
    return universe.previous_month_universe(timeline.calendar(day), panels.brand_month_universe(spark, sf), MAXIMUM)


def _universe(spark, sf):
    daily = _daily_universe(spark, sf).where(F.col("symbols").isNotNull())
    return universe.filtered_universe(panels.brand_day(spark, sf), daily, GAP_WINDOW)


def universe_prev_month(spark, sf):
    return rounded(_daily_universe(spark, sf).select("ts", "symbols"))


def universe_filtered(spark, sf):
    return rounded(_universe(spark, sf).select("ts", "symbols"))


def universe_exact(spark, sf):
    cal = timeline.calendar(panels.brand_day(spark, sf))
    return rounded(universe.universe_on(cal, _universe(spark, sf)).select("ts", F.size("symbols").alias("n"), "symbols"))


def gated_ffill(spark, sf):
    day = panels.brand_day(spark, sf)
    return rounded(universe.gated_fill(day, stage(_universe(spark, sf), "universe")).select("ts", "asset", "price", "filled"))


def _week_windows(spark, sf):
    week = _week(spark, sf)
    return week, windows.rolling_windows(timeline.calendar(week), SPEC).select("start_pos", "end_pos", "end_ts")


def universe_asof(spark, sf):
    week, listed = _week_windows(spark, sf)
    members = universe.window_members(listed, _universe(spark, sf), week)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset"))), lambda r: r["asset"])
    return rounded(members.groupBy("end_ts").agg(ordered.alias("symbols")))


def universe_edges(spark, sf):
    return _edge_rows(scenario.rolling_edges(_week(spark, sf), SPEC, stage(_universe(spark, sf), "universe")))


# ------------------------------------------------------------------ matrices


def explicit_windows(spark, sf):
    week = _week(spark, sf)
    cal = timeline.calendar(week)
    months = cal.select(F.trunc("ts", "MM").alias("m")).distinct()
    asked = months.select(
        F.col("m").cast("timestamp_ntz").alias("start_ts"), F.add_months("m", 3).cast("timestamp_ntz").alias("end_ts")
    )
    placed = stage(windows.explicit_windows(cal, asked), "explicit_windows")
    edges = pairs.pair_edges(week, placed.select("start_pos", "end_pos").distinct(), SPEC)
    return rounded(placed.join(edges, ["start_pos", "end_pos"]).select("start_ts", "end_ts", "asset_i", "asset_j", "value"))


def _single_matrix(spec):
    """One matrix of daily brand prices over the whole history."""
    return lambda spark, sf: rounded(whole_matrix(panels.brand_day(spark, sf), spec))


def custom_measure(spark, sf):
    """A measure of one's own: lag-1 covariance difference, as a column expression."""

    def covariance(x, y, lag):
        a, b = measures.aligned(x, y, lag)
        return measures.inner(measures.centred(a), measures.centred(b)) / F.size(a)

    week, listed = _week_windows(spark, sf)
    arrays = pairs.window_returns(week, listed)
    edges = pairs.pair_measure(arrays, ["end_pos"], lambda x, y: 1000 * (covariance(x, y, 1) - covariance(x, y, -1)))
    return _edge_rows(edges.join(listed, "end_pos"))


def spearman_columns(spark, sf):
    week, listed = _week_windows(spark, sf)
    arrays = pairs.window_returns(week, listed)
    edges = pairs.pair_measure(arrays, ["end_pos"], lambda x, y: measures.ccf_at_lag(x, y, 1, measures.spearman))
    return _edge_rows(edges.join(listed, "end_pos"))


def matrix_snapshot(spark, sf):
    week, listed = _week_windows(spark, sf)
    bounds = listed.agg(F.min("end_pos").alias("a"), F.max("end_pos").alias("b"))
    ends = bounds.select(F.explode(F.array("a", "b")).alias("end_pos")).distinct()
    chosen = listed.join(ends, "end_pos", "left_semi")
    edges = pairs.pair_edges(week, chosen, SPEC).join(chosen, ["start_pos", "end_pos"])
    # a column per asset of the panel: a wide matrix needs its names beforehand
    names = [r.asset for r in week.select("asset").distinct().orderBy("asset").collect()]
    return rounded(reports.matrix_snapshot(edges, names))


def row_scores(spark, sf):
    return rounded(metrics.row_scores(_edges(spark, sf), ["end_ts"]))


def row_scores_mean(spark, sf):
    return rounded(metrics.row_scores(_edges(spark, sf), ["end_ts"], "mean"))


def role_table(spark, sf):
    return rounded(scenario.window_roles(_week(spark, sf), SPEC, RoleSpec(top_percentile=80, bottom_percentile=20)).drop("end_pos"))


def leaders_followers(spark, sf):
    assigned = stage(scenario.window_roles(_week(spark, sf), SPEC, RoleSpec()), "roles")
    return rounded(roles.role_pairs(assigned, ["end_ts"]))


def universe_pairs(spark, sf):
    """Leaders and followers of each window's universe, in the order of the universe's list."""
    week, universe_ = _week(spark, sf), stage(_universe(spark, sf), "universe")
    assigned = stage(scenario.window_roles(week, SPEC, RoleSpec(), universe_), "universe_roles")
    order = scenario.universe_windows(week, SPEC, universe_)[1]
    return rounded(roles.role_pairs(assigned, ["end_pos", "end_ts"], order).drop("end_pos"))


# ------------------------------------------------------------------ metrics


def metrics_timeseries(spark, sf):
    return rounded(metrics.rolling_metrics(_week(spark, sf), SPEC).drop("end_pos", "lookback"))


def metrics_common(spark, sf):
    members = stage(_universe(spark, sf), "universe")
    found = scenario.universe_metrics(_week(spark, sf), SPEC, members, "common")
    return rounded(found.select("end_ts", *metrics.WINDOW_METRICS))


def metrics_strict(spark, sf):
    members = stage(_universe(spark, sf), "universe")
    found = scenario.universe_metrics(_week(spark, sf), SPEC, members, "strict")
    return rounded(found.select("end_ts", *metrics.WINDOW_METRICS))


def summary(spark, sf):
    return rounded(metrics.summarize(metrics.rolling_metrics(_week(spark, sf), SPEC)))


def regime(spark, sf):
    week, listed = _week_windows(spark, sf)
    return rounded(metrics.regime(pairs.window_returns(week, listed)).join(listed, ["start_pos", "end_pos"]).drop("start_pos", "end_pos"), 8)


def sig_features(spark, sf):
    spec = PairSpec(method="signature", lookback=12)
    return rounded(metrics.score_features(stage(_edges(spark, sf, spec), "edges"), ["end_ts"]))


def _named_metrics(spark, sf):
    found = metrics.rolling_metrics(_week(spark, sf), SPEC).withColumn("seq", F.col("end_pos") - SPEC.lookback)
    named = found.select(
        F.lit("run").alias("run"), "seq", "end_ts",
        F.col("mean_abs_matrix").alias("mean_abs"), F.col("max_abs_matrix").alias("max_abs"),
        F.col("row_sum_range").alias("row_range"), F.col("row_sum_std").alias("row_std"),
        F.coalesce("stability_matrix_corr", F.lit(0.0)).alias("stability_matrix"),
        F.coalesce("stability_rowsum_corr", F.lit(0.0)).alias("stability_rows"),
    )
    return stage(named, "metrics")


def ema_metrics(spark, sf):
    return rounded(lookback.smoothed(_named_metrics(spark, sf), ["run"], "seq", EMA_ALPHA).drop("run", "seq"))


# ------------------------------------------------------------------ lookbacks and rewards


@panels.once
def _decisions(spark, sf):
    """A full-length episode whose absolute actions follow the date's position."""
    cal = timeline.calendar(_week(spark, sf)).where(F.col("pos") >= RANGE.max_lookback)
    log = cal.select(
        F.lit(0).alias("episode"), (F.col("pos") - RANGE.max_lookback).alias("step"), "pos", "ts",
        ((F.col("pos") * 7 + 3) % 9).alias("action"), F.lit(False).alias("done"),
    )
    return stage(lookback.with_reset(lookback.lookback_path(log, ["episode"], "step", RANGE), RANGE), "decisions")


def _states(spark, sf):
    return lookback.decision_states(_week(spark, sf), _decisions(spark, sf), SPEC, RANGE)


def candidate_signals(spark, sf):
    return rounded(lookback.candidate_signals(_week(spark, sf), SPEC, RANGE).drop("end_pos"))


def adaptive_lookback(spark, sf):
    signals = stage(lookback.candidate_signals(_week(spark, sf), SPEC, RANGE), "signals")
    return rounded(lookback.greedy_path(signals, RANGE).drop("end_pos"))


def adaptive_metrics(spark, sf):
    found = lookback.adaptive_metrics(_week(spark, sf), SPEC, RANGE)
    return rounded(found.select("end_ts", "lookback", "signal", *metrics.WINDOW_METRICS))


def action_path(spark, sf):
    cal = timeline.calendar(_week(spark, sf))
    log = cal.select(F.lit(0).alias("run"), F.col("pos").alias("step"), ((F.col("pos") * 5 + F.floor(F.col("pos") / 4)) % 3).cast("int").alias("action"))
    return rounded(lookback.lookback_path(log, ["run"], "step", RELATIVE))


def random_control(spark, sf):
    cal = timeline.calendar(_week(spark, sf)).where(F.col("pos") >= RANGE.max_lookback)
    log = lookback.random_actions(cal.select(F.lit(0).alias("run"), F.col("pos").alias("step"), "ts"), 7, 9, "ts")
    return rounded(lookback.lookback_path(log, ["run"], "step", RANGE))


def state_vectors(spark, sf):
    states = lookback.state_vector(_states(spark, sf))
    return rounded(states.select("seq", "ts", "lookback", *lookback.STATE_FEATURES), 5)


def reward_components(spark, sf):
    scored = rewards.with_reward(_states(spark, sf), RANGE, rewards.RewardTemplate())
    return rounded(scored.where("seq > 0").select("ts", "lookback", "S", "C", "E", "Sharpe", "LookbackPenalty", "reward"), 5)


def legacy_reward(spark, sf):
    scored = rewards.with_legacy_reward(_states(spark, sf), RANGE)
    return rounded(scored.where("seq > 0").select("ts", "lookback", "S", "C", "E", "LookbackPenalty", "reward"), 5)


def decision_history(spark, sf):
    scored = rewards.with_legacy_reward(_states(spark, sf), RANGE)
    return rounded(lookback.decision_history(scored).drop("episode"), 5)


def transitions(spark, sf):
    scored = rewards.with_legacy_reward(_states(spark, sf), RANGE)
    logged = lookback.transitions(stage(scored, "rewarded"))
    named = [F.get("observation", F.lit(i)).cast("double").alias(f) for i, f in enumerate(lookback.STATE_FEATURES)]
    return rounded(logged.select("step", "action", "reward", "lookback", *named), 4)


@panels.once
def _event_log(spark, sf):
    """Every user's events as an episode of decisions."""
    return stage(offline.logged_events(panels.table(spark, sf, "events"), "user_id", "ts", "event_id", "event_type", "value"), "event_log")


def episode_log(spark, sf):
    names = ("last_value", "last_action", "hours", "steps")
    seen = [F.get("observation", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return rounded(_event_log(spark, sf).select("episode", "step", "ts", *seen, "action", "reward", F.col("done").cast("int").alias("done")), 5)


def episode_totals(spark, sf):
    return rounded(offline.episode_totals(_event_log(spark, sf)), 4)


def behaviour_cloning(spark, sf):
    return rounded(offline.clone_behaviour(_event_log(spark, sf)))


def offline_gap(spark, sf):
    """Mean reward of the last event of each user beside the total of all."""
    log = _event_log(spark, sf)
    online = log.where("done").agg(F.avg("reward").alias("mean")).withColumn("metric", F.lit("reward"))
    return rounded(offline.reward_gap(online, offline.episode_totals(log)), 4)


# ------------------------------------------------------------------ features


def _signature_edges(spark, sf):
    return stage(_edges(spark, sf, PairSpec(method="signature", lookback=12, signature_form="levy")), "signature_edges")


def features_topk(spark, sf):
    rows = features.feature_rows(_signature_edges(spark, sf), ["end_ts"], (2, 3))
    return rounded(features.top_features(features.feature_sizes(rows, ["end_ts"], 0.001), 12), 8)


def features_selected(spark, sf):
    edges = _signature_edges(spark, sf)
    model = features.fit_features(edges, ["end_ts"], features.FeatureSpec(top_k=6))
    return rounded(model.select(edges).select("end_ts", "feature", "value"), 8)


def features_all(spark, sf):
    """Every feature of every window, absent ones as 0."""
    edges = _signature_edges(spark, sf)
    model = features.fit_features(edges, ["end_ts"], features.FeatureSpec(top_k=None))
    return rounded(model.select(edges).select("end_ts", "feature", "value"), 8)


def features_pca_invariants(spark, sf):
    """All components of twelve features: centred, uncorrelated, and of the whole variance together."""
    edges = _signature_edges(spark, sf)
    model = features.fit_features(edges, ["end_ts"], features.FeatureSpec(top_k=12, compression="pca", components=12))
    scores = model.transform(edges)
    at = lambda i: F.get("features", F.lit(i))
    means = [F.abs(F.avg(at(i))) for i in range(12)]
    cross = [F.abs(F.avg(at(i) * at(j))) for i in range(12) for j in range(i)]
    falls = [F.var_pop(at(i)) >= F.var_pop(at(i + 1)) - 1e-9 for i in range(11)]
    total = sum((F.sum(at(i) * at(i)) for i in range(12)), F.lit(0.0))
    return rounded(scores.agg(
        F.count(F.lit(1)).alias("windows"), total.alias("variance"), F.greatest(*means).alias("largest_mean"), F.greatest(*cross).alias("largest_cross"),
        F.array_min(F.array(*[f.cast("int") for f in falls])).alias("sorted"),
    ), 6)


def features_pca(spark, sf):
    edges = _signature_edges(spark, sf)
    spec = features.FeatureSpec(orders=(2,), signature_form="levy", top_k=12, compression="pca", components=6)
    model = features.fit_features(edges, ["end_ts"], spec)
    return rounded(model.transform(edges).select("end_ts", F.posexplode("features").alias("component", "score")))


# ------------------------------------------------------------------ runs


@panels.once
def _runs(spark, sf):
    weekly = scenario.fixed_metrics(_week(spark, sf), RUN_LOOKBACKS, SPEC).withColumn("scenario", F.lit("weekly"))
    six = scenario.fixed_metrics(panels.event_6h(spark, sf), RUN_LOOKBACKS, SPEC).withColumn("scenario", F.lit("six_hour"))
    named = weekly.unionByName(six).withColumn("run", F.concat_ws("_", "scenario", "run_id"))
    return stage(named, "runs")


@panels.once
def _summaries(spark, sf):
    return stage(metrics.summarize(_runs(spark, sf), ["scenario", "run"]), "summaries")


def _long(spark, sf):
    return stats.long_statistics(_summaries(spark, sf), ["scenario", "run"])


def run_summaries(spark, sf):
    return rounded(_summaries(spark, sf), 5)


def seed_stats(spark, sf):
    return rounded(stats.seed_statistics(_long(spark, sf)), 5)


def bootstrap_ci(spark, sf):
    return rounded(stats.bootstrap_interval(_long(spark, sf), ["scenario", "metric", "stat"], "value", "run"), 5)


@panels.once
def _stats_table(spark, sf):
    return stage(stats.stats_table(_long(spark, sf), "run"), "stats")


def stats_table(spark, sf):
    return rounded(_stats_table(spark, sf), 5)


def welch(spark, sf):
    tested = stats.welch_by_metric(_long(spark, sf))
    return rounded(tested.drop("p_value"), 4)


def welch_p(spark, sf):
    return rounded(stats.welch_by_metric(_long(spark, sf)), 4)


def _pair_tests(spark, sf):
    return stats.pairwise_tests(_runs(spark, sf), "run", ("mean_abs_matrix", "stability_matrix_corr"))


def cohens_d(spark, sf):
    return rounded(_pair_tests(spark, sf).select("metric", "run_a", "run_b", "n_a", "n_b", "t_stat", "df", "cohens_d"), 4)


def pair_tests(spark, sf):
    return rounded(stats.sorted_pairs(_pair_tests(spark, sf)), 4)


def significant_pairs(spark, sf):
    return rounded(stats.significant(_pair_tests(spark, sf)), 4)


def p_matrix(spark, sf):
    runs = sorted(f"{s}_fixed_{n:02d}" for s in ("weekly", "six_hour") for n in RUN_LOOKBACKS)
    return rounded(stats.p_matrix(_pair_tests(spark, sf).where("metric = 'mean_abs_matrix'"), "run", runs))


def bh_qvalues(spark, sf):
    """False discovery correction of given p-values, here a fixed function of the t statistics."""
    given = _pair_tests(spark, sf).drop("q_value").withColumn("p", F.round(F.exp(-F.abs("t_stat") / 4), 4))
    return rounded(stats.q_values(given, ["metric"], "p").select("metric", "run_a", "run_b", "p", "q_value"))


def run_pivot(spark, sf):
    return rounded(stats.run_means(_summaries(spark, sf), "run", metrics.WINDOW_METRICS), 5)


def comparison_table(spark, sf):
    return rounded(reports.comparison_table(stats.run_means(_summaries(spark, sf), "run", metrics.WINDOW_METRICS)), 5)


def logged_metrics(spark, sf):
    return rounded(quality.logged_metrics(_summaries(spark, sf), "run", stats.STATISTICS))


def kpi_table(spark, sf):
    return rounded(kpis.kpis(kpis.derive_returns(_runs(spark, sf), "run", "end_ts"), "run", "end_ts"), 4)


def drawdown(spark, sf):
    returned = kpis.derive_returns(_runs(spark, sf), "run", "end_ts")
    return rounded(kpis.drawdowns(returned, ["run"], "end_ts").drop("returns_column"), 5)


def scenario_rank(spark, sf):
    return rounded(reports.scenario_ranking(_stats_table(spark, sf), "mean_abs_matrix"), 5)


def best_scenario(spark, sf):
    return rounded(reports.best_scenario(_stats_table(spark, sf)), 5)


def key_metrics(spark, sf):
    return rounded(reports.key_metric_table(_stats_table(spark, sf)), 5)


def interval_lines(spark, sf):
    return rounded(reports.interval_lines(_stats_table(spark, sf)))


def welch_lines(spark, sf):
    return rounded(reports.welch_lines(stats.welch_by_metric(_long(spark, sf))))


def significance_subset(spark, sf):
    return rounded(reports.significance_subset(_stats_table(spark, sf)), 5)


def run_overview(spark, sf):
    return reports.run_overview(_summaries(spark, sf))


@panels.once
def _tree(spark, sf):
    """A results folder written run by run: two scenarios, metadata for one of them, and an aggregate that is no run."""
    folder = f"{staged_folder(spark)}/runs-{uuid.uuid4().hex}"
    seeded = F.concat("run", F.lit("_seed"), F.regexp_extract("run", r"(\d+)$", 1)).alias("run_id")
    for scenario_ in ("weekly", "six_hour"):
        mine = F.col("scenario") == scenario_
        series = _runs(spark, sf).where(mine).select(seeded, "end_ts", *metrics.WINDOW_METRICS)
        table = _summaries(spark, sf).where(mine).select(seeded, "metric", "mean", "median", "std", "max", "min")
        about = table.select("run_id").distinct().select(
            "run_id", F.lit(scenario_).alias("scenario"), F.lit("hash").alias("data_price_hash"), F.lit(None).cast("string").alias("git_commit")
        )
        sinks.write_run(series, table, folder, metadata=about if scenario_ == "weekly" else None)
    again = spark.read.parquet(f"{folder}/{runs.SUMMARY_TABLE}").where("run_id LIKE 'weekly%'")
    sinks.write_run(series.where("false"), again.withColumn("run_id", F.lit("weekly_aggregate")), folder)
    return spark.createDataFrame([(folder,)], "folder string")


def _folder(spark, sf):
    return _tree(spark, sf).first()["folder"]


def runs_from_tree(spark, sf):
    """What the sink wrote, read back: summaries beside the length of each run's series, aggregates left out."""
    folder = _folder(spark, sf)
    sizes = runs.read_run_table(spark, folder, runs.SERIES_TABLE).groupBy("run").agg(F.count(F.lit(1)).alias("windows"))
    return rounded(runs.read_run_table(spark, folder).drop("modified").join(sizes, "run"), 5)


def run_appendix(spark, sf):
    folder = _folder(spark, sf)
    listed = runs.read_run_table(spark, folder).select("run", "seed").distinct()
    return reports.run_appendix(reports.with_metadata(listed, runs.read_run_metadata(spark, folder).drop("seed")))


def artifact_findings(spark, sf):
    folder = _folder(spark, sf)
    files = runs.table_files(spark, folder).where(runs.is_run(F.col("run")))
    return quality.run_findings(files, runs.read_run_metadata(spark, folder))


# ------------------------------------------------------------------ quality and audits


def _orders(spark, sf):
    return panels.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("asset"), F.col("o_totalprice").alias("price")
    )


def quality_findings(spark, sf):
    return rounded(quality.quality(_orders(spark, sf), "o_orderkey"))


def quality_issues(spark, sf):
    return rounded(quality.issues(quality.quality(_orders(spark, sf), "o_orderkey")))


def manifest(spark, sf):
    described = quality.manifest(panels.brand_day(spark, sf).select("ts", "asset", "price"))
    return rounded(described.drop("source"))


def walk_forward(spark, sf):
    week = _week(spark, sf)
    full = metrics.rolling_metrics(week, SPEC)
    cut = metrics.rolling_metrics(timeline.limit_days(week, DAYS), SPEC)
    return rounded(reports.compare_at_pivot(full, cut, "end_ts", metrics.WINDOW_METRICS).drop("end_ts"))


def placebo(spark, sf):
    week = _week(spark, sf)
    return rounded(reports.probe(metrics.rolling_metrics(week, SPEC), scenario.placebo_metrics(week, SPEC, 7)))


def stream_bars(spark, sf):
    source = panels.table(spark, sf, "events")
    streamed = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    observed = streamed.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("asset"), (F.col("value") + 1).alias("price")
    )
    root = f"{staged_folder(spark)}/stream-{uuid.uuid4().hex}"
    return rounded(run_to_end(streaming_bars(observed), f"{root}/bars", f"{root}/progress"))


def _streamed(spark, table: DataFrame, root: str):
    """``table`` as a stream of its files, half of them in each batch."""
    files = task_count(spark)
    table.repartition(files).write.parquet(f"{root}/in")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{root}/in")


def stream_ema(spark, sf):
    """The smoothed metrics from a stream whose rows come out of order, over several batches."""
    named, root = _named_metrics(spark, sf), f"{staged_folder(spark)}/stream-{uuid.uuid4().hex}"
    values = [c for c in named.columns if c not in ("run", "seq", "end_ts")]
    series.keep_state_on_disk(spark)
    averages = series.streaming_average(_streamed(spark, named, root), "run", "seq", values, EMA_ALPHA)
    smooth = run_to_end(averages, f"{root}/out", f"{root}/progress", ["run", "seq"], "append")
    shown = smooth.select("seq", *values, F.col("delta_mean_abs").alias("delta_mean"), F.col("mean_abs").alias("ema_mean_abs"))
    return rounded(named.select("seq", "end_ts").join(shown, "seq").drop("seq"))


def stream_overview(spark, sf):
    """The overview of runs whose summaries arrive as files; the time a file was written is the time of its rows."""
    root = f"{staged_folder(spark)}/stream-{uuid.uuid4().hex}"
    arriving = _streamed(spark, _summaries(spark, sf), root).withColumn("modified", F.col("_metadata.file_modification_time"))
    return reports.run_overview(run_to_end(series.streaming_summaries(arriving), f"{root}/out", f"{root}/progress", ["run", "metric"]))


QUERIES = {
    "bars_weekly": bars_weekly,
    "bars_ohlc": bars_ohlc,
    "bars_resampled": bars_resampled,
    "panel_usable": panel_usable,
    "returns": returns,
    "limit_days": limit_days,
    "before_date": before_date,
    "rolling_windows": rolling_windows,
    "window_returns": window_returns,
    "universe_prev_month": universe_prev_month,
    "universe_filtered": universe_filtered,
    "universe_exact": universe_exact,
    "gated_ffill": gated_ffill,
    "universe_asof": universe_asof,
    "universe_edges": universe_edges,
    "ccf_lag_pearson": _edge_query(SPEC),
    "ccf_lag_sqpearson": _edge_query(PairSpec(lookback=12, correlation="squared_pearson")),
    "ccf_lag_spearman": _edge_query(PairSpec(lookback=12, correlation="spearman")),
    "ccf_lag_kendall": _edge_query(PairSpec(lookback=12, correlation="kendall")),
    "ccf_lag_mi": _edge_query(PairSpec(lookback=12, correlation="mutual_information")),
    "ccf_lag_dcor": _edge_query(PairSpec(lookback=12, correlation="distance")),
    "ccf_auc": _edge_query(PairSpec(method="ccf_auc", lookback=12, max_lag=3)),
    "ccf_max_lag": _edge_query(PairSpec(method="ccf_at_max_lag", lookback=12, max_lag=3)),
    "signature_levy": _edge_query(PairSpec(method="signature", lookback=12, signature_form="levy")),
    "signature_by_std": _edge_query(PairSpec(method="signature", lookback=12, scaling="by_std")),
    "spearman_columns": spearman_columns,
    "custom_measure": custom_measure,
    "explicit_windows": explicit_windows,
    "single_matrix": _single_matrix(PairSpec(lag=1)),
    "single_matrix_auc": _single_matrix(PairSpec(method="ccf_auc", max_lag=5)),
    "single_matrix_max_lag": _single_matrix(PairSpec(method="ccf_at_max_lag", max_lag=5, correlation="squared_pearson")),
    "single_matrix_signature": _single_matrix(PairSpec(method="signature", signature_form="levy", scaling="by_std")),
    "single_matrix_spearman": _single_matrix(PairSpec(lag=1, correlation="spearman")),
    "matrix_snapshot": matrix_snapshot,
    "row_scores": row_scores,
    "row_scores_mean": row_scores_mean,
    "roles": role_table,
    "leaders_followers": leaders_followers,
    "universe_pairs": universe_pairs,
    "metrics_timeseries": metrics_timeseries,
    "metrics_common": metrics_common,
    "metrics_strict": metrics_strict,
    "summary": summary,
    "regime": regime,
    "sig_features": sig_features,
    "ema_metrics": ema_metrics,
    "candidate_signals": candidate_signals,
    "adaptive_lookback": adaptive_lookback,
    "adaptive_metrics": adaptive_metrics,
    "action_path": action_path,
    "random_control": random_control,
    "state_vectors": state_vectors,
    "rewards": reward_components,
    "legacy_reward": legacy_reward,
    "decision_history": decision_history,
    "transitions": transitions,
    "episode_log": episode_log,
    "episode_totals": episode_totals,
    "behaviour_cloning": behaviour_cloning,
    "offline_gap": offline_gap,
    "features_topk": features_topk,
    "features_selected": features_selected,
    "features_pca": features_pca,
    "features_all": features_all,
    "features_pca_invariants": features_pca_invariants,
    "run_summaries": run_summaries,
    "seed_stats": seed_stats,
    "bootstrap_ci": bootstrap_ci,
    "stats_table": stats_table,
    "welch": welch,
    "welch_p": welch_p,
    "cohens_d": cohens_d,
    "pair_tests": pair_tests,
    "significant_pairs": significant_pairs,
    "p_matrix": p_matrix,
    "bh_qvalues": bh_qvalues,
    "run_pivot": run_pivot,
    "comparison_table": comparison_table,
    "logged_metrics": logged_metrics,
    "kpis": kpi_table,
    "drawdown": drawdown,
    "scenario_rank": scenario_rank,
    "best_scenario": best_scenario,
    "key_metrics": key_metrics,
    "interval_lines": interval_lines,
    "welch_lines": welch_lines,
    "significance_subset": significance_subset,
    "run_overview": run_overview,
    "runs_from_tree": runs_from_tree,
    "run_appendix": run_appendix,
    "artifact_findings": artifact_findings,
    "quality": quality_findings,
    "issues": quality_issues,
    "manifest": manifest,
    "walk_forward": walk_forward,
    "placebo": placebo,
    "stream_bars": stream_bars,
    "stream_ema": stream_ema,
    "stream_overview": stream_overview,
}
