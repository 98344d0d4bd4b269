"""Learning from logged decisions: logs from event tables, stratified split, action classifier, totals, gaps."""

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.operators.timeline import dense_positions
from pairtide.session import stage

# Iterations and inverse regularisation of the action classifier, share of test rows.
MAX_ITERATIONS = 200
INVERSE_PENALTY = 1.0
TEST_SHARE = 0.25


def logged_events(events: DataFrame, user: str, ts: str, event: str, kind: str, value: str) -> DataFrame:
    """A decision log of all events: ``(episode, step, ts, observation, action, reward, done)``.

    A user's events in order of time (then event id) are an episode; its kind is the action, numbered by name, its
    value the reward. The observation is what stood before the action: value and kind of the user's event before, the
    hours since it and the step (0, -1, 0 and 0 at the first). Positions are counted per user and day, and an event meets the one before it
    by an equi-join, so a user with very many events is spread over tasks.
    """
    kinds = dense_positions(events.select(F.col(kind).alias("kind")).distinct(), ["kind"], F.lit(0), "action")
    named = events.select(
        F.col(user).alias("episode"), F.col(ts).alias("ts"), F.col(event).alias("event"), F.col(kind).alias("kind"), F.col(value).cast("double").alias("reward")
    ).where(F.col("episode").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isNotNull())
    placed = dense_positions(named.join(kinds, "kind"), ["ts", "event"], F.date_trunc("day", "ts"), "step", ["episode"])
    placed = stage(placed.drop("kind", "event"), "logged_events")
    before = placed.select("episode", (F.col("step") + 1).alias("step"), F.col("reward").alias("was"), F.col("action").alias("did"), F.col("ts").alias("at"))
    sizes = placed.groupBy("episode").agg(F.max("step").alias("last"))
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9
    seen = [F.coalesce("was", F.lit(0.0)), F.coalesce("did", F.lit(-1)).cast("double"), F.coalesce(hours, F.lit(0.0)), F.col("step").cast("double")]
    both = placed.join(before, ["episode", "step"], "left").join(sizes, "episode")
    return both.select("episode", "step", "ts", F.array(*seen).alias("observation"), "action", "reward", (F.col("step") == F.col("last")).alias("done"))


def stratified_split(logged: DataFrame, test_share: float = TEST_SHARE, seed: int = 42) -> DataFrame:
    """Mark ``is_test`` rows: the share of each action with the smallest hash of (episode, step).

    The cut of each action is a mergeable quantile sketch, so a dominant action needs no
    window over all of its rows.
    """
    hashed = logged.withColumn("_h", F.xxhash64("episode", "step", F.lit(seed)))
    cuts = hashed.groupBy("action").agg(F.percentile_approx("_h", F.lit(test_share), F.lit(100000)).alias("_cut"))
    return hashed.join(cuts, "action").withColumn("is_test", F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def fit_actions(train: DataFrame) -> LogisticRegressionModel:
    """Multinomial logistic regression of the action on the state vector."""
    data = _vectors(train)
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        maxIter=MAX_ITERATIONS,
        family="multinomial",
        regParam=1.0 / (INVERSE_PENALTY * max(1, data.count())),
        standardization=False,
    ).fit(data)


def predict_actions(model: LogisticRegressionModel, logged: DataFrame) -> DataFrame:
    return model.transform(_vectors(logged)).withColumn("predicted", F.col("prediction").cast("int")).drop(
        "features", "label", "rawPrediction", "probability", "prediction"
    )


def _vectors(logged: DataFrame) -> DataFrame:
    return logged.withColumn("features", array_to_vector(F.col("observation").cast("array<double>"))).withColumn(
        "label", F.col("action").cast("double")
    )


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row: share of rows whose predicted action is the logged one."""
    return predicted.agg(
        F.avg((F.col("predicted") == F.col("action")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows")
    )


def clone_behaviour(logged: DataFrame, test_share: float = TEST_SHARE, seed: int = 42) -> DataFrame:
    """Fit on the training rows and report accuracy on the test rows."""
    split = stratified_split(logged, test_share, seed)
    model = fit_actions(split.where(~F.col("is_test")))
    return accuracy(predict_actions(model, split.where("is_test"))).withColumn("test_size", F.lit(test_share))


def episode_totals(logged: DataFrame) -> DataFrame:
    """Total reward and number of steps per episode."""
    return logged.groupBy("episode").agg(F.sum("reward").alias("total_reward"), F.count(F.lit(1)).alias("steps"))


def reward_gap(online_summary: DataFrame, totals: DataFrame) -> DataFrame:
    """Mean online reward beside the logged total: one row, or none without a reward metric."""
    online = online_summary.where("metric = 'reward'").limit(1).select("metric", F.col("mean").alias("online_mean"))
    total = totals.agg(F.sum("total_reward")).scalar()
    return online.select(
        "metric", "online_mean", total.alias("offline_total_reward"), (F.col("online_mean") - total).alias("performance_gap")
    )
