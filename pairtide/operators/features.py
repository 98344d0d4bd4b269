"""Pair features of windows: naming, selection, vectors, standardised principal components."""

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any, Mapping, Optional, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.operators.timeline import dense_positions
from pairtide.session import stage

NAMES = 1024  # features that meet a window in one row
EXTRA = 8  # directions beyond the components asked for
ROUNDS = 20  # multiplications by the covariance, where there are more features than directions

# Defaults of the feature settings.
DEFAULT_TOP_K = 10


def _orders(value: Any) -> tuple[int, ...]:
    return (value,) if isinstance(value, int) else tuple(map(int, value))


# Names of the settings in configuration files, with the field and type of each.
SETTINGS = {
    "orders": ("orders", _orders),
    "sig_method": ("signature_form", str),
    "scaling_method": ("scaling", str),
    "top_k": ("top_k", int),
    "min_magnitude": ("min_magnitude", float),
    "compression.method": ("compression", str),
    "compression.n_components": ("components", int),
}


@dataclass(frozen=True)
class FeatureSpec:
    """Which signature features are kept and whether they are compressed."""

    orders: Sequence[int] = (2,)
    signature_form: str = "custom"
    scaling: str = "mean-centering"
    top_k: Optional[int] = DEFAULT_TOP_K
    min_magnitude: float = 0.0
    compression: Optional[str] = None
    components: Optional[int] = None

    def __post_init__(self):
        if any(order < 2 for order in self.orders):
            raise ValueError("orders start at 2: the pair feature is the level-2 area")
        if self.compression not in (None, "pca"):
            raise ValueError(f"unknown compression {self.compression!r}")

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "FeatureSpec":
        """Settings by their names in configuration files; what is absent or empty keeps its default."""
        flat = {**data, **{f"compression.{k}": v for k, v in (data.get("compression") or {}).items()}}
        given = {field: read(flat[name]) for name, (field, read) in SETTINGS.items() if flat.get(name) not in (None, [], ())}
        if "top_k" in data and data["top_k"] is None:
            given["top_k"] = None  # an explicit null asks for all features
        return cls(**given)


def feature_rows(edges: DataFrame, keys: Sequence[str], orders: Sequence[int] = (2,)) -> DataFrame:
    """``(keys, feature, value)``: one named feature per pair and order; all orders read the level-2 area."""
    named = F.concat(F.lit("sig_o"), F.col("order").cast("string"), F.lit("_"), "asset_i", F.lit("_"), "asset_j")
    return edges.withColumn("order", F.explode(F.array(*[F.lit(int(o)) for o in orders]))).select(
        *keys, named.alias("feature"), "value"
    )


def feature_sizes(rows: DataFrame, keys: Sequence[str], min_magnitude: float = 0.0) -> DataFrame:
    """Mean and largest magnitude of each feature over all windows, absent values counting as 0."""
    windows = rows.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    sizes = rows.groupBy("feature").agg(
        (F.sum(F.abs("value")) / windows).alias("mean_abs"), F.max(F.abs("value")).alias("max_abs")
    )
    return sizes.where(F.col("max_abs") >= min_magnitude) if min_magnitude > 0 else sizes


def top_features(sizes: DataFrame, top_k: Optional[int]) -> DataFrame:
    """The ``top_k`` features of largest mean magnitude, ties by name; all of them without a positive ``top_k``."""
    if top_k is None or top_k <= 0:
        return sizes
    return sizes.orderBy(F.col("mean_abs").desc(), "feature").limit(top_k)


@dataclass
class FeatureModel:
    """Fitted selection and, if asked for, scaling and components, as tables.

    ``chosen(feature, place)``: the fitted features in order. ``scales(feature, mean, inverse)`` and
    ``loadings(feature, load)`` only with components; ``variances`` are those of the components.
    """

    spec: FeatureSpec
    keys: Sequence[str]
    chosen: DataFrame
    scales: Optional[DataFrame] = None
    loadings: Optional[DataFrame] = None
    shift: Sequence[float] = ()
    variances: Sequence[float] = ()

    @property
    def names(self) -> list[str]:
        """The fitted features on the driver, for looking at; nothing here needs them there."""
        return [r.feature for r in self.chosen.orderBy("place").collect()]

    def rows(self, edges: DataFrame) -> DataFrame:
        """Long rows of fitted features that the windows have."""
        return feature_rows(edges, self.keys, self.spec.orders).join(self.chosen, "feature", "left_semi")

    def select(self, edges: DataFrame) -> DataFrame:
        """Long selected features; every window gets every fitted feature, absent ones as 0.

        Windows meet the features by blocks of ``NAMES`` names, so no row or literal holds them all.
        """
        keys = list(self.keys)
        windows = edges.select(*keys).distinct()
        block = F.floor(F.col("place") / F.lit(NAMES))
        listed = self.chosen.groupBy(block.alias("_block")).agg(F.collect_list(F.struct("feature", "place")).alias("_names"))
        last = self.chosen.agg(F.max(block)).scalar()
        spread = windows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        every = spread.join(listed, "_block").select(*keys, F.inline("_names"))
        met = every.join(feature_rows(edges, keys, self.spec.orders), [*keys, "feature"], "left")
        return met.select(*keys, "feature", "place", F.coalesce("value", F.lit(0.0)).alias("value"))

    def transform(self, edges: DataFrame) -> DataFrame:
        """``(keys, features)``: the selected values in fitted order, or their components."""
        keys = list(self.keys)
        if self.loadings is None:
            vectors = self.select(edges).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_all"))
            return vectors.select(*keys, F.col("_all.value").alias("features"))
        scaled = self.rows(edges).join(self.scales, "feature").withColumn("value", F.col("value") * F.col("inverse"))
        return _times(scaled, edges.select(*keys).distinct(), keys, self.loadings, self.shift).withColumnRenamed("load", "features")


def fit_features(edges: DataFrame, keys: Sequence[str], spec: FeatureSpec) -> FeatureModel:
    """Choose features on the given windows and fit the compression."""
    keys = list(keys)
    rows = feature_rows(edges, keys, spec.orders)
    sizes = top_features(feature_sizes(rows, keys, spec.min_magnitude), spec.top_k)
    falling = F.when(F.col("mean_abs") > 0, F.floor(-64 * F.log2("mean_abs"))).otherwise(F.lit(1 << 20))
    placed = dense_positions(sizes.select("feature", "mean_abs"), [F.col("mean_abs").desc(), F.col("feature")], falling, "place")
    chosen = stage(placed.select("feature", "place"), "chosen_features")
    model = FeatureModel(spec, keys, chosen)
    count = chosen.count()
    if spec.compression is None or not count:
        return model
    return _fit_components(model, edges, spec.components or max(1, count // 2), count)


# ---------------------------------------------------------------- components of the long form
#
# With X the standardised windows x features, an orthonormal block Q of a few more directions than asked for is multiplied by
# X'X again and again, which turns it towards the leading components. X stays long and sparse: absent values are zeros
# before centring, so the means enter as one number per direction. Only small Gram matrices reach the driver.


def _times(rows: DataFrame, whole: DataFrame, on: Sequence[str], factor: DataFrame, shift: Sequence[float]) -> DataFrame:
    """``(on, load)``: sums of ``value * load`` per row of ``whole``, less ``shift``; rows that meet nothing have 0 less ``shift``."""
    width = len(shift)
    sums = [F.sum(F.col("value") * F.get("load", F.lit(i))).alias(f"s{i}") for i in range(width)]
    met = rows.join(factor, [c for c in factor.columns if c != "load"]).groupBy(*on).agg(*sums)
    loads = F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) - float(x) for i, x in enumerate(shift)])
    return whole.join(met, list(on), "left").select(*on, loads.alias("load"))


def _column_sums(frame: DataFrame, weight, width: int) -> np.ndarray:
    found = frame.agg(*[F.sum(weight * F.get("load", F.lit(i))).alias(f"s{i}") for i in range(width)]).first()
    return np.array([x or 0.0 for x in found])


def _gram(frame: DataFrame, width: int) -> np.ndarray:
    """``L'L`` of all rows' loads: one small matrix per task, added by place."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    parts = frame.select("load").mapInArrow(part, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    out = np.zeros(width * width)
    for at, x in parts.groupBy("at").agg(F.sum("x")).collect():
        out[at] = x
    return out.reshape(width, width)


def _turned(frame: DataFrame, turn: np.ndarray) -> DataFrame:
    """``frame`` with every ``load`` multiplied by ``turn``."""
    kept = [c for c in frame.columns if c != "load"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(kept)).flatten().to_numpy().reshape(batch.num_rows, -1) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * turn.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], [*kept, "load"])

    return frame.select(*kept, "load").mapInArrow(apply, schema)


def _fit_components(model: FeatureModel, edges: DataFrame, width: int, count: int) -> FeatureModel:
    keys = list(model.keys)
    values = stage(model.rows(edges), "component_rows")
    windows = stage(edges.select(*keys).distinct(), "component_windows")
    n = windows.count()
    moments = values.groupBy("feature").agg(
        (F.sum("value") / n).alias("mean"), (F.sum(F.col("value") * F.col("value")) / n).alias("square"),
        ((F.count("value") == n) & (F.min("value") == F.max("value"))).alias("flat"),
    )
    spread = F.col("square") - F.col("mean") * F.col("mean")
    scales = stage(moments.select("feature", "mean", F.when(~F.col("flat") & (spread > 0), 1 / F.sqrt(spread)).otherwise(F.lit(0.0)).alias("inverse")), "component_scales")
    rows = stage(values.join(scales, "feature").select(*keys, "feature", (F.col("value") * F.col("inverse")).alias("value")), "scaled_rows")
    centre = F.col("mean") * F.col("inverse")
    block = min(count, width + EXTRA)
    drawn = F.array(*[F.pmod(F.xxhash64("feature", F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1.0 for i in range(block)])
    q = scales.select("feature", drawn.alias("load"))
    features, none = scales.select("feature"), np.zeros(block)
    for turn in range(1 if block == count else ROUNDS):
        values_, vectors = np.linalg.eigh(_gram(q, block))
        keep = values_ > values_.max(initial=0.0) * 1e-14
        block = int(keep.sum())
        q = stage(_turned(q, vectors[:, keep] / np.sqrt(values_[keep])), "component_block")
        shift = _column_sums(q.join(scales, "feature"), centre, block)
        y = stage(_times(rows, windows, keys, q, shift), "component_scores")
        if turn < ROUNDS - 1 and block < count:
            none = np.zeros(block)
            total = _column_sums(y, F.lit(1.0), block)
            pulled = _times(rows, features, ["feature"], y, none).join(scales, "feature")
            q = stage(pulled.select("feature", F.array(*[F.get("load", F.lit(i)) - centre * float(t) for i, t in enumerate(total)]).alias("load")), "component_pull")
    values_, vectors = np.linalg.eigh(_gram(y, block))
    order = np.argsort(-values_, kind="stable")[:width]
    leading = stage(_turned(q, vectors[:, order]), "component_loadings")
    # the largest loading of a component is positive
    signs = leading.agg(*[F.max_by(F.get("load", F.lit(i)), F.struct(F.abs(F.get("load", F.lit(i))), "feature")).alias(f"s{i}") for i in range(len(order))]).first()
    leading = stage(_turned(leading, np.diag([1.0 if (x or 0.0) >= 0 else -1.0 for x in signs])), "component_loadings")
    shift = _column_sums(leading.join(scales, "feature"), centre, len(order))
    return replace(model, scales=scales, loadings=leading, shift=shift.tolist(), variances=(np.maximum(values_[order], 0.0) / max(n, 1)).tolist())
