"""One pair matrix over a whole history, rows missing on either side dropped per pair.

A lag counts the rows that a pair shares, so it may reach over any gap. The history is cut into stretches; a task
gets one stretch of two asset blocks and leaves one small state per pair: how many rows are shared, the first and
last few of them, and sums over the rows and over the lagged products. States of neighbouring stretches merge: sums
add, and the products across the seam come from the last rows of one and the first of the other. Merging is
associative, so stretches are merged in levels of ``MERGE`` along the calendar.

What moves is, per stretch, each series once for each block (no pair of assets per date) and one state per pair.
Rank measures have no such state: for them a task holds the whole series of two small blocks, and nothing else.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.config import PairSpec
from pairtide.functions import ranks
from pairtide.functions.kernels import lead_of_lags, pair_values
from pairtide.session import stage, task_count

STRETCH = 4096  # calendar rows of a task
BLOCK = 32  # assets per side of a tile
SERIES_BLOCK = 8  # the same where a tile holds whole histories
MERGE = 16  # states merged at a time
STATE_SCHEMA = "part long, bi int, bj int, state binary"
VALUE_SCHEMA = "asset_i string, asset_j string, value double"
LONG = 512  # rows from which rank measures sort instead of comparing all row pairs


def whole_matrix(values: DataFrame, spec: PairSpec, stretch: int = STRETCH, block: int | None = None) -> DataFrame:
    """``(asset_i, asset_j, value)`` for every pair of assets, ``asset_i < asset_j``; ``values`` needs ``(pos, asset, price)``.

    Values are taken as given. A pair with too few shared rows for its lags, or without a defined correlation, has value 0.
    """
    states = spec.method == "signature" or spec.correlation in ("pearson", "squared_pearson")
    roster, placed = _placed(values, block or (BLOCK if states else SERIES_BLOCK))
    met = _merged(placed, spec, stretch) if states else _series(placed)
    blocks = roster.count()
    pairs = roster.select(F.col("block").alias("bi"), F.col("names").alias("left"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("bj"))
    tiles = pairs.join(roster.select(F.col("block").alias("bj"), F.col("names").alias("right")), "bj").join(met, ["bi", "bj"], "left")
    spread = tiles.repartition(task_count(values.sparkSession), "bi", "bj")
    return spread.select("bi", "bj", "left", "right", "state").mapInArrow(_values_from(_state_values if states else _series_values, spec), VALUE_SCHEMA)


def _placed(values: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``(block, names)``, assets hashed into blocks; and the observations as ``(block, slot, pos, value)`` around their asset's mean."""
    spark = values.sparkSession
    assets = stage(values.groupBy("asset").agg(F.avg("price").alias("mean"), F.avg(F.col("price") * F.col("price")).alias("square_mean")), "whole_assets")
    blocks = max(1, -(-assets.count() // block))
    own = F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int")
    hashed = assets.select(own.alias("_own"), "*")
    filled = hashed.groupBy("_own").agg(F.array_sort(F.collect_list("asset")).alias("names")).select(F.col("_own").alias("block"), "names")
    every = spark.range(blocks).select(F.col("id").cast("int").alias("block"))
    roster = stage(every.join(filled, "block", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))), "whole_roster")
    slots = roster.select("block", F.posexplode("names").alias("slot", "asset")).join(assets, "asset")
    return roster, values.select("pos", "asset", "price").join(slots, "asset").select("block", "slot", "pos", "price", "mean", "square_mean")


def _both(rows: DataFrame, key: list[str]) -> DataFrame:
    """Send each row of a block to the tiles of its block with every block."""
    blocks = rows.agg(F.coalesce(F.max("block"), F.lit(0)) + 1).scalar()
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other")
    return spread.repartition(task_count(rows.sparkSession), *key, "bi", "bj")


def _dense(table: pa.Table, low: int, width: int, size: int) -> np.ndarray:
    """The block's series on the stretch's rows, NaN where there is no observation."""
    grid = np.full((size, width), np.nan)
    for row in range(table.num_rows):
        cells = table["cells"][row].values
        grid[cells.field("slot").to_numpy(), cells.field("pos").to_numpy() - low] = cells.field("value").to_numpy()
    return grid


def _shared(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Series that miss the same rows go together: ``(rows of x, rows of y, x there, y there)``, shared rows only."""
    seen = []
    for grid in (x, y):
        known = ~np.isnan(grid)
        kinds, of = np.unique(np.packbits(known, axis=1), axis=0, return_inverse=True)
        seen.append([np.flatnonzero(of.ravel() == k) for k in range(len(kinds))])
    for a in seen[0]:
        for b in seen[1]:
            both = ~np.isnan(x[a[0]]) & ~np.isnan(y[b[0]])
            if both.any():
                yield a, b, x[np.ix_(a, both)], y[np.ix_(b, both)]


# ---------------------------------------------------------------- states of product moments


class _Layout:
    """Where the parts of a pair's state stand: count, first and last rows, sums, lengths of constant runs, lagged products."""

    def __init__(self, spec: PairSpec):
        if spec.method == "signature":
            self.lags = [1]
        elif spec.method == "ccf_at_lag":
            self.lags = [abs(spec.lag)] if spec.lag else []
        else:
            self.lags = list(range(1, spec.max_lag + 1))
        self.keep = max(self.lags, default=1)
        k, at = self.keep, 1
        names = {}
        for name, size in (("hx", k), ("hy", k), ("tx", k), ("ty", k), ("sums", 4), ("runs", 4), ("ahead", len(self.lags)), ("behind", len(self.lags))):
            names[name] = slice(at, at + size)
            at += size
        self.names, self.width = names, at

    def __call__(self, state: np.ndarray, name: str) -> np.ndarray:
        return state[..., 0] if name == "count" else state[..., self.names[name]]


def _state(layout: _Layout, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """States of all pairs of the rows of ``x`` with those of ``y`` over one stretch."""
    out = np.zeros((len(x), len(y), layout.width))
    for a, b, u, v in _shared(x, y):
        n, at = u.shape[1], np.ix_(a, b)
        part = np.zeros((len(a), len(b), layout.width))
        part[..., 0] = n
        k = min(layout.keep, n)
        for side, head, tail, line in ((u[:, None], "hx", "tx", 0), (v[None], "hy", "ty", 1)):
            layout(part, head)[..., :k] = side[..., :k]
            layout(part, tail)[..., layout.keep - k :] = side[..., n - k :]
            layout(part, "sums")[..., 2 * line] = side.sum(axis=-1)
            layout(part, "sums")[..., 2 * line + 1] = (side * side).sum(axis=-1)
            for end, ordered in enumerate((side, side[..., ::-1])):
                moved = ordered != ordered[..., :1]
                layout(part, "runs")[..., 2 * line + end] = np.where(moved.any(axis=-1), moved.argmax(axis=-1), n)
        for i, lag in enumerate(layout.lags):
            if lag < n:
                layout(part, "ahead")[..., i] = u[:, : n - lag] @ v[:, lag:].T
                layout(part, "behind")[..., i] = u[:, lag:] @ v[:, : n - lag].T
        out[at] = part
    return out


def merge(layout: _Layout, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of two neighbouring stretches, ``a`` the earlier."""
    out = np.zeros_like(a)
    na, nb, keep = a[..., 0], b[..., 0], layout.keep
    out[..., 0] = na + nb
    layout(out, "sums")[:] = layout(a, "sums") + layout(b, "sums")
    place = np.arange(keep)
    for head, tail in (("hx", "tx"), ("hy", "ty")):
        behind = np.maximum(place - na[..., None], 0).astype(np.int64)
        layout(out, head)[:] = np.where(place < na[..., None], layout(a, head), np.take_along_axis(layout(b, head), behind, axis=-1))
        ahead = np.minimum(place + nb[..., None], keep - 1).astype(np.int64)
        layout(out, tail)[:] = np.where(place >= keep - nb[..., None], layout(b, tail), np.take_along_axis(layout(a, tail), ahead, axis=-1))
    runs_a, runs_b, runs = layout(a, "runs"), layout(b, "runs"), layout(out, "runs")
    for line, (head, tail) in enumerate((("hx", "tx"), ("hy", "ty"))):
        joined = layout(a, tail)[..., -1] == layout(b, head)[..., 0]
        p, q = 2 * line, 2 * line + 1
        runs[..., p] = np.where(runs_a[..., p] < na, runs_a[..., p], na + np.where(joined, runs_b[..., p], 0))
        runs[..., q] = np.where(runs_b[..., q] < nb, runs_b[..., q], nb + np.where(joined, runs_a[..., q], 0))
        for side in (p, q):
            runs[..., side] = np.where(na == 0, runs_b[..., side], np.where(nb == 0, runs_a[..., side], runs[..., side]))
    for i, lag in enumerate(layout.lags):
        ahead, behind = layout(a, "ahead")[..., i] + layout(b, "ahead")[..., i], layout(a, "behind")[..., i] + layout(b, "behind")[..., i]
        for back in range(1, lag + 1):
            met = (back <= na) & (lag - back < nb)
            ahead = ahead + np.where(met, layout(a, "tx")[..., keep - back] * layout(b, "hy")[..., lag - back], 0.0)
            behind = behind + np.where(met, layout(b, "hx")[..., lag - back] * layout(a, "ty")[..., keep - back], 0.0)
        layout(out, "ahead")[..., i], layout(out, "behind")[..., i] = ahead, behind
    return out


def _merged(placed: DataFrame, spec: PairSpec, stretch: int) -> DataFrame:
    """``(bi, bj, state)`` over the whole history."""
    layout = _Layout(spec)
    power = spec.correlation == "squared_pearson" and spec.method != "signature"
    value = F.col("price") * F.col("price") - F.col("square_mean") if power else F.col("price") - F.col("mean")
    cells = placed.select("block", "slot", "pos", value.alias("value"), F.floor(F.col("pos") / F.lit(stretch)).alias("part"))
    gathered = cells.groupBy("part", "block").agg(F.collect_list(F.struct("slot", "pos", "value")).alias("cells"), (F.max("slot") + 1).alias("size"))
    sizes = placed.groupBy("block").agg((F.max("slot") + 1).alias("slots"))
    gathered = stage(gathered.drop("size").join(sizes, "block"), "whole_cells")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        part, bi, bj = (table[c][0].as_py() for c in ("part", "bi", "bj"))
        grids = {}
        for row in range(table.num_rows):
            one = table.slice(row, 1)
            grids[one["block"][0].as_py()] = _dense(one, part * stretch, stretch, one["slots"][0].as_py())
        if bi in grids and bj in grids:
            yield _state_row(part, bi, bj, _state(layout, grids[bi], grids[bj]))

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("part")
        parts = [np.frombuffer(s.as_buffer()).reshape(-1, 1, layout.width) for s in table["state"].combine_chunks()]
        yield _state_row(table["part"][0].as_py() // MERGE, table["bi"][0].as_py(), table["bj"][0].as_py(), reduce(lambda a, b: merge(layout, a, b), parts))

    states = stage(_both(gathered, ["part"]).groupBy("part", "bi", "bj").applyInArrow(first, STATE_SCHEMA), "whole_states")
    left = (states.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        group = states.groupBy(F.floor(F.col("part") / F.lit(MERGE)).alias("_group"), "bi", "bj")
        states, left = stage(group.applyInArrow(later, STATE_SCHEMA), "whole_states"), -(-left // MERGE)
    return states.select("bi", "bj", "state")


def _state_row(part: int, bi: int, bj: int, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([np.ascontiguousarray(state).tobytes()], pa.binary())],
        ["part", "bi", "bj", "state"],
    )


def _state_values(spec: PairSpec, data: pa.Buffer, n: int, m: int) -> np.ndarray:
    layout = _Layout(spec)
    state = np.frombuffer(data).reshape(n, m, layout.width)
    count, sums, runs = state[..., 0], layout(state, "sums"), layout(state, "runs")
    hx, hy, tx, ty = (layout(state, name) for name in ("hx", "hy", "tx", "ty"))
    with np.errstate(invalid="ignore", divide="ignore"):
        if spec.method == "signature":
            area = layout(state, "ahead")[..., 0] - layout(state, "behind")[..., 0]
            area = area - hx[..., 0] * (ty[..., -1] - hy[..., 0]) + hy[..., 0] * (tx[..., -1] - hx[..., 0])
            if spec.scaling != "mean-centering":
                for line in (0, 1):
                    spread = np.sqrt((sums[..., 2 * line + 1] - sums[..., 2 * line] ** 2 / count) / (count - 1))
                    area = area / np.where(runs[..., 2 * line] >= count, 1.0, spread)
            return np.nan_to_num(np.where(count > 1, area / 2.0 if spec.signature_form == "levy" else area, 0.0))

        def correlation(product, n, early, late):
            """``early`` and ``late``: sum, sum of squares and constant run of a side without the rows the lag cuts off."""
            sxy = product - early[0] * late[0] / n
            scale = np.sqrt((early[1] - early[0] ** 2 / n) * (late[1] - late[0] ** 2 / n))
            flat = (early[2] >= n) | (late[2] >= n)
            return np.where(n <= 0, np.nan, np.where(flat, 0.0, sxy / scale))

        sides = []
        for i, lag in enumerate(layout.lags):
            n = count - lag
            cut = lambda line, edge, part: (sums[..., 2 * line] - edge.sum(axis=-1), sums[..., 2 * line + 1] - (edge * edge).sum(axis=-1), runs[..., 2 * line + part])
            early = [cut(line, tail[..., layout.keep - lag :], 0) for line, tail in enumerate((tx, ty))]
            late = [cut(line, head[..., :lag], 1) for line, head in enumerate((hx, hy))]
            ahead = correlation(layout(state, "ahead")[..., i], n, early[0], late[1])
            sides.append((ahead, correlation(layout(state, "behind")[..., i], n, early[1], late[0])))
        if spec.method == "ccf_at_lag":
            value = (sides[0][0] - sides[0][1]) * np.sign(spec.lag) if sides else np.zeros(count.shape)
        else:
            # sums leave rounding of 1e-12 and more on few rows; equal sides have to stay equal
            value = lead_of_lags(spec, [(ahead.round(10), behind.round(10)) for ahead, behind in sides])
    return np.nan_to_num(value, nan=0.0)


# ---------------------------------------------------------------- whole series of two blocks


def _series(placed: DataFrame) -> DataFrame:
    """``(bi, bj, state)`` with the whole series of two blocks as the state."""
    cells = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "slot", F.col("price").alias("value")))).alias("cells"))
    both = _both(stage(cells, "whole_series"), [])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        of = {table["block"][row].as_py(): table["cells"][row].values for row in range(table.num_rows)}
        if bi not in of or bj not in of:
            return
        flat = [np.array([len(of[b]) for b in (bi, bj)], dtype=np.float64)]
        flat += [of[b].field(c).to_numpy().astype(np.float64) for b in (bi, bj) for c in ("slot", "pos", "value")]
        yield _state_row(0, bi, bj, np.concatenate(flat))

    return both.groupBy("bi", "bj").applyInArrow(pack, STATE_SCHEMA).select("bi", "bj", "state")


def _series_values(spec: PairSpec, data: pa.Buffer, n: int, m: int) -> np.ndarray:
    flat = np.frombuffer(data)
    sizes, at, grids = flat[:2].astype(np.int64), 2, []
    parts = []
    for size in sizes:
        parts.append([flat[at + k * size : at + (k + 1) * size] for k in range(3)])
        at += 3 * size
    length = int(max(p[1].max() for p in parts)) + 1
    for (slot, pos, value), rows in zip(parts, (n, m)):
        grids.append(np.full((rows, length), np.nan))
        grids[-1][slot.astype(np.int64), pos.astype(np.int64)] = value
    out = np.zeros((n, m))
    for a, b, u, v in _shared(*grids):
        out[np.ix_(a, b)] = _long_values(spec, u, v) if spec.correlation in ("kendall", "distance") and u.shape[1] > LONG else pair_values(spec, u[None], v[None])[0]
    return out


def _long_values(spec: PairSpec, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Kendall and distance measures pair by pair, by sorting."""
    measure = getattr(ranks, spec.correlation)
    lags = [abs(spec.lag)] if spec.method == "ccf_at_lag" else range(1, spec.max_lag + 1)
    rows, sides = x.shape[1], []
    for lag in lags:
        side = np.full((2, len(x), len(y)), np.nan)
        if lag < rows:
            for i, u in enumerate(x):
                for j, v in enumerate(y):
                    side[:, i, j] = measure(u[: rows - lag], v[lag:]), measure(v[: rows - lag], u[lag:])
        sides.append(side)
    if spec.method == "ccf_at_lag":
        return np.nan_to_num((sides[0][0] - sides[0][1]) * np.sign(spec.lag), nan=0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(lead_of_lags(spec, sides), nan=0.0)


def _values_from(values, spec: PairSpec):
    """Tiles with their states to one row per pair of names."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bi, bj, left, right = (batch.column(k)[row].as_py() for k in range(4))
                if not left or not right:
                    continue
                state = batch.column(4)[row]
                v = values(spec, state.as_buffer(), len(left), len(right)) if state.is_valid else np.zeros((len(left), len(right)))
                i, j = np.triu_indices(len(left), k=1) if bi == bj else (part.ravel() for part in np.indices(v.shape))
                a, b = np.array(left, dtype=object)[i], np.array(right, dtype=object)[j]
                swap = np.array([p > q for p, q in zip(a, b)], dtype=bool)
                # a value changes its sign with the order of the pair; no negative zeros
                signed = np.where(swap, -v[i, j], v[i, j]) + 0.0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(swap, b, a), pa.string()), pa.array(np.where(swap, a, b), pa.string()), pa.array(signed)], ["asset_i", "asset_j", "value"]
                )

    return out
