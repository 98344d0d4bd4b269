"""The pair matrix of every window, computed as tiles.

A window's matrix holds one value per unordered asset pair, so its size is fixed by
the question asked. The plan keeps everything else small:

1. Windows are grouped by the stretch of the calendar they end in. Observations go to
   the stretches whose windows cover them (an equi-join on position blocks), about two
   copies each, instead of one copy per window.
2. Within (asset, stretch) the return of each observation is taken once with ``lag``;
   windows later mask returns whose previous observation lies before their start.
3. Assets are hashed into blocks. A task gets one stretch and two blocks, fills two
   bounded arrays and multiplies them. No task ever sees all assets or all rows.
"""

from typing import Iterator, Optional

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairtide.config import PairSpec
from pairtide.functions.kernels import doubles_per_series, pair_values
from pairtide.operators.timeline import log_return
from pairtide.session import task_count

STRETCH = 64  # calendar rows whose windows share one task
BLOCK = 64  # assets per side of a tile
BATCH_DOUBLES = 4_000_000  # working numbers a kernel call may hold

EDGE_SCHEMA = "start_pos int, end_pos int, asset_i string, asset_j string, value double"
PARTIAL_SCHEMA = (
    "start_pos int, end_pos int, prev_start_pos int, prev_end_pos int, asset string, pairs bigint, row_sum double, abs_sum double, "
    "max_abs double, prev_pairs bigint, shared_pairs bigint, shared_sum double, shared_prev_sum double, cross double, sq double, prev_sq double"
)
RETURNS_SCHEMA = "start_pos int, end_pos int, asset string, rets array<double>"


# ---------------------------------------------------------------- Spark plan


def _stretches(windows: DataFrame, stretch: int) -> DataFrame:
    """One row per stretch: its windows and the positions they need."""
    has_prev = "prev_end_pos" in windows.columns
    prev_end = F.col("prev_end_pos") if has_prev else F.lit(None).cast("int")
    prev_start = F.col("prev_start_pos") if has_prev else F.lit(None).cast("int")
    listed = windows.select(
        F.floor(F.col("end_pos") / F.lit(stretch)).cast("int").alias("stretch"),
        F.struct("end_pos", "start_pos", prev_end.alias("prev_end"), prev_start.alias("prev_start")).alias("w"),
    )
    return listed.groupBy("stretch").agg(
        F.min(F.least("w.start_pos", F.coalesce("w.prev_start", "w.start_pos"))).alias("lo"),
        F.max("w.end_pos").alias("hi"),
        F.array_sort(F.collect_set("w")).alias("windows"),
    )


def series_blocks(
    indexed: DataFrame, windows: DataFrame, members: Optional[DataFrame] = None, stretch: int = STRETCH
) -> DataFrame:
    """One row per (asset, stretch): its observations with returns, and the stretch's windows.

    Without ``members`` every asset of the panel takes part in every window, observed there
    or not. ``members(end_pos, asset)`` restricts each window to its own universe.
    """
    plan = _stretches(windows, stretch)
    cover = plan.select("stretch", "lo", "hi", F.explode(F.sequence(_slot("lo", stretch), _slot("hi", stretch))).alias("slot"))
    placed = (
        indexed.select("pos", "asset", "price", _slot("pos", stretch).alias("slot"))
        .join(cover, "slot")
        .where(F.col("pos").between(F.col("lo"), F.col("hi")))
    )
    placed = placed.select("asset", "stretch", "pos", "price", F.lit(None).cast("int").alias("member_end"))
    if members is None:
        last = indexed.agg(F.max(_slot("pos", stretch))).scalar()
        present = indexed.select("asset").distinct().select("asset", F.explode(F.sequence(F.lit(0), last)).alias("stretch"))
    else:
        present = members.join(_membership_needed(windows, stretch), "end_pos").select("asset", "stretch", F.col("end_pos").alias("member_end"))
    # Presence rows have no position: they sort first and look like "no earlier observation" to lag.
    timeline = Window.partitionBy("asset", "stretch").orderBy(F.col("pos").asc_nulls_first())
    stacked = placed.unionByName(present, allowMissingColumns=True).withColumns(
        {"prev_pos": F.lag("pos").over(timeline), "prev_price": F.lag("price").over(timeline)}
    )
    returned = F.struct("pos", log_return(F.col("price"), F.col("prev_price")).alias("ret"), "prev_pos")
    gathered = stacked.groupBy("asset", "stretch").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), returned))).alias("obs"),
        F.array_sort(F.collect_set("member_end")).alias("member_ends"),
    )
    if members is not None:
        gathered = gathered.where(F.size("member_ends") > 0)
    return gathered.join(plan, "stretch").select(
        "stretch",
        "asset",
        "lo",
        "hi",
        "windows",
        F.col("obs.pos").alias("pos"),
        F.col("obs.ret").alias("ret"),
        F.col("obs.prev_pos").alias("prev_pos"),
        "member_ends",
    )


def _membership_needed(windows: DataFrame, stretch: int) -> DataFrame:
    """``(end_pos, stretch)``: whose members a stretch asks for, those of its windows and of the windows before them."""
    own = windows.select("end_pos", _slot("end_pos", stretch).alias("stretch"))
    if "prev_end_pos" in windows.columns:
        before = windows.where("prev_end_pos IS NOT NULL").select(F.col("prev_end_pos").alias("end_pos"), _slot("end_pos", stretch).alias("stretch"))
        own = own.union(before)
    return own.distinct()


def _slot(column: str, stretch: int):
    return F.floor(F.col(column) / F.lit(stretch)).cast("int")


def _tiles(series: DataFrame, assets: DataFrame, key: list, block: int) -> DataFrame:
    """Send each series to the tiles of its block against every block."""
    blocks = assets.agg(F.greatest(F.ceil(F.count_distinct("asset") / F.lit(block)), F.lit(1)).cast("int")).scalar()
    own = F.pmod(F.xxhash64("asset"), blocks).cast("int")
    spread = series.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other")
    return spread.repartition(task_count(series.sparkSession), *key, "bi", "bj")


def pair_edges(
    indexed: DataFrame,
    windows: DataFrame,
    spec: PairSpec,
    members: Optional[DataFrame] = None,
    stretch: int = STRETCH,
    block: int = BLOCK,
) -> DataFrame:
    """Edges ``(start_pos, end_pos, asset_i, asset_j, value)`` with ``asset_i < asset_j``.

    A positive value means asset_i leads asset_j; the other triangle is its negative.
    ``windows`` needs distinct ``(start_pos, end_pos)`` rows of any length.
    """
    series = series_blocks(indexed, windows, members, stretch)
    tiles = _tiles(series, indexed, ["stretch"], block)
    return tiles.groupBy("stretch", "bi", "bj").applyInArrow(_tile_function(spec, members is not None, False), EDGE_SCHEMA)


def pair_partials(
    indexed: DataFrame,
    windows: DataFrame,
    spec: PairSpec,
    members: Optional[DataFrame] = None,
    stretch: int = STRETCH,
    block: int = BLOCK,
) -> DataFrame:
    """Per (window, asset, tile) sums over the matrix row, summed before any shuffle.

    Metrics, scores and stability follow from these rows; the edges, whose number grows
    with the square of the assets, never leave their task. A window may name the one before it
    (``prev_start_pos``, ``prev_end_pos``, of any length; -1 in the result where there is none): the products with it
    are taken in the tile. With ``members`` a window's row sums run over its own universe, the products over pairs that
    are in both universes; ``prev_pairs`` counts an asset's pairs in the earlier one.
    """
    series = series_blocks(indexed, windows, members, stretch)
    tiles = _tiles(series, indexed, ["stretch"], block)
    return tiles.groupBy("stretch", "bi", "bj").applyInArrow(_tile_function(spec, members is not None, True), PARTIAL_SCHEMA)


def window_returns(
    indexed: DataFrame, windows: DataFrame, members: Optional[DataFrame] = None, stretch: int = STRETCH
) -> DataFrame:
    """``(start_pos, end_pos, asset, rets)``: the masked returns of every window, aligned by position."""
    series = series_blocks(indexed, windows, members, stretch)
    restricted = members is not None

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row in range(table.num_rows):
                one = table.slice(row, 1)
                grid, before, lo = _dense(one)
                allowed = set(one["member_ends"][0].as_py() or ()) if restricted else None
                by_length = {}
                for end, start, _, _ in _window_rows(one):
                    if allowed is None or end in allowed:
                        by_length.setdefault(end - start + 1, []).append(end)
                for length, ends in by_length.items():
                    ends = np.array(ends)
                    values = _masked(grid, before, lo, ends, length)[:, 0]
                    offsets = pa.array(np.arange(0, values.size + 1, length, dtype=np.int32))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "start_pos": pa.array((ends - length + 1).astype(np.int32)),
                            "end_pos": pa.array(ends.astype(np.int32)),
                            "asset": one["asset"].combine_chunks().take(pa.array(np.zeros(len(ends), dtype=np.int64))),
                            "rets": pa.ListArray.from_arrays(offsets, pa.array(values.ravel())),
                        }
                    )

    return series.mapInArrow(expand, RETURNS_SCHEMA)


def pair_edges_of_series(series: DataFrame, spec: PairSpec, block: int = BLOCK) -> DataFrame:
    """Edges from ready return arrays ``(window_id, asset, rets)``, for windows in any row order."""
    tiles = _tiles(series.select("window_id", "asset", "rets"), series, ["window_id"], block)
    kind = series.schema["window_id"].dataType.simpleString()
    schema = f"window_id {kind}, asset_i string, asset_j string, value double"
    arrow_id = pa.int64() if kind == "bigint" else pa.int32()
    empty = pa.table(
        {
            "window_id": pa.array([], arrow_id),
            "asset_i": pa.array([], pa.string()),
            "asset_j": pa.array([], pa.string()),
            "value": pa.array([], pa.float64()),
        }
    )

    def tile(key, table):
        left, right, diagonal = _sides(table)
        if left.num_rows == 0 or right.num_rows == 0:
            return empty
        i, j, value, _ = _oriented(pair_values(spec, _stack(left), _stack(right)), left, right, diagonal, None, None)
        return pa.table(
            {
                "window_id": pa.array(np.full(len(i), key[0].as_py()), table.schema.field("window_id").type),
                "asset_i": _named(left, right, i),
                "asset_j": _named(left, right, j),
                "value": pa.array(value),
            }
        )

    return tiles.groupBy("window_id", "bi", "bj").applyInArrow(tile, schema)


def mirrored(edges: DataFrame, *extra: str) -> DataFrame:
    """Both triangles: ``(…, asset, other, value)`` with the sign of the row's asset."""
    return edges.select(
        *extra,
        F.explode(
            F.array(
                F.struct(F.col("asset_i").alias("asset"), F.col("asset_j").alias("other"), F.col("value").alias("value")),
                F.struct(F.col("asset_j").alias("asset"), F.col("asset_i").alias("other"), (-F.col("value")).alias("value")),
            )
        ).alias("cell"),
    ).select(*extra, "cell.*")


# ---------------------------------------------------------------- tile arithmetic


def _flat(table, name):
    column = table[name].combine_chunks()
    return np.asarray(column.flatten().fill_null(-1)), np.diff(np.asarray(column.offsets))


def _dense(table):
    """Returns and previous positions of the block's series on the stretch's positions."""
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    grid = np.zeros((table.num_rows, hi - lo + 1))
    before = np.full(grid.shape, -1, dtype=np.int64)
    positions, counts = _flat(table, "pos")
    rows = np.repeat(np.arange(table.num_rows), counts)
    grid[rows, positions - lo] = _flat(table, "ret")[0]
    before[rows, positions - lo] = _flat(table, "prev_pos")[0]
    return grid, before, lo


def _masked(grid, before, lo, ends, length):
    """(windows, assets, length) returns; a return from outside its window counts as 0."""
    at = ends - length + 1 - lo
    views = [np.lib.stride_tricks.sliding_window_view(a, length, axis=1)[:, at] for a in (grid, before)]
    return np.where(views[1] >= (at + lo)[None, :, None], views[0], 0.0).transpose(1, 0, 2)


def _window_rows(table):
    return [(w["end_pos"], w["start_pos"], w["prev_end"], w["prev_start"]) for w in table["windows"][0].as_py()]


def _sides(table):
    """Split a tile's rows into its two blocks, each sorted by asset."""
    table = table.sort_by("asset")
    block = np.asarray(table["block"])
    bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
    if bi == bj:
        return table, table, True
    return table.filter(pa.array(block == bi)), table.filter(pa.array(block == bj)), False


def _stack(side):
    width = len(side["rets"][0]) if side.num_rows else 1
    return _flat(side, "rets")[0].reshape(1, side.num_rows, width)


def _named(left, right, code):
    names = pa.concat_arrays([left["asset"].combine_chunks(), right["asset"].combine_chunks()])
    return names.take(pa.array(code))


def _oriented(values, left, right, diagonal, left_in, right_in):
    """Cells of the tile as (first asset, second asset, value, window), smaller name first.

    Off the diagonal, asset numbers run over the left block and then the right block.
    """
    windows, n, m = values.shape
    if diagonal:
        a, b = np.triu_indices(n, k=1)
        first, second, sign = a, b, np.ones(len(a))
    else:
        a, b = (part.ravel() for part in np.indices((n, m)))
        names_l, names_r = (np.asarray(s["asset"].to_pylist(), dtype=object) for s in (left, right))
        swap = names_l[a] > names_r[b] if len(a) else np.zeros(0, dtype=bool)
        first, second = np.where(swap, b + n, a), np.where(swap, a, b + n)
        sign = np.where(swap, -1.0, 1.0)
    cells = values[:, a, b] * sign
    if left_in is None:
        at = np.repeat(np.arange(windows), len(a))
        return np.tile(first, windows), np.tile(second, windows), cells.ravel(), at
    keep = left_in[:, a] & right_in[:, b]
    at, cell = np.nonzero(keep)
    return first[cell], second[cell], cells[keep], at


def _batches(spec, ends, length, series):
    """Cut a list of windows so that a kernel call stays within its working size."""
    size = max(1, int(BATCH_DOUBLES // max(1, doubles_per_series(spec, length) * max(1, series))))
    for at in range(0, len(ends), size):
        yield ends[at : at + size]


def _member_mask(side, ends):
    column = side["member_ends"].to_pylist()
    return np.array([np.isin(ends, list(c or ())) for c in column]).reshape(side.num_rows, len(ends)).T


def _tile_function(spec: PairSpec, restricted: bool, partial: bool):
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right, diagonal = _sides(table)
        if left.num_rows == 0 or right.num_rows == 0:
            return
        grid_l, before_l, lo = _dense(left)
        grid_r, before_r, _ = (grid_l, before_l, lo) if diagonal else _dense(right)

        def values_for(ends, length):
            x = _masked(grid_l, before_l, lo, ends, length)
            return pair_values(spec, x, x if diagonal else _masked(grid_r, before_r, lo, ends, length))

        if partial:
            yield from _partial_rows(spec, left, right, diagonal, restricted, _window_rows(table), values_for)
            return
        by_length = {}
        for end, start, _, _ in _window_rows(table):
            by_length.setdefault(end - start + 1, []).append(end)
        for length, rows in by_length.items():
            for ends in _batches(spec, np.array(rows), length, left.num_rows + right.num_rows):
                inside = (_member_mask(left, ends), _member_mask(right, ends)) if restricted else (None, None)
                i, j, value, at = _oriented(values_for(ends, length), left, right, diagonal, *inside)
                end = ends[at].astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "start_pos": pa.array(end - np.int32(length - 1)),
                        "end_pos": pa.array(end),
                        "asset_i": _named(left, right, i),
                        "asset_j": _named(left, right, j),
                        "value": pa.array(value),
                    }
                )

    return tile


def _partial_rows(spec, left, right, diagonal, restricted, rows, values_for):
    """Row sums of the tile for each window, with products against the window before, whatever its length."""
    size = left.num_rows + right.num_rows
    by_length = {}
    for end, start, prev_end, prev_start in rows:
        by_length.setdefault(end - start + 1, set()).add(end)
        if prev_end is not None:
            by_length.setdefault(prev_end - prev_start + 1, set()).add(prev_end)
    place, parts = {}, []
    for length, wanted in by_length.items():
        wanted = np.array(sorted(wanted))
        place.update({(end, length): len(place) + k for k, end in enumerate(wanted.tolist())})
        parts += [values_for(ends, length) for ends in _batches(spec, wanted, length, size)]
    matrices = np.concatenate(parts)
    none = np.array([-1 if prev is None else prev for _, _, prev, _ in rows])
    windows = np.array([(end, start, -1 if prev is None else prev, -1 if prev is None else first) for end, start, prev, first in rows])
    now = np.array([place[end, end - start + 1] for end, start, _, _ in rows])
    then = np.array([now[k] if prev is None else place[prev, prev - first + 1] for k, (_, _, prev, first) in enumerate(rows)])
    step = max(1, BATCH_DOUBLES // max(1, 8 * left.num_rows * right.num_rows))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        has_prev = none[part] >= 0
        inside = None
        if restricted:
            ends, before = windows[part, 0], windows[part, 2]
            inside = [(_member_mask(side, ends), _member_mask(side, before) & has_prev[:, None]) for side in (left, right)]
        a, b = matrices[now[part]], matrices[then[part]]
        yield _row_sums(left, a, b, has_prev, windows[part], diagonal, inside)
        if not diagonal:
            turned = (-a.transpose(0, 2, 1), -b.transpose(0, 2, 1))
            yield _row_sums(right, *turned, has_prev, windows[part], False, inside and inside[::-1])


def _row_sums(side, now, then, has_prev, windows, diagonal, inside):
    count, n, width = now.shape
    if inside is None:
        keep = np.ones((count, n), dtype=bool)
        pairs = np.full((count, n), width - diagonal, dtype=np.int64)
        prev_pairs = shared_pairs = pairs * has_prev[:, None]
        shared, then = now * has_prev[:, None, None], then * has_prev[:, None, None]
    else:
        (keep, prev_own), (other, prev_other) = inside
        cell, before = keep[:, :, None] & other[:, None, :], prev_own[:, :, None] & prev_other[:, None, :]
        if diagonal:
            apart = ~np.eye(n, dtype=bool)
            cell, before = cell & apart, before & apart
        both = cell & before
        pairs, prev_pairs, shared_pairs = (c.sum(axis=2, dtype=np.int64) for c in (cell, before, both))
        now, shared, then = np.where(cell, now, 0.0), np.where(both, now, 0.0), np.where(both, then, 0.0)
    at, asset = np.nonzero(keep)

    def flat(values):
        return pa.array(values[keep])

    place = [pa.array(windows[at, k].astype(np.int32)) for k in (1, 0, 3, 2)]
    names = ("start_pos", "end_pos", "prev_start_pos", "prev_end_pos")
    return pa.RecordBatch.from_pydict(
        {
            **dict(zip(names, place)),
            "asset": side["asset"].combine_chunks().take(pa.array(asset)),
            "pairs": flat(pairs),
            "row_sum": flat(now.sum(axis=2)),
            "abs_sum": flat(np.abs(now).sum(axis=2)),
            "max_abs": flat(np.abs(now).max(axis=2, initial=0.0)),
            "prev_pairs": flat(prev_pairs),
            "shared_pairs": flat(shared_pairs),
            "shared_sum": flat(shared.sum(axis=2)),
            "shared_prev_sum": flat(then.sum(axis=2)),
            "cross": flat((shared * then).sum(axis=2)),
            "sq": flat((shared * shared).sum(axis=2)),
            "prev_sq": flat((then * then).sum(axis=2)),
        }
    )


# ---------------------------------------------------------------- other window shapes


def pair_measure(series: DataFrame, keys: list, measure, block: int = BLOCK) -> DataFrame:
    """Edges of a measure of one's own, ``measure(x, y) -> Column`` over aligned arrays.

    ``series`` has one array ``rets`` per (keys, asset). The pair join is keyed by window and
    tile, so a window with very many assets is spread over its tiles.
    """
    blocks = series.agg(F.greatest(F.ceil(F.count_distinct("asset") / F.lit(block)), F.lit(1)).cast("int")).scalar()
    own = F.pmod(F.xxhash64("asset"), blocks).cast("int")
    cut = series.select(*keys, "asset", "rets").withColumn("own", own)
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = cut.select(*keys, F.col("asset").alias("asset_i"), F.col("rets").alias("x"), F.col("own").alias("bi"), every.alias("bj"))
    right = cut.select(*keys, F.col("asset").alias("asset_j"), F.col("rets").alias("y"), F.col("own").alias("bj"), every.alias("bi"))
    ordered = F.col("asset_i") < F.col("asset_j")
    pairs = left.join(right, [*keys, "bi", "bj"]).where(ordered)
    return pairs.select(*keys, "asset_i", "asset_j", measure(F.col("x"), F.col("y")).alias("value"))


def shuffled_series(prices: DataFrame, order: DataFrame, lookback: int, update_freq: int = 1) -> DataFrame:
    """Return arrays of placebo windows ``(window_id, end_ts, asset, rets)``.

    ``order(ts, pos)`` is a shuffled calendar. A window is named by the rows at positions
    ``i - lookback + 1`` and ``i``, holds every row dated between their timestamps, and keeps
    the shuffled order inside. Where the first is the later date the window is empty.
    """
    ends = order.where((F.col("pos") >= lookback) & ((F.col("pos") - lookback) % update_freq == 0)).select(
        F.col("pos").alias("window_id"), F.col("ts").alias("end_ts"), (F.col("pos") - lookback + 1).alias("pos")
    )
    windows = ends.join(order.select("pos", F.col("ts").alias("start_ts")), "pos").drop("pos").where("start_ts <= end_ts")
    months = F.sequence(F.trunc("start_ts", "MM"), F.trunc("end_ts", "MM"), F.expr("INTERVAL 1 MONTH"))
    inside = (
        windows.withColumn("month", F.explode(months))
        .join(order.withColumn("month", F.trunc("ts", "MM")), "month")
        .where(F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    )
    by_window = Window.partitionBy("window_id")
    rows = inside.select(
        "window_id",
        "ts",
        F.row_number().over(by_window.orderBy("pos")).alias("row"),
        F.count(F.lit(1)).over(by_window).alias("rows"),
    )
    timeline = Window.partitionBy("window_id", "asset").orderBy("row")
    observed = rows.join(prices.select("ts", "asset", "price"), "ts").select(
        "window_id",
        "asset",
        "rows",
        F.struct("row", log_return(F.col("price"), F.lag("price").over(timeline)).alias("ret")).alias("obs"),
    )
    last = order.agg(F.max("pos")).scalar()
    every = prices.select("asset").distinct().withColumn("window_id", F.explode(F.sequence(F.lit(lookback), last)))
    present = every.join(rows.select("window_id", "rows").distinct(), "window_id").select(
        "window_id", "asset", "rows", F.lit(None).cast(observed.schema["obs"].dataType).alias("obs")
    )
    packed = (
        observed.unionByName(present)
        .groupBy("window_id", "asset")
        .agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list("obs")).alias("obs"))
        .select("window_id", "asset", "rows", F.col("obs.row").alias("row"), F.col("obs.ret").alias("ret"))
    )
    dense = packed.mapInArrow(_fill_rows, "window_id int, asset string, rets array<double>")
    return dense.join(windows.select("window_id", "end_ts"), "window_id")


def _fill_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spread each series over all rows of its window; rows without observation return 0."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.asarray(table["rows"]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        rows, counts = _flat(table, "row")
        flat = np.zeros(starts[-1])
        flat[np.repeat(starts[:-1], counts) + rows - 1] = _flat(table, "ret")[0]
        yield pa.RecordBatch.from_pydict(
            {
                "window_id": table["window_id"].combine_chunks(),
                "asset": table["asset"].combine_chunks(),
                "rets": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat)),
            }
        )
