"""Lloyd's clustering sharded by dimension, in exact integers.

Vectors are stored as chunks of rows times blocks of columns. In a round every (chunk, column block) is worked on
apart: a task holds the slice of the centroids that belongs to its columns and computes the partial squared
distances of its rows to all of them. The partial distances of a chunk are added by key over its column blocks
and the smallest sum is the assignment, which goes back to the column blocks of the chunk; each block sums its
own columns by centroid, and the sums of a shard make the new slice of the centroids. Once dealt, a chunk's columns
are never put together again, so neither the number of vectors nor a long vector's centroids have to fit a task.

The driver holds the centroids (``clusters`` times the length of a vector), nothing else.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.session import stage

#: Integers beyond this count as it: squares over 1,024 components and sums over 2**36 rows stay within 64 bits.
LARGEST = 1 << 26
_TOP = (1 << 63) - 1


@dataclass(frozen=True)
class LloydSpec:
    """``size``: components of a usable vector; ``scale``: a component becomes ``floor(scale * x)``. ``width``: columns
    of a block, ``chunk``: rows of a block."""

    clusters: int = 16
    rounds: int = 3
    size: int = 64
    scale: float = 64.0
    width: int = 16
    chunk: int = 4096
    seed: int = 1

    @property
    def shards(self) -> list[tuple[int, int]]:
        return [(a, min(a + self.width, self.size)) for a in range(0, self.size, self.width)]


def usable(vectors: DataFrame, spec: LloydSpec = LloydSpec(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` of the rows whose vector has ``size`` components, none null or non-finite, as integers."""
    vec = F.col(vector_col).cast("array<double>")
    fine = (F.size(vec) == spec.size) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x * spec.scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST))))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec, whole).alias("vec"))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances; in floating point only where every sum stays below 2**53."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) < 1 << 20 and x.shape[1] <= 1024:
        x, centres = x.astype(np.float64), centres.astype(np.float64)
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return square.astype(np.int64)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def blocks(rows: DataFrame, spec: LloydSpec) -> tuple[DataFrame, DataFrame]:
    """``(chunk, ids)`` and ``(chunk, shard, cells)``: rows dealt into chunks, and the columns of every chunk apart, row by row."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), spec.chunk):
                part = batch.slice(at, spec.chunk)
                x = _rows(part.column(1), spec.size)
                ids = pa.array([part.column(0).to_pylist()] + [None] * len(spec.shards), pa.list_(pa.int64()))
                cells = [None, *(x[:, a:b].ravel() for a, b in spec.shards)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(cells)), pa.array(range(-1, len(spec.shards)), pa.int32()), ids, pa.array(cells, pa.list_(pa.int64()))],
                    ["chunk", "shard", "ids", "cells"],
                )
                n += 1

    dealt = stage(rows.mapInArrow(deal, "chunk long, shard int, ids array<long>, cells array<long>"), "blocks")
    return dealt.where("shard < 0").select("chunk", "ids"), dealt.where("shard >= 0").select("chunk", "shard", "cells")


def assigned(cells: DataFrame, centres: np.ndarray, spec: LloydSpec) -> DataFrame:
    """``(chunk, own, square)``: for each row of a chunk, in order, the nearest centroid (ties: the smaller number) and its squared distance."""
    slices = [np.ascontiguousarray(centres[:, a:b]) for a, b in spec.shards]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                centre = slices[batch.column(1)[k].as_py()]
                square = _squares(batch.column(2)[k].values.to_numpy().reshape(-1, centre.shape[1]), centre)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([square.tobytes()], pa.binary())], ["chunk", "part"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                total = sum(np.frombuffer(part.as_buffer(), dtype=np.int64) for part in batch.column(1)[k].values).reshape(-1, len(centres))
                own = total.argmin(axis=1)
                square = total[np.arange(len(own)), own]
                lists = [pa.array([own.astype(np.int32)], pa.list_(pa.int32())), pa.array([square], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *lists], ["chunk", "own", "square"])

    parts = cells.mapInArrow(partial, "chunk long, part binary").groupBy("chunk").agg(F.collect_list("part").alias("parts"))
    return parts.mapInArrow(least, "chunk long, own array<int>, square array<long>")


def slice_sums(cells: DataFrame, owners: DataFrame, clusters: int, spec: LloydSpec) -> DataFrame:
    """``(shard, cluster, n, sums)``: every shard's own columns summed by cluster."""
    widths = [b - a for a, b in spec.shards]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: (np.zeros(clusters, dtype=np.int64), np.zeros((clusters, w), dtype=np.int64)) for s, w in enumerate(widths)}
        for batch in batches:
            for k in range(len(batch)):
                shard, own = batch.column(0)[k].as_py(), batch.column(2)[k].values.to_numpy()
                x = batch.column(1)[k].values.to_numpy().reshape(len(own), widths[shard])
                n, sums = held[shard]
                n += np.bincount(own, minlength=clusters)
                np.add.at(sums, own, x)
        rows = [(s, c, int(n[c]), sums[c]) for s, (n, sums) in held.items() for c in np.flatnonzero(n).tolist()]
        shard, cluster, n, sums = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.int32()), pa.array(cluster, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
            ["shard", "cluster", "n", "sums"],
        )

    met = cells.join(owners.select("chunk", "own"), "chunk").select("shard", "cells", "own")
    part = met.mapInArrow(add, "shard int, cluster int, n long, sums array<long>")
    flat = part.select("shard", "cluster", "n", F.posexplode("sums").alias("column", "x"))
    return flat.groupBy("shard", "cluster", "column").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def first_centroids(rows: DataFrame, spec: LloydSpec) -> np.ndarray:
    """The vectors of the smallest hashes of ``seed:id`` (a vector without an id never starts; of equal ids the smaller vector comes first)."""
    rank = F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where("vec_id IS NOT NULL").orderBy(rank, "vec").limit(spec.clusters).collect()
    return np.array([r["vec"] for r in first], dtype=np.int64).reshape(len(first), spec.size)


def lloyd(vectors: DataFrame, spec: LloydSpec = LloydSpec(), id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of every usable vector, and the final centroids, one row each.

    Vectors that are null, of another size or hold a null or non-finite component take no part. Rows without an id
    and repeated rows are clustered like others. With fewer vectors than clusters each starts one; an emptied cluster
    keeps its centroid. An empty table gives no row and no centroid. Components past ``LARGEST / scale`` count as that. Other
    columns, whatever their names, are not read.
    """
    rows = usable(vectors, spec, id_col, vector_col)
    centres = first_centroids(rows, spec)
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centres
    ids, cells = blocks(rows, spec)
    for turn in range(spec.rounds):
        owners = stage(assigned(cells, centres, spec), f"round-{turn}")
        centres = centres.copy()
        for shard, cluster, column, n, x in slice_sums(cells, owners, len(centres), spec).collect():
            centres[cluster, spec.shards[shard][0] + column] = x // n
    last = ids.join(assigned(cells, centres, spec), "chunk")
    each = last.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("own").alias("own"), F.col("square").alias("square"))).alias("v"))
    out = each.select(F.col("v.id").alias("vec_id"), F.col("v.own").alias("cluster"), F.col("v.square").alias("distance"))
    return stage(out, "clusters"), centres


def with_inertia(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds each cluster's ``cluster_inertia``, the whole ``inertia`` and the ``centroid_sha256``; one row per cluster passes the driver."""
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    known = range(max(1, len(centres)))
    return found.select(
        "*",
        at([min(inertia.get(c, 0), _TOP) for c in known]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), _TOP)).cast("long").alias("inertia"),
        at(digest or [""]).alias("centroid_sha256"),
    )
