"""Nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised by centroids of its own, so ``k`` centroids per half make ``k * k`` cells. A
query visits cells from the best down: a heap walks the pairs of centroids in the order of the summed inner
products of its halves with them (the sum of distances of this measure, best first), until the cells hold
``reach`` of all vectors, then every vector of these cells is scored exactly. The first cells are scored ahead: the last of
a query's best there is a floor, below which the other cells need not report anything.

Work is dealt by the first half's centroid, a query being sent there once with the cells it visits; the vectors of a
centroid and the queries that meet them are split into blocks, so equal vectors in any number stay spread. A centroid's
blocks are dealt to as many shares as they need, each of which gets the centroid's queries.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairtide.session import stage


@dataclass(frozen=True)
class NearestSpec:
    """``sample`` bounds the vectors the centroids are fitted on (about). ``reach``: share of all different vectors a query meets,
    ``least`` of them at least. ``ahead``: vectors that set a query's floor. ``share``: blocks of a centroid that are scored under one key."""

    top: int = 20
    centroids: int = 64
    sample: int = 20_000
    rounds: int = 10
    reach: float = 0.5
    least: int = 2000
    ahead: int = 200
    block: int = 512
    share: int = 64
    seed: int = 9


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` in double precision without null, zero, non-finite or odd-sized vectors.

    Rows without an id take no part; of rows that share an id the smallest vector counts; the size that
    most vectors have is the right one (the smaller of two).
    """
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & fine)
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("vec") == (sizes[0] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _centroids(x: np.ndarray, spec: NearestSpec) -> np.ndarray:
    """Plain k-means; an emptied centroid moves to the worst served vector."""
    rng = np.random.default_rng(spec.seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[: spec.centroids]].copy()
    for _ in range(spec.rounds):
        distance = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
        own = distance.argmin(axis=1)
        for k in range(len(centres)):
            mine = own == k
            centres[k] = x[mine].mean(axis=0) if mine.any() else x[distance.min(axis=1).argmax()]
    return centres


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def visit(left: np.ndarray, right: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells from the largest ``left[i] + right[j]`` down, until they hold ``enough`` vectors."""
    by_left, by_right = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap, seen, out, held = [(-(left[by_left[0]] + right[by_right[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = (int(by_left[i]), int(by_right[j]))
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(by_left) and b < len(by_right) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(left[by_left[a]] + right[by_right[b]]), a, b))
    return out


class _Best:
    """The best so far of each query met, in ``(score down, id up)`` order."""

    def __init__(self, top: int):
        self.top, self.held = top, {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.held:
            ids, scores = np.concatenate((self.held[query][0], ids)), np.concatenate((self.held[query][1], scores))
        order = np.lexsort((ids, -scores))[: self.top]
        self.held[query] = ids[order], scores[order]

    def out(self) -> pa.RecordBatch:
        held, self.held = self.held, {}
        size = [len(v[0]) for v in held.values()]
        none = [np.zeros(0, dtype=np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(list(held), dtype=np.int64), size)),
                pa.array(np.concatenate([v[0] for v in held.values()] or none)),
                pa.array(np.concatenate([v[1] for v in held.values()] or none).astype(np.float64)),
            ],
            ["query_id", "vec_id", "score"],
        )


def nearest(vectors: DataFrame, is_query, spec: NearestSpec = NearestSpec(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found of each row where ``is_query`` (a condition on
    ``vec_id``) holds, nearest first, ties to the smaller id, the query's own row left out."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n < 2:
        return spark.createDataFrame([], schema)
    drawn = rows.sample(fraction=min(1.0, spec.sample / n), seed=spec.seed).orderBy("vec_id").select("vec").collect()
    x = np.array([r[0] for r in drawn] or [rows.first()["vec"]])
    half = max(1, x.shape[1] // 2)
    books = _centroids(x[:, :half], spec), _centroids(x[:, half:], spec) if x.shape[1] > half else np.zeros((1, 0))
    wide = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            cell = _assign(m[:, :half], books[0]) * wide + _assign(m[:, half:], books[1]) if len(m) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "vec", "cell"])

    index = stage(rows.mapInArrow(place, "vec_id long, vec array<double>, cell int"), "cells")
    # one row per pair of centroids at most; copies of a vector count once towards the reach, so a hot one does not use it up
    sizes = index.groupBy("cell", F.xxhash64("vec").alias("copy")).count().groupBy("cell").agg(F.sum("count"), F.count("*")).collect()
    counted, counts = {r[0]: r[1] for r in sizes}, np.zeros((len(books[0]), wide), dtype=np.int64)
    for cell, _, distinct in sizes:
        counts[divmod(cell, wide)] = distinct
    enough = max(spec.least, int(spec.reach * counts.sum()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            left, right = m[:, :half] @ books[0].T, m[:, half:] @ books[1].T
            out = []
            for k in range(len(m)):
                path = visit(left[k], right[k], counts, enough)
                first = int(np.searchsorted(np.cumsum([counts[c] for c in path]), spec.ahead)) + 1
                by_left: dict[int, tuple[list[int], list[int]]] = {}
                for turn, (i, j) in enumerate(path):
                    by_left.setdefault(i, ([], []))[turn >= first].append(j)
                out.append([{"side": i, "soon": soon, "late": late} for i, (soon, late) in by_left.items()])
            kind = pa.list_(pa.struct([("side", pa.int32()), ("soon", pa.list_(pa.int32())), ("late", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], ["vec_id", "vec", "visits"])

    shape = "vec_id long, vec array<double>, visits array<struct<side:int,soon:array<int>,late:array<int>>>"
    routed = stage(rows.where(is_query).mapInArrow(route, shape), "routes")
    asked = routed.select("vec_id", "vec", F.explode("visits").alias("v")).select("vec_id", "vec", "v.side", "v.soon", "v.late")
    blocks = lambda frame, size: frame.withColumn("block", F.pmod(F.xxhash64("vec_id"), size))
    held = {i: sum(size for cell, size in counted.items() if cell // wide == i) for i in range(len(books[0]))}
    parts = F.greatest(F.lit(1), F.ceil(F.element_at(F.create_map(*[F.lit(v) for kv in held.items() for v in kv]), F.col("side")) / spec.block))
    shares = F.ceil(parts / spec.share)
    there = (
        blocks(index.withColumn("side", F.floor(F.col("cell") / wide).cast("int")), parts)
        .groupBy("side", "block").agg(F.collect_list(F.struct("vec_id", "vec", (F.col("cell") % wide).alias("other"))).alias("all"))
        .select("side", F.pmod("block", shares).alias("share"), F.col("all.vec_id").alias("ids"), F.flatten("all.vec").alias("vecs"), F.col("all.other").alias("others"))
    )
    groups = max(1, -(-n // (20 * spec.block)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(spec.top)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, query_ids, floors, others = (batch.column(c)[k].values.to_numpy() for c in (0, 2, 4, 6))
                m, q = (batch.column(c)[k].values.to_numpy().reshape(len(i), -1) for c, i in ((1, ids), (3, query_ids)))
                rough = q @ m.T
                for r, (query, open_cells) in enumerate(zip(query_ids.tolist(), batch.column(5)[k].values)):
                    inside = np.zeros(wide, dtype=bool)
                    inside[open_cells.values.to_numpy()] = True
                    own, floor = np.where(inside[others], rough[r], -np.inf), floors[r]
                    if len(own) > spec.top + 1:
                        floor = max(floor, np.partition(own, len(own) - spec.top - 1)[len(own) - spec.top - 1])
                    near = np.flatnonzero(own >= (floor - 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else -1e300))
                    near = near[ids[near] != query]
                    # scored again row by row, so equal vectors tie exactly
                    exact = (m[near] * q[r]).sum(axis=1)
                    enough_ = exact >= floors[r]
                    if enough_.any():
                        best.add(query, ids[near][enough_], exact[enough_])
            if len(best.held) > 20_000:
                yield best.out()
        yield best.out()

    def scored(queries: DataFrame) -> DataFrame:
        here = (
            blocks(queries, F.lit(groups)).groupBy("side", "block").agg(F.collect_list(F.struct("vec_id", "vec", "floor", "cells")).alias("all"))
            .select("side", F.col("all.vec_id").alias("query_ids"), F.flatten("all.vec").alias("query_vecs"), F.col("all.floor").alias("floors"), F.col("all.cells").alias("cells"))
            .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
        )
        both = there.join(here, ["side", "share"]).select("ids", "vecs", "query_ids", "query_vecs", "floors", "cells", "others")
        return both.mapInArrow(score, "query_id long, vec_id long, score double")

    none = F.lit(float("-inf"))
    ahead = stage(scored(asked.where("size(soon) > 0").select("vec_id", "vec", "side", F.col("soon").alias("cells")).withColumn("floor", none)), "ahead")
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    last = ahead.withColumn("at", F.row_number().over(line)).where(F.col("at") == spec.top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = asked.where("size(late) > 0").select("vec_id", "vec", "side", F.col("late").alias("cells")).join(last, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    found = ahead.union(scored(rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.top).select("query_id", "rank", "vec_id", "score")
