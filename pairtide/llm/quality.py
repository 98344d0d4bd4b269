"""Quality scores by a generalised additive model with pairwise interactions.

Every feature has a table with one value per bin, grown by cyclic boosting: round after round each feature
in turn gets a shallow tree over its bins, fitted to what is still unexplained, and a small step along it. Then the pairs of features that
explain most of the rest get tables of their own in the same way. A score is a sum of looked-up values, so each
part of it can be read off.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.llm import words as W
from pairtide.llm.tables import texts
from pairtide.session import stage

FEATURES = (
    "letters", "digits", "spaces", "stops", "symbols", "capitals", "word_length", "distinct_words", "top_word",
    "log_words", "line_breaks", "echoes", "longest_word",
)

_KIND = np.full(256, 4)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 3


@dataclass(frozen=True)
class QualitySpec:
    """``sample`` bounds the labelled rows that are fitted (about); ``coarse`` bins per side of a pair."""

    bins: int = 32
    coarse: int = 8
    rounds: int = 200
    pairs: int = 6
    pair_rounds: int = 60
    rate: float = 0.15
    sample: int = 20_000
    seed: int = 4


def _described(data, limits) -> np.ndarray:
    n, size = len(limits) - 1, np.diff(limits)
    out = np.zeros((n, len(FEATURES)))
    full = np.flatnonzero(size)
    if not len(full):
        return out
    begin = limits[full]
    share = lambda mask: np.add.reduceat(mask.astype(np.int64), begin) / size[full]
    kind = _KIND[data]
    for k in range(5):
        out[full, k] = share(kind == k)
    out[full, 5] = share((data >= 65) & (data <= 90)) / np.maximum(out[full, 0], 1e-9)
    out[full, 10] = share(data == 10)
    at, hashes = W.words(data, limits)
    ends = W.per_text(at, n)
    count = np.diff(ends)
    some = np.flatnonzero(count)
    out[some, 6] = (size[some] * (1 - out[some, 2])) / count[some]
    out[:, 9] = np.log1p(count)
    if len(some):
        order = np.lexsort((hashes, at))
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (at[order][1:] != at[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        first = np.flatnonzero(fresh)
        times = np.diff(np.append(first, len(at)))
        owner = at[order][first]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[some, 7] = np.diff(np.append(starts, len(owner))) / count[some]
        out[some, 8] = np.maximum.reduceat(times, starts) / count[some]
        echo = np.zeros(len(at), dtype=np.int64)
        echo[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
        out[some, 11] = np.add.reduceat(echo, ends[some]) / count[some]
    edge = np.flatnonzero(np.concatenate(([True], (kind == 2)[:-1])) | np.isin(np.arange(len(data)), limits[:-1]))
    length = np.diff(np.append(edge, len(data)))
    where = np.searchsorted(edge, begin)
    out[full, 12] = np.log1p(np.maximum.reduceat(length, where))
    return out


def describe(docs: DataFrame) -> DataFrame:
    """``(doc_id, features)`` of every row; an empty or null text has all features 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = W.text_bytes(batch.column(1))
            for a, b in W.slices(limits):
                found = _described(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), listed], ["doc_id", "features"])

    return texts(docs).mapInArrow(run, "doc_id long, features array<double>")


def _tree(gain: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Values per bin of a shallow tree: the best cut of the bins, then of both sides. Newton leaves."""
    g, h = gain.sum(), weight.sum()
    if depth and len(gain) > 1:
        left_g, left_h = np.cumsum(gain)[:-1], np.cumsum(weight)[:-1]
        better = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
        cut = int(better.argmax()) + 1
        if better[cut - 1] > 1e-6:
            return np.concatenate((_tree(gain[:cut], weight[:cut], depth - 1), _tree(gain[cut:], weight[cut:], depth - 1)))
    return np.full(len(gain), g / (h + 1))


class AdditiveModel:
    """Tables per feature and per chosen pair; ``score`` adds them up."""

    def __init__(self, spec: QualitySpec):
        self.spec, self.level, self.pairs = spec, 0.0, []

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        spec = self.spec
        at = np.linspace(0, 1, spec.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], at)) for j in range(x.shape[1])]
        bins = self._bins(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.level = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        total = np.full(len(y), self.level)
        for _ in range(spec.rounds):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-total))
                grown = spec.rate * _tree(
                    np.bincount(bins[:, j], y - p, len(table)), np.bincount(bins[:, j], p * (1 - p), len(table)), 2
                )
                table += grown
                total += grown[bins[:, j]]
        side = spec.coarse
        self.shrink = [np.minimum(np.arange(len(t)) * side // len(t), side - 1) for t in self.tables]
        small = np.stack([self.shrink[j][bins[:, j]] for j in range(x.shape[1])], axis=1)
        p = 1 / (1 + np.exp(-total))
        gains = []
        for j in range(x.shape[1]):
            for k in range(j + 1, x.shape[1]):
                cell = small[:, j] * side + small[:, k]
                g, h = np.bincount(cell, y - p, side * side), np.bincount(cell, p * (1 - p), side * side)
                gains.append((float((g**2 / (h + 1)).sum()), j, k))
        self.pairs = [[j, k, np.zeros((side, side))] for _, j, k in sorted(gains, reverse=True)[: spec.pairs]]
        for _ in range(spec.pair_rounds):
            for j, k, table in self.pairs:
                p = 1 / (1 + np.exp(-total))
                cell = small[:, j] * side + small[:, k]
                g = np.bincount(cell, y - p, side * side).reshape(side, side)
                h = np.bincount(cell, p * (1 - p), side * side).reshape(side, side)
                # cut one side, then the other within each part
                rows = _tree(g.sum(axis=1), h.sum(axis=1), 1)
                grown = np.zeros_like(table)
                for value in np.unique(rows):
                    part = rows == value
                    grown[part] = _tree(g[part].sum(axis=0), h[part].sum(axis=0), 1)
                table += spec.rate * grown
                total += spec.rate * grown.reshape(-1)[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        total = np.full(len(x), self.level)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for j, k, table in self.pairs:
            total += table[self.shrink[j][bins[:, j]], self.shrink[k][bins[:, k]]]
        return 1 / (1 + np.exp(-total))


def train_quality(described: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec()) -> AdditiveModel | None:
    """A model from labelled documents, about ``sample`` of them by a seeded draw.

    Documents labelled both ways are left out; of rows that share a labelled id one counts (with the smallest features), so
    what reaches the driver is bounded by the draw. None if no label meets a document.
    """
    clear = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    n = clear.count()
    if not n:
        return None
    drawn = clear.sample(fraction=min(1.0, spec.sample / n), seed=spec.seed).select("doc_id", F.col("low").alias("quality"))
    met = described.join(drawn, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.max("quality").alias("quality"))
    rows = met.select("features", "quality", "doc_id").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r[2], r[0]))
    return AdditiveModel(spec).fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float))


def quality(docs: DataFrame, labels: DataFrame, learn, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs``, learned from the labels of rows where ``learn`` holds.

    Empty and null texts are scored like any other (all features 0); without a usable label every score is 0.5.
    Repeated rows give repeated rows; other columns are not read.
    """
    described = stage(describe(docs), "features")
    model = train_quality(described, labels.where(learn), spec)

    def run(batches):
        for batch in batches:
            x = batch.column(1).values.to_numpy().reshape(-1, len(FEATURES)) if batch.num_rows else np.zeros((0, len(FEATURES)))
            found = model.score(x) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return described.select("doc_id", "features").mapInArrow(run, "doc_id long, score double, predicted int")
