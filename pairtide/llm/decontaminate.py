"""Benchmark decontamination: BM25 over the test items, block-max WAND, overlap of question and answer.

Items (cut into segments of at most ``segment`` words) form an inverted index; every passage of every
document is a query against it. Passages are ``2 * segment`` words long and begin every ``segment`` words,
so a copied segment lies wholly in one of them. An impact is a term's BM25 weight in an item divided by the item's
weight against itself, so scores lie between 0 and 1 and one threshold holds for all items.

Retrieval is exact for the threshold: for each passage the block maxima of its terms are summed per block of
items; blocks that cannot reach the threshold are skipped, and in the others items are scored one by one in
the order of WAND. Each hit is verified on word trigrams of the item's question and answer.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.llm import words as W
from pairtide.llm.tables import texts

#: Words are runs of letters, digits and bytes above ASCII.
_TERM = W.byte_table([b for b in range(128) if not chr(b).isalnum()], lower=True)


@dataclass(frozen=True)
class LeakSpec:
    """``answer_share``: the last words of an item that count as its answer. ``shard``: segments per index part;
    ``parts``: index parts that one pass over the documents carries, which bounds what is broadcast."""

    segment: int = 64
    threshold: float = 0.6
    overlap: float = 0.6
    answer_share: float = 0.25
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    shard: int = 1024
    parts: int = 4


class _Index:
    """One shard: impacts by term and item, their maxima per block of items, and the segments' words."""

    def __init__(self, segments: list[tuple[int, np.ndarray]], idf: dict[int, float], mean_length: float, spec: LeakSpec):
        self.items = [item for item, _ in segments]
        self.segments = [s for _, s in segments]
        self.terms = np.unique(np.concatenate(self.segments))
        blocks = -(-len(segments) // spec.block)
        self.top = np.zeros((len(self.terms), blocks), dtype=np.float32)
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, segment in enumerate(self.segments):
            term, tf = np.unique(segment, return_counts=True)
            norm = spec.k1 * (1 - spec.b + spec.b * len(segment) / mean_length)
            weight = np.array([idf[t] for t in term.tolist()]) * tf * (spec.k1 + 1) / (tf + norm)
            impact = weight / weight.sum()
            at = np.searchsorted(self.terms, term)
            self.top[at, item // spec.block] = np.maximum(self.top[at, item // spec.block], impact)
            for t, x in zip(at.tolist(), impact.tolist()):
                self.postings[t].append((item, x))

    def search(self, terms: list[int], open_blocks: list[int], spec: LeakSpec) -> list[tuple[int, float]]:
        """Items of the open blocks with at least the threshold, by WAND over the terms' postings."""
        found = []
        for block in open_blocks:
            low, high = block * spec.block, (block + 1) * spec.block
            cursors = []
            for t in terms:
                bound = float(self.top[t, block])
                if bound > 0:
                    own = [p for p in self.postings[t] if low <= p[0] < high]
                    cursors.append([own[0][0], bound, 0, own])
            while cursors:
                cursors.sort(key=lambda c: c[0])
                total, pivot = 0.0, None
                for c in cursors:
                    total += c[1]
                    if total >= spec.threshold - 1e-6:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                if cursors[0][0] == pivot:
                    score = sum(c[3][c[2]][1] for c in cursors if c[0] == pivot)
                    if score >= spec.threshold:
                        found.append((pivot, score))
                    reach = pivot + 1
                else:
                    reach = pivot
                for c in cursors:
                    while c[2] < len(c[3]) and c[3][c[2]][0] < reach:
                        c[2] += 1
                    c[0] = c[3][c[2]][0] if c[2] < len(c[3]) else None
                cursors = [c for c in cursors if c[0] is not None]
        return found


def _trigrams(words: np.ndarray) -> np.ndarray:
    return np.unique(W.grams(words, min(3, max(1, len(words)))))


def _overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's trigrams that the passage holds (a shorter part counts as one)."""
    if not len(part):
        return 1.0
    return float(np.isin(_trigrams(part), W.grams(passage, min(3, len(part)))).mean())


def _segments(items: DataFrame, spec: LeakSpec) -> DataFrame:
    """``(item_id, part, words)``: the items' word hashes in parts of at most ``segment``."""

    def cut(batches):
        for batch in batches:
            data, limits = W.text_bytes(batch.column(1))
            at, hashes = W.words(data, limits, _TERM)
            ends = W.per_text(at, batch.num_rows)
            ids, part, found = [], [], []
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = hashes[ends[i] : ends[i + 1]]
                pieces = max(1, -(-len(own) // spec.segment))
                for k, piece in enumerate(np.array_split(own, pieces) if len(own) else []):
                    ids.append(item)
                    part.append(k)
                    found.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(found, pa.binary())], ["item_id", "part", "words"])

    return texts(items, "item_id").where("doc_id is not null").mapInArrow(cut, "item_id long, part int, words binary")


def leaks(docs: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """``(doc_id, item_id, score, question, answer, start)``: best verified passage of each item in each document.

    ``score`` is the share of the item's BM25 weight that the passage covers, ``question`` and ``answer``
    the shares of trigrams found, ``start`` the passage's first word. Null and empty texts, rows without an
    id and items without a word take no part; repeated rows count once; other columns are not read.
    """
    spark = docs.sparkSession
    source = texts(docs).where("doc_id is not null")
    segments = _segments(items, spec).distinct().orderBy("item_id", "part", "words").collect()
    schema = "doc_id long, item_id long, score double, question double, answer double, start long"
    if not segments:
        return spark.createDataFrame([], schema)
    held = [(r[0], np.frombuffer(r[2], dtype=np.uint64)) for r in segments]
    seen: dict[int, int] = {}
    for _, own in held:
        for t in np.unique(own).tolist():
            seen[t] = seen.get(t, 0) + 1
    idf = {t: float(np.log(1 + (len(held) - n + 0.5) / (n + 0.5))) for t, n in seen.items()}
    mean = sum(len(s) for _, s in held) / len(held)
    found = None
    for begin in range(0, len(held), spec.shard * spec.parts):
        shards = [_Index(held[k : k + spec.shard], idf, mean, spec) for k in range(begin, min(len(held), begin + spec.shard * spec.parts), spec.shard)]
        hits = source.mapInArrow(_matcher(spark.sparkContext.broadcast(shards), spec), schema)
        found = hits if found is None else found.union(hits)
    best = F.max_by(F.struct("score", "question", "answer", "start"), F.struct("score", -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def _matcher(shared, spec: LeakSpec):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = shared.value
        for batch in batches:
            data, limits = W.text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            rows = []
            for a, b in W.slices(limits):
                at, hashes = W.words(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], _TERM)
                if not len(at):
                    continue
                ends = W.per_text(at, b - a)
                count = np.diff(ends)
                each = np.maximum(1, -(-count // spec.segment) - 1) * (count > 0)
                text = np.repeat(np.arange(b - a), each)
                step = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
                start = ends[text] + step * spec.segment
                stop = np.minimum(start + 2 * spec.segment, ends[text + 1])
                for index in shards:
                    rows += [(int(ids[a + text[p]]), *hit, int(start[p] - ends[text[p]])) for p, hit in _retrieved(index, hashes, start, stop, spec)]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "question", "answer", "start"])

    return match


def _retrieved(index: _Index, hashes, start, stop, spec: LeakSpec):
    """``(passage, (item, score, question, answer))`` of every verified hit of the passages ``start:stop``."""
    slot = np.searchsorted(index.terms, hashes)
    slot[slot == len(index.terms)] = 0
    hit = np.flatnonzero(index.terms[slot] == hashes)
    term = slot[hit]
    # bound over all items, terms counted as often as they stand
    run = np.concatenate(([0], np.cumsum(index.top.max(axis=1)[term], dtype=np.float64)))
    low, high = np.searchsorted(hit, start), np.searchsorted(hit, stop)
    near = np.flatnonzero(run[high] - run[low] >= spec.threshold - 1e-4)
    for chunk in range(0, len(near), 2048):
        mine = near[chunk : chunk + 2048]
        size = high[mine] - low[mine]
        passage = np.repeat(np.arange(len(mine)), size)
        own = term[np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[mine], size)]
        both = np.unique(passage * np.int64(len(index.terms)) + own)
        passage, own = both // len(index.terms), both % len(index.terms)
        begin = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        bound = np.add.reduceat(index.top[own], begin, axis=0)
        ends = np.append(begin, len(own))
        for k in np.flatnonzero((bound >= spec.threshold - 1e-4).any(axis=1)):
            p = int(mine[passage[begin[k]]])
            spoken = hashes[start[p] : stop[p]]
            for item, score in index.search(own[ends[k] : ends[k + 1]].tolist(), np.flatnonzero(bound[k] >= spec.threshold - 1e-4).tolist(), spec):
                words = index.segments[item]
                cut = len(words) - max(1, int(len(words) * spec.answer_share)) if len(words) > 1 else 1
                question, answer = _overlap(words[:cut], spoken), _overlap(words[cut:], spoken)
                if min(question, answer) >= spec.overlap:
                    yield p, (index.items[item], score, question, answer)


def without_leaks(docs: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """The rows of ``docs`` whose document holds no test item; rows without an id stay."""
    found = leaks(docs, items, spec).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")
