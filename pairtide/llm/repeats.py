"""Repeated passages: seed on winnowed anchors, extend both ways, remove what was said before.

Seeds: of the ``k``-word hashes inside every window of ``window`` words the smallest (the rightmost of
equals) is the window's anchor. Equal windows choose equal anchors at equal offsets, so a join on anchors
meets every repeat of at least ``window`` words, and about one word in seven is an anchor.

Extension: an anchor's row carries one 40-bit print for each window that chose it. Within the rows of an
anchor two windows are the same text if offset and print agree (the anchor adds 64 bits), so each further
agreeing offset extends the match by a word to the left or right; the union of the windows that start
earlier elsewhere is the maximal repeat to remove.

Hot passages: a task first settles what its own texts repeat among themselves and sends one row for
each anchor and slice of texts, not one for each document. Hot anchors (phrases shorter than a window that
many different windows contain) are found on a sample and sent window by window under keys of their own;
the sample decides only how rows are dealt, never what is found.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.llm import words as W
from pairtide.llm.tables import texts

_PRINT = 5  # bytes
_SEED = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class RepeatSpec:
    """``hot_share``: an anchor in more than this share of the sampled documents is dealt by window (at most
    anchors per document / hot_share of them exist)."""

    window: int = 20
    k: int = 8
    sample: float = 0.02
    hot_share: float = 0.01
    slice_bytes: int = 4 << 20


def _anchors(hashes: np.ndarray, at: np.ndarray, spec: RepeatSpec):
    """For every window: ``(start, anchor hash, anchor start)``; windows that cross texts are left out."""
    gram = W.grams(hashes, spec.k)
    wide = spec.window - spec.k + 1
    n = len(hashes) - spec.window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    low, where = gram[:n].copy(), np.zeros(n, dtype=np.int8)
    for j in range(1, wide):
        other = gram[j : j + n]
        less = other <= low
        low[less] = other[less]
        where[less] = j
    start = np.flatnonzero(at[:n] == at[spec.window - 1 :])
    return start, low[start], start + where[start]


def _occurrences(data, limits, spec: RepeatSpec):
    """Windows of a slice grouped by the anchor they chose."""
    at, hashes = W.words(data, limits)
    start, anchor, pos = _anchors(hashes, at, spec)
    whole = W.mix(W.grams(hashes, spec.window) ^ _SEED)[start] & np.uint64((1 << (8 * _PRINT)) - 1)
    first = np.ones(len(start), dtype=bool)
    if len(start):
        # windows of one anchor follow each other
        first[1:] = (pos[1:] != pos[:-1]) | (at[start[1:]] != at[start[:-1]]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(start)))
    return at, start, anchor, pos, whole, begin, size


def _earlier(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Whether an entry with the same keys comes earlier in ``order`` (equal places are not earlier)."""
    n = len(keys[0])
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    by = np.lexsort((*reversed(order), *reversed(keys)))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    out[by] = np.any([o[by] != o[by][head] for o in order], axis=0)
    return out


_ROW = "anchor long, doc_id long, place long, off int, size int, prints binary"


def _seeder(spec: RepeatSpec, hot: np.ndarray):
    """Rows ``(anchor, doc_id, place, off, size, prints)``; ``place`` is start << 32 | print of the text.
    Rows settled within the slice have no prints and a key of their own."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = W.text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            marks = batch.column(2).to_numpy().astype(np.int64)
            for a, b in W.slices(limits, spec.slice_bytes):
                at, start, anchor, pos, whole, begin, size = _occurrences(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], spec)
                if not len(start):
                    continue
                text = at[start] + a
                local = start - W.per_text(at, b - a)[at[start]]
                offset = pos - start
                known = _earlier([anchor, offset, whole], [ids[text], local, marks[text]])
                # rows: one for each anchor, but single windows where the anchor is hot
                single = np.isin(anchor, hot)
                row = np.zeros(len(start), dtype=bool)
                row[begin] = True
                row |= single
                begin = np.flatnonzero(row)
                size = np.diff(np.append(begin, len(start)))
                settled = np.logical_and.reduceat(known, begin)
                key = anchor[begin]
                key = np.where(single[begin], W.mix(key ^ W.mix(whole[begin] + offset[begin].astype(np.uint64))), key)
                place = (local[begin] << np.int64(32)) | marks[text[begin]]
                key = np.where(settled, W.mix(key ^ place.astype(np.uint64) ^ ids[text[begin]].astype(np.uint64)), key)
                prints = whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PRINT]
                kept = np.repeat(~settled, size)
                ends = np.concatenate(([0], np.cumsum(np.where(settled, 0, size)))) * _PRINT
                packed = pa.Array.from_buffers(
                    pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(prints[kept].tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), pa.array(ids[text[begin]]), pa.array(place),
                        pa.array(offset[begin].astype(np.int32)), pa.array(size.astype(np.int32)), packed,
                    ],
                    ["anchor", "doc_id", "place", "off", "size", "prints"],
                )

    return seed


def _extender(spec: RepeatSpec):
    """From rows sorted by anchor: ``(doc_id, mark, start, size)`` runs of windows that start earlier elsewhere."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        anchor, ids, place, off, size = (table.column(c).to_numpy() for c in ("anchor", "doc_id", "place", "off", "size"))
        blob = b"".join(x for x in table.column("prints").to_pylist())
        got = np.fromiter((len(x) for x in table.column("prints").to_pylist()), dtype=np.int64, count=len(size)) // _PRINT
        open_rows = np.flatnonzero(got)
        # a row that nothing else shares an anchor with repeats nothing
        shared = np.zeros(len(anchor), dtype=bool)
        same = anchor[1:] == anchor[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        wide = np.zeros((len(blob) // _PRINT, 8), dtype=np.uint8)
        wide[:, :_PRINT] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, _PRINT)
        whole = wide.view("<u8").reshape(-1)
        row = np.repeat(open_rows, got[open_rows])
        step = np.arange(len(row)) - np.repeat(np.cumsum(got[open_rows]) - got[open_rows], got[open_rows])
        use = shared[row]
        row, step, whole = row[use], step[use], whole[use]
        start, mark = (place[row] >> 32) + step, place[row] & 0xFFFFFFFF
        hit = _earlier([anchor[row], off[row] - step, whole], [ids[row], start, mark])
        row, start, mark = row[hit], start[hit], mark[hit]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(fresh)
        run = np.diff(np.append(begin, len(row)))
        done = np.flatnonzero(got == 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((ids[row[begin]], ids[done]))),
                pa.array(np.concatenate((mark[begin], place[done] & 0xFFFFFFFF))),
                pa.array(np.concatenate((start[begin], place[done] >> 32)).astype(np.int32)),
                pa.array(np.concatenate((run, size[done])).astype(np.int32)),
            ],
            ["doc_id", "mark", "start", "size"],
        )

    def extend(batches):
        held = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = table.column("anchor").to_numpy()
            last = np.flatnonzero(key != key[-1])
            if held and held[0].column("anchor")[0].as_py() != key[0]:
                yield settle(pa.concat_tables(held).combine_chunks())
                held = []
            if len(last):
                cut = int(last[-1]) + 1
                yield settle(pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks())
                held = [table.slice(cut)]
            else:
                held.append(table)
        if held:
            yield settle(pa.concat_tables(held).combine_chunks())

    return extend


def _hot_anchors(source: DataFrame, spec: RepeatSpec) -> np.ndarray:
    """Anchors in more than ``hot_share`` of the sampled documents; how many there can be does not grow with the data."""

    def seen(batches):
        for batch in batches:
            data, limits = W.text_bytes(batch.column(1))
            for a, b in W.slices(limits):
                at, start, anchor, *_ = _occurrences(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], spec)
                pairs = np.unique(np.stack((at[start].astype(np.uint64), anchor), axis=1), axis=0) if len(start) else np.zeros((0, 2), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64)), pa.array(np.zeros(len(pairs), dtype=np.int64))], ["anchor", "docs"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([b - a])], ["anchor", "docs"])

    drawn = source.sample(fraction=spec.sample, seed=1).select("doc_id", "text")
    counts = drawn.mapInArrow(seen, "anchor long, docs long").groupBy("anchor").agg(F.count("*").alias("n"), F.sum("docs").alias("docs")).cache()
    total = counts.where("anchor is null").agg(F.sum("docs")).first()[0] or 0
    least = max(8, int(total * spec.hot_share))
    hot = [r[0] for r in counts.where(F.col("anchor").isNotNull() & (F.col("n") > least)).select("anchor").collect()]
    counts.unpersist()
    return np.array(hot, dtype=np.int64).view(np.uint64)


def repeated_runs(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """``(doc_id, mark, start, size)``: runs of ``size`` windows, from word ``start`` on, that start earlier elsewhere.

    ``mark`` tells apart different texts under one id. Rows without an id take no part.
    """
    source = _marked(docs).where("doc_id is not null")
    seeds = source.mapInArrow(_seeder(spec, _hot_anchors(source, spec)), _ROW)
    return seeds.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_extender(spec), "doc_id long, mark long, start int, size int")


def _marked(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("mark", F.pmod(F.xxhash64("text"), F.lit(1 << 31)))


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text``.

    Each word is removed that a window covers whose word sequence also starts earlier (smaller id, or same
    document and earlier start), judged on the input. Words are runs without white space, unchanged.
    Null and empty texts have no words. Rows without an id keep all words and remove none elsewhere. Rows
    with equal id and text stand at the same place, so neither removes the other; rows with equal id and
    different texts are ordered by start, then by a hash of the text. Other columns are not read.
    """
    runs = repeated_runs(docs, spec)
    each = runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    joined = _marked(docs).join(each, ["doc_id", "mark"], "left").select("doc_id", "text", "runs")

    def cut(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                parts = (text.as_py() or "").encode().split()
                n_words.append(len(parts))
                if found.is_valid:
                    edge = np.zeros(len(parts) + 1, dtype=np.int32)
                    at, size = (found.values.field(c).to_numpy() for c in ("start", "size"))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + size + spec.window - 1, len(parts)), -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    parts = [parts[i] for i in stay.tolist()]
                n_removed.append(n_words[-1] - len(parts))
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
