"""Best-fit packing with large-item matching.

Texts become token ids in tasks; only piece lengths take part in packing. There are at most ``capacity``
different lengths, so the packing itself is worked out on counts per length (a table of that many rows,
whatever the number of documents): pieces longer than a third of the capacity meet at most twice in a
sequence, so they are matched greedily, each with the longest partner that fits; shorter ones then go,
longest first, to the tightest gap that holds them. The result is a list of runs: "the pieces number r to
r + n of length L stand at this offset of sequences b to b + n". Every piece gets its number among the
pieces of its length by counting within ids' buckets, and finds its run by binary search.
"""

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairtide.llm.tables import texts
from pairtide.session import stage


@dataclass(frozen=True)
class PackSpec:
    """``end_id`` closes every document. ``buckets``: parts that number the pieces of one length in parallel, more where they would
    hold over ``bucket_rows`` pieces each: all pieces of long documents but their first are of full length."""

    capacity: int = 2048
    vocabulary: str = "byte_bpe_50k.json"
    end_id: int = 0
    buckets: int = 64
    bucket_rows: int = 8192


def contract_encoder(vocabulary: str):
    """A function from a text to the ids of ``tokenizers`` with its default settings, where a special token's string in a text is
    that token. Only texts that hold such a string go through ``tokenizers`` itself; it is loaded when the first one is met."""
    import json

    import public_tokenizers

    path, ordinary, whole = public_tokenizers.path(vocabulary), encoder(vocabulary), []
    with open(path, encoding="utf-8") as file:
        special = [token["content"] for token in json.load(file).get("added_tokens", [])]

    def encode(text: str):
        if not any(token in text for token in special):
            return ordinary(text)
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(path))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


def encoder(vocabulary: str):
    """A function from a text to its ids under a vocabulary of the public tokenizers; special tokens' strings are ordinary text.

    Where the vocabulary comes with a rank file (the same merges), that is used: it gives the ids that
    ``tokenizers`` gives, which the tests hold it to, in a third of the time.
    """
    import base64
    import os

    import public_tokenizers

    ranks = public_tokenizers.path(vocabulary.replace(".json", ".tiktoken"))
    if os.path.exists(ranks):
        import tiktoken

        with open(ranks, "rb") as file:
            merges = {base64.b64decode(part): int(rank) for part, rank in map(bytes.split, file)}
        return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, spec: PackSpec = PackSpec()) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: the token ids of every document, closed by ``end_id`` and cut
    into pieces of ``capacity`` (the first may be shorter) if longer; ``ids`` is little-endian unsigned 32-bit.

    Null and empty texts are the closing id alone. Rows with a null id and repeated rows are pieces too.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = contract_encoder(spec.vocabulary)
        for batch in batches:
            rows, held = [], 0

            def out():
                ids, piece, start, length, data = zip(*rows)
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), spec.end_id], dtype="<u4")
                limits = [0, *range(len(ids) % spec.capacity or spec.capacity, len(ids) + 1, spec.capacity)]
                for k, (a, b) in enumerate(zip(limits, limits[1:])):
                    rows.append((doc, k, a, b - a, ids[a:b].tobytes()))
                    held += 4 * (b - a)
                if held > 4 << 20:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first number, pieces, first sequence, offset)`` from counts per length.

    Groups of equal sequences are split at most twice for each length, so the list stays within a few times
    ``capacity`` entries for the matching and the square of it at the very worst for the gaps.
    """
    left = {size: n for size, n in counts.items() if n}
    taken = dict.fromkeys(left, 0)
    runs, base = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)

    def put(size: int, n: int, first: int, offset: int) -> None:
        runs.append((size, taken[size], n, first, offset))
        taken[size] += n
        left[size] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    # lengths over a third of the capacity: two of them at most share a sequence
    for size in sorted((s for s in left if 3 * s > capacity), reverse=True):
        while left[size]:
            fits = [s for s in left if 3 * s > capacity and s <= min(size, capacity - size) and left[s]]
            mate = max(fits, default=0)
            if mate == size:
                n = left[size] // 2
                if not n:
                    mate = max((s for s in fits if s < size), default=0)
            if not mate:
                n = left[size]
            elif mate != size:
                n = min(left[size], left[mate])
            put(size, n, base, 0)
            if mate:
                put(mate, n, base, size)
            leave(capacity - size - mate, base, n)
            base += n
    # the rest, longest first, each into the tightest gap
    open_gaps = sorted(gaps)
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            k = bisect.bisect_left(open_gaps, size)
            if k == len(open_gaps):
                fresh = -(-left[size] // (capacity // size))
                gaps.setdefault(capacity, []).append((base, fresh))
                bisect.insort(open_gaps, capacity)
                base += fresh
                continue
            gap = open_gaps[k]
            first, n = gaps[gap].pop()
            each = gap // size
            full = min(n, left[size] // each)
            rest = left[size] - full * each if full < n else 0  # what one more sequence takes, not full
            parts = [(first, full, each), (first + full, 1 if rest else 0, rest)]
            used = sum(m for _, m, _ in parts)
            for at, m, fill in parts:
                if m:
                    for j in range(fill):
                        put(size, m, at, capacity - gap + j * size)
                    shrunk = gap - fill * size
                    leave(shrunk, at, m)
                    if shrunk and shrunk not in open_gaps:
                        bisect.insort(open_gaps, shrunk)
            if used < n:
                gaps[gap].append((first + used, n - used))
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.remove(gap)
    return runs


def pack(lengths: DataFrame, spec: PackSpec = PackSpec()) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece`` and ``length`` (1 to capacity).

    Equal rows are told apart by their count, so repeated pieces get places of their own.
    """
    rows = stage(lengths, "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    many = {length: -(-n // spec.bucket_rows) for length, n in counts.items() if n > spec.buckets * spec.bucket_rows}
    parts = F.lit(spec.buckets)
    if many:
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in many.items() for v in kv]), F.col("length")), parts)
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), parts))
    sizes = spread.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")
    runs = sorted(plan_runs(counts, spec.capacity))
    length, number, _, first, offset = (np.array(c, dtype=np.int64) for c in zip(*runs)) if runs else [np.zeros(0, dtype=np.int64)] * 5
    low = (length << 44) + number

    def place(batches):
        for batch in batches:
            own, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            run = np.searchsorted(low, (own << 44) + rank, "right") - 1
            keep = [i for i, c in enumerate(batch.schema.names) if c != "_rank"]
            added = [pa.array(first[run] + rank - number[run]), pa.array(offset[run])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *added], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    numbered = (
        spread.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")))
        .join(sizes.withColumn("_before", before).drop("n"), ["length", "_bucket"])
        .select(*lengths.columns, (F.col("_before") + F.col("_own") - 1).alias("_rank"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lengths.schema.fields)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)``: the packed sequences themselves, from rows that still carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate("parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", ids.alias("ids"))
