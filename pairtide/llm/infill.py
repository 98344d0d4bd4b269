"""Fill-in-the-middle: a text's units are parted into prefix, middle and suffix, and said in another order.

The units of a batch are one flat array: texts are split into a list array, the list is flattened beside the
number of its text, every unit gets its ordinal in its text, and a role (prefix, middle or suffix) by comparing the
ordinal with the two cuts of its text. Units of a role are filtered out, made lists again by their counts per text
and joined; all of it with ``pyarrow.compute`` over slices of bounded size. Cuts and forms are hashes of the id,
so a rerun, another partitioning or a lost executor changes nothing.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairtide.llm.words import slices, text_bytes


@dataclass(frozen=True)
class InfillSpec:
    """``rate``: per cent of texts that are cut, ``spm_rate``: per cent of these that name the suffix first.
    ``prefix``, ``suffix``, ``middle`` are the marks; a text that holds one of them stays plain."""

    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _units(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines with their line feeds, the text each belongs to, and the number of lines of every text."""
    parts = pc.split_pattern(text, "\n")
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    size = pc.list_value_length(parts).to_numpy()
    last = np.zeros(len(flat), dtype=bool)
    last[np.cumsum(size) - 1] = True
    # what stands behind the last line feed is a unit only if something stands there
    real = ~last | (pc.binary_length(flat).to_numpy() > 0)
    ends = pc.if_else(pa.array(last), pa.scalar("", flat.type), pa.scalar("\n", flat.type))
    units = pc.binary_join_element_wise(flat, ends, pa.scalar("", flat.type)).filter(pa.array(real))
    return units, parent[real], np.bincount(parent[real], minlength=len(text))


def _joined(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, texts: int) -> pa.Array:
    """The chosen units of every text, joined."""
    limits = np.zeros(texts + 1, dtype=np.int32)
    np.cumsum(np.bincount(parent[chosen], minlength=texts), out=limits[1:])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(limits), units.filter(pa.array(chosen))), pa.scalar("", units.type))


def cut(text: pa.Array, hashes: list[np.ndarray], spec: InfillSpec = InfillSpec()) -> pa.RecordBatch:
    """``(n, form, prefix_chars, middle_chars, output)`` of texts without nulls, from four numbers for each."""
    units, parent, n = _units(text)
    ordinal = np.arange(len(units)) - np.concatenate(([0], np.cumsum(n)))[parent]
    one, two = hashes[0] % (n + 1), hashes[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    role = (ordinal >= low[parent]).astype(np.int8) + (ordinal >= high[parent])
    prefix, middle, suffix = (_joined(units, parent, role == k, len(text)) for k in range(3))
    plain = (n == 0) | (hashes[2] % 100 >= spec.rate)
    for mark in spec.marks:
        plain |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
    spm = hashes[3] % 100 < spec.spm_rate
    p, s, m, none = (pa.scalar(mark, text.type) for mark in (*spec.marks, ""))
    in_psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    in_spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    is_plain, is_spm = pa.array(plain), pa.array(spm)
    chars = lambda part: pc.if_else(is_plain, pa.scalar(None, pa.int64()), pc.utf8_length(part).cast(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(n, pa.int64()),
            pc.if_else(is_plain, "plain", pc.if_else(is_spm, "spm", "psm")),
            chars(prefix),
            chars(middle),
            pc.if_else(is_plain, text, pc.if_else(is_spm, in_spm, in_psm)).cast(pa.string()),
        ],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def infill(docs: DataFrame, spec: InfillSpec = InfillSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row for each row of ``docs``.

    ``n`` lines; the prefix ends after the smaller of two hashed counts of lines, the middle after the larger. A null
    or empty text is plain with 0 lines. Repeated rows give repeated results; rows that share an id share the
    hashes, not the cuts. A null id hashes as an empty one. Other columns, whatever their names, are not read. A very
    long text is a slice of its own: memory is bounded by the longest text.
    """
    digest = F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        *(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)),
    )

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.large_string()).fill_null("")
            for a, b in slices(text_bytes(text)[1]):
                part = batch.slice(a, b - a)
                done = cut(text.slice(a, b - a), [part.column(k).to_numpy() for k in range(2, 6)], spec)
                yield pa.RecordBatch.from_arrays([part.column(0), *done.columns], ["doc_id", *done.schema.names])

    return rows.mapInArrow(cut_all, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, spec: InfillSpec = InfillSpec()) -> Column:
    """The text that an output of ``infill`` was made of. Marks stand in it once each unless it is plain."""
    mark = "|".join(rf"\Q{m}\E" for m in spec.marks)
    part = F.split(output, mark, -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
