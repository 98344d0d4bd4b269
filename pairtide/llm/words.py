"""Words and word hashes of many texts at once, in numpy.

Texts of an Arrow batch lie in one byte buffer. Word limits come from a byte table, word hashes from
differences of a running polynomial, so no Python object is made per word.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK = 1 << 20
SLICE = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(separators, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(is_separator, value)`` for each byte; ``lower`` maps A-Z to a-z."""
    apart = np.zeros(256, dtype=bool)
    apart[list(separators)] = True
    value = np.arange(256, dtype=np.uint64)
    if lower:
        value[65:91] += np.uint64(32)
    return apart, value + np.uint64(1)


WORD = byte_table(SPACE, lower=False)
LOWER_WORD = byte_table(SPACE, lower=True)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the ``n + 1`` limits of its texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    limits = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    first = limits[0] if len(limits) else 0
    return data[first : limits[-1] if len(limits) else 0], limits - first


def slices(limits: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``size`` bytes each; a longer text has a range of its own."""
    start, n = 0, len(limits) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(limits, limits[start] + size, "right")) - 1)
        yield start, min(end, n)
        start = end


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, limits: np.ndarray, table=WORD) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hash)`` of every word of the texts, in order.

    The buffer is worked through in blocks cut between words, so the temporary arrays stay small
    however long a text is.
    """
    apart, value = table
    found_at, found_hash = [], []
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + BLOCK)
        while end < n:
            # the cut goes behind the last separator, or where a text begins
            back = np.flatnonzero(apart[data[begin:end]])
            text = limits[np.searchsorted(limits, end, "right") - 1]
            cut = max(begin + back[-1] + 1 if len(back) else begin, text)
            if cut > begin:
                end = cut
                break
            end = min(n, end + BLOCK)
        block = data[begin:end]
        inside = ~apart[block]
        edges = np.zeros(len(block) + 1, dtype=bool)
        cuts = limits[(limits > begin) & (limits < end)] - begin
        edges[cuts] = True
        before = np.concatenate(([False], inside[:-1]))
        starts = np.flatnonzero(inside & (~before | edges[:-1]))
        after = np.concatenate((inside[1:], [False]))
        ends = np.flatnonzero(inside & (~after | edges[1:])) + 1
        power, inverse = _powers(len(block) + 1)
        run = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(value[block] * power[: len(block)], out=run[1:])
        found_hash.append(mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        found_at.append(np.searchsorted(limits, starts + begin, "right") - 1)
        begin = end
    if not found_at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(found_at), np.concatenate(found_hash)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; the caller drops those that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += hashes[j : j + n]
    return mix(out)


def per_text(at: np.ndarray, n: int) -> np.ndarray:
    """``n + 1`` limits of the words of each text."""
    return np.searchsorted(at, np.arange(n + 1))
