"""Kendall's tau-b and distance correlation of long series in O(n log n) steps per level of a rank's bits.

Both need sums over pairs of rows that stand in the same order in two ways. ``earlier_smaller`` gives them for all rows at once:
two ranks differ first at one bit, so every pair of rows is met at exactly one bit level, where it is a prefix
sum within the rows that agree on the bits above. Memory stays in proportion to the rows, where a matrix of all
row pairs would not.
"""

import numpy as np


def earlier_smaller(rank: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row ``j`` the sum of ``weights[:, i]`` over ``i < j`` with ``rank[i] < rank[j]``; ``weights`` has one line per sum."""
    rank = np.asarray(rank, dtype=np.int64)
    out = np.zeros(weights.shape)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        group, upper = (rank >> (bit + 1))[order], ((rank >> bit) & 1)[order].astype(bool)
        lower = np.where(upper, 0.0, weights[:, order])
        run = np.cumsum(lower, axis=1) - lower
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        start = np.repeat(first, np.diff(np.r_[first, len(group)]))
        at = order[upper]
        out[:, at] += (run - run[:, start])[:, upper]
    return out


def _tied(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal in all columns."""
    order = np.lexsort(columns)
    same = np.ones(len(order) - 1, dtype=bool)
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    edges = np.flatnonzero(np.r_[True, ~same, True])
    size = np.diff(edges)
    return int((size * (size - 1) // 2).sum())


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b; NaN if a side is constant."""
    n = len(x)
    if n < 2:
        return np.nan
    order = np.lexsort((y, x))
    rank = np.unique(y[order], return_inverse=True)[1]
    # rows in order of x, ties by y: a later row with a smaller y is a pair in disorder
    falling = earlier_smaller(rank.max(initial=0) - rank, np.ones((1, n))).sum()
    total, tx, ty = n * (n - 1) // 2, _tied(x), _tied(y)
    scale = float(total - tx) * float(total - ty)
    return (total - tx - ty + _tied(x, y) - 2 * falling) / np.sqrt(scale) if scale else np.nan


def _gap_sums(v: np.ndarray) -> np.ndarray:
    """Sum of distances of each row to all others."""
    order = np.argsort(v, kind="stable")
    sorted_v, n = v[order], len(v)
    below = np.cumsum(sorted_v) - sorted_v
    at = np.arange(n)
    out = np.empty(n)
    out[order] = sorted_v * at - below + (sorted_v.sum() - below - sorted_v) - sorted_v * (n - 1 - at)
    return out


def _gap_products(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over all ordered row pairs of ``|x_i - x_j| * |y_i - y_j|``."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    rank = np.unique(y, return_inverse=True)[1]
    one = np.ones(len(x))
    near = earlier_smaller(rank, np.stack((one, x, y, x * y)))
    every = np.cumsum(np.stack((one, x, y, x * y)), axis=1) - np.stack((one, x, y, x * y))

    def signed(s):  # sum over earlier rows of (x_j - x_i) * (y_j - y_i)
        return x * y * s[0] - y * s[1] - x * s[2] + s[3]

    return 2.0 * float((2 * signed(near) - signed(every)).sum())


def distance(x: np.ndarray, y: np.ndarray) -> float:
    """Distance correlation; 0 if a side is constant."""
    x, y, n = x - x.mean(), y - y.mean(), float(len(x))
    a, b = _gap_sums(x), _gap_sums(y)

    def covariance(product, left, right):
        return product / n**2 - 2 * float(left @ right) / n**3 + float(left.sum()) * float(right.sum()) / n**4

    if x.max() == x.min() or y.max() == y.min():
        return 0.0
    scale = covariance(2 * n * float(x @ x), a, a) * covariance(2 * n * float(y @ y), b, b)
    return float(np.sqrt(max(covariance(_gap_products(x, y), a, b), 0.0) / np.sqrt(scale))) if scale > 0 else 0.0
