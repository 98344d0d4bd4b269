"""Pair measures as Column expressions over two aligned return arrays.

The tile plan covers the built-in measures; these are the building blocks for measures of
one's own, which run in the JVM without Python workers.
"""

from typing import Callable, Tuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairtide.functions.kernels import TIE

Correlation = Callable[[Column, Column], Column]


def aligned(x: Column, y: Column, lag: int) -> Tuple[Column, Column]:
    """x earlier than y by ``lag`` rows; a negative lag turns the roles around."""
    rows = F.size(x) - abs(lag)
    head, tail = (lambda a: F.slice(a, F.lit(1), F.greatest(rows, F.lit(0)))), (lambda a: F.slice(a, F.lit(abs(lag) + 1), F.greatest(rows, F.lit(0))))
    return (head(x), tail(y)) if lag >= 0 else (tail(x), head(y))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; lambda bodies do not share subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def centred(values: Column) -> Column:
    """Values minus their mean."""
    return bind(values, lambda a: bind(F.try_divide(total(a), F.size(a)), lambda mean: F.transform(a, lambda v: v - mean)))


def inner(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def constant(values: Column) -> Column:
    return F.array_max(values) == F.array_min(values)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two arrays; 0 for a constant one, NULL for empty ones."""

    def scaled(cx: Column, cy: Column) -> Column:
        return F.try_divide(inner(cx, cy), F.sqrt(inner(cx, cx) * inner(cy, cy)))

    def of_values(a: Column, b: Column) -> Column:
        correlation = bind(centred(a), lambda ca: bind(centred(b), lambda cb: scaled(ca, cb)))
        return F.when(constant(a) | constant(b), F.lit(0.0)).otherwise(correlation)

    return bind(x, lambda a: bind(y, lambda b: of_values(a, b)))


def squared_pearson(x: Column, y: Column) -> Column:
    return pearson(F.transform(x, lambda v: v * v), F.transform(y, lambda v: v * v))


def average_ranks(values: Column) -> Column:
    """Ranks from 1, ties sharing their mean rank."""

    def rank(all_values: Column, v: Column) -> Column:
        below = F.size(F.filter(all_values, lambda u: u < v))
        return below + (F.size(F.filter(all_values, lambda u: u == v)) + 1) / F.lit(2.0)

    return bind(values, lambda a: F.transform(a, lambda v: rank(a, v)))


def spearman(x: Column, y: Column) -> Column:
    """Rank correlation; NULL for a constant array."""
    return bind(x, lambda a: bind(y, lambda b: F.when(~(constant(a) | constant(b)), pearson(average_ranks(a), average_ranks(b)))))


def correlation_at(x: Column, y: Column, lag: int, correlation: Correlation = pearson) -> Column:
    early, late = aligned(x, y, lag)
    return F.when(F.size(x) > abs(lag), correlation(early, late))


def ccf_at_lag(x: Column, y: Column, lag: int = 1, correlation: Correlation = pearson) -> Column:
    """How much more x leads y than y leads x at one lag; 0 where undefined."""
    return F.coalesce(correlation_at(x, y, lag, correlation) - correlation_at(y, x, lag, correlation), F.lit(0.0))


def ccf_auc(x: Column, y: Column, max_lag: int, correlation: Correlation = pearson) -> Column:
    """Signed share of the larger side of the cross-correlation function."""
    lags = range(1, max_lag + 1)
    ahead = sum((F.abs(correlation_at(x, y, k, correlation)) for k in lags), F.lit(0.0))
    behind = sum((F.abs(correlation_at(x, y, -k, correlation)) for k in lags), F.lit(0.0))
    return F.coalesce(_lead(ahead, behind) * F.try_divide(F.greatest(ahead, behind), ahead + behind), F.lit(0.0))


def ccf_at_max_lag(x: Column, y: Column, max_lag: int, correlation: Correlation = pearson) -> Column:
    """Largest absolute correlation, positive if it lies on the side where x leads."""
    lags = range(1, max_lag + 1)
    ahead = F.array(*[F.abs(correlation_at(x, y, k, correlation)) for k in lags])
    behind = F.array(*[F.abs(correlation_at(x, y, -k, correlation)) for k in lags])
    defined = ~F.exists(ahead, lambda v: v.isNull()) & ~F.exists(behind, lambda v: v.isNull())
    a, b = F.array_max(ahead), F.array_max(behind)
    return F.when(defined, _lead(a, b) * F.greatest(a, b)).otherwise(F.lit(0.0))


def _lead(ahead: Column, behind: Column) -> Column:
    """Sign of the difference; sides equal up to rounding tie."""
    gap = ahead - behind
    return F.when(F.abs(gap) <= TIE, F.lit(0.0)).otherwise(F.signum(gap))


def signed_area(x: Column, y: Column, levy: bool = False) -> Column:
    """Antisymmetric level-2 area of the path (x, y)."""

    def steps(a: Column) -> Column:
        rest = F.size(a) - 1
        return F.zip_with(F.slice(a, F.lit(2), rest), F.slice(a, F.lit(1), rest), lambda now, then: now - then)

    def path(a: Column) -> Column:
        return bind(F.get(a, F.lit(0)), lambda start: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda v: v - start))

    area = inner(path(x), steps(y)) - inner(path(y), steps(x))
    return area / 2 if levy else area


def text_hash(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts as text, joined by ``|``: a hash that other engines can repeat."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")
