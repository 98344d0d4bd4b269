"""Regular-expression matches with their places and surroundings, in column expressions only."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _starts(sizes: Column) -> Column:
    """Running sums before each entry; by chunks, so that thousands of entries stay cheap."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    chunks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int"))
    sums = lambda s: F.transform(chunks, lambda c: total(F.slice(s, c * _CHUNK + 1, _CHUNK)))
    before = lambda s, held: F.transform(
        F.sequence(F.lit(0), F.size(s) - 1),
        lambda i: F.get(held, F.floor(i / _CHUNK).cast("int")) + total(F.slice(s, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK)),
    )
    firsts = lambda held: F.transform(F.sequence(F.lit(0), F.size(held) - 1), lambda c: total(F.slice(held, 1, c)))
    return let(sums(sizes), lambda held: let(firsts(held), lambda first: before(sizes, first)))


def find(text: Column, pattern: str, kind: str, context: int = 24) -> Column:
    """Array of ``(kind, start, end, said, left, right)``: leftmost non-overlapping matches of a pattern, none of them empty.

    Places are code points, end exclusive; ``left`` and ``right`` are up to ``context`` characters beside the match
    as far as the neighbouring matches.
    """

    def built(found: Column) -> Column:
        gaps, said = found["gaps"], found["said"]
        sizes = F.transform(said, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(
            let(sizes, _starts),
            lambda before: F.transform(
                said,
                lambda m, i: F.struct(
                    F.lit(kind).alias("kind"),
                    (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
                    (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"),
                    m.alias("said"),
                    F.right(F.get(gaps, i), F.lit(context)).alias("left"),
                    F.substring(F.get(gaps, i + 1), 1, context).alias("right"),
                ),
            ),
        )

    shape = "array<struct<kind:string,start:int,end:int,said:string,left:string,right:string>>"
    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"))
    none = F.array().cast(shape)
    return F.when(text.rlike(pattern), let(pair, lambda p: F.when(F.size(p["said"]) > 0, built(p)).otherwise(none))).otherwise(none).cast(shape)
