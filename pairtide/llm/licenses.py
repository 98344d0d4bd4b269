"""License notices by diagonal voting.

All word k-grams of all texts are joined with the k-gram positions of the notices. A hit at word ``i`` of a
text and word ``j`` of a notice votes for the diagonal ``i - j``; a notice that stands in a text unchanged has all its
votes on one diagonal, one with a word more or less has them on neighbouring ones, which are merged. A span
is kept if the votes cover enough of the notice and lie no wider than it. Where spans of the method's notices overlap, the one with the
most votes stands (a license's name is often part of another's).

The positions come from fixed lists (``notices``), so the table that is broadcast does not grow with the data.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairtide.llm import words as W
from pairtide.llm.notices import IDENTIFIERS, NAMES, TEXTS
from pairtide.llm.tables import texts
from pairtide.session import stage

#: Words are runs of letters, digits and everything above ASCII, lower-cased A-Z.
TERM = W.byte_table([b for b in range(128) if not chr(b).isalnum()], lower=True)


@dataclass(frozen=True)
class Notice:
    """``exact``: every word in its place; else ``share`` of the k-grams, in a span some words wider at most."""

    label: str
    text: str
    k: int = 3
    exact: bool = False
    share: float = 0.7


#: The phrases and labels of the base.
BASE = (
    Notice("cc-by", "cc by", 2, True),
    Notice("gpl", "general public license", 2, True),
    Notice("reserved", "all rights reserved", 2, True),
)

#: Notices of the method: full texts, names, and identifiers with every word in its place.
NOTICES = (
    *(Notice(label, text, share=share) for label, text, share in TEXTS),
    *(Notice(label, name, share=1.0) for label, name in NAMES),
    *(Notice(label, f"spdx license identifier {name}", share=1.0) for name, label in IDENTIFIERS.items()),
)


@dataclass(frozen=True)
class LicenseSpec:
    slack: int = 2
    notices: tuple[Notice, ...] = BASE + NOTICES


def _hashes(text: str) -> np.ndarray:
    data, limits = W.text_bytes(pa.array([text]))
    return W.words(data, limits, TERM)[1]


def _positions(spec: LicenseSpec) -> list[tuple[int, int, int]]:
    """``(gram, notice, position)`` of every k-gram of the notices."""
    rows = []
    for number, notice in enumerate(spec.notices):
        grams = W.grams(_hashes(notice.text), notice.k) ^ np.uint64(notice.k)
        rows += [(int(g), number, at) for at, g in enumerate(grams.view(np.int64))]
    return rows


def _grams(ks: list[int]):
    """Rows ``(row, at, gram, doc_id)``: every k-gram, and for each text one row with ``at = -1 - words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, limits = W.text_bytes(batch.column(1))
            for a, b in W.slices(limits):
                at, hashes = W.words(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], TERM)
                ends = W.per_text(at, b - a)
                nobody = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(b - a)), pa.array((-1 - np.diff(ends)).astype(np.int32)), nobody(b - a), batch.column(0).slice(a, b - a)],
                    ["row", "at", "gram", "doc_id"],
                )
                place = (np.arange(len(at)) - ends[at]).astype(np.int32)
                for k in ks:
                    gram = W.grams(hashes, k) ^ np.uint64(k)
                    whole = np.flatnonzero(at[: len(gram)] == at[k - 1 :]) if len(gram) else np.zeros(0, dtype=int)
                    for c in range(0, len(whole), 1 << 16):
                        w = whole[c : c + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(row + at[w]), pa.array(place[w]), pa.array(gram[w].view(np.int64)), nobody(len(w))], ["row", "at", "gram", "doc_id"])
                row += b - a

    return run


def license_spans(docs: DataFrame, spec: LicenseSpec = LicenseSpec()) -> DataFrame:
    """``(row, doc_id, n_words, notice, start, end, share)``: verified spans in words, end exclusive, and one
    row without a notice for every row of ``docs``. ``row`` numbers the rows of ``docs``."""
    spark = docs.sparkSession
    positions = spark.createDataFrame(_positions(spec), "gram long, notice int, pos int")
    facts = spark.createDataFrame(
        [(i, len(_hashes(n.text)), n.k, n.exact, n.share) for i, n in enumerate(spec.notices)], "notice int, size int, k int, exact boolean, least double"
    )
    grams = texts(docs).mapInArrow(_grams(sorted({n.k for n in spec.notices})), "row long, at int, gram long, doc_id long")
    hits = grams.join(F.broadcast(positions), "gram", "left").where("notice is not null or at < 0")
    votes = hits.groupBy("row", "notice", (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("doc_id").alias("doc_id")
    )
    known = votes.join(F.broadcast(facts), "notice", "left")
    line = Window.partitionBy("row", "notice").orderBy("diagonal")
    apart = F.when(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(line) > 1), 1).otherwise(F.when(F.lag("diagonal").over(line).isNull(), 1).otherwise(0))
    merged = (
        known.withColumn("apart", apart)
        .withColumn("group", F.sum("apart").over(line))
        .groupBy("row", "notice", "group")
        .agg(F.sum("votes").alias("votes"), F.min("low").alias("start"), F.max("high").alias("last"), F.first("size").alias("size"), F.first("k").alias("k"), F.first("exact").alias("exact"), F.first("least").alias("least"), F.max("doc_id").alias("doc_id"))
    )
    need = F.col("size") - F.col("k") + 1
    share = F.when(F.col("notice").isNotNull(), F.least(F.lit(1.0), F.col("votes") / need))
    end = F.col("last") + F.col("k")
    stands = F.when(F.col("exact"), F.col("votes") == need).otherwise((share >= F.col("least")) & (end - F.col("start") <= F.col("size") + spec.slack))
    words = F.when(F.col("notice").isNull(), -1 - F.col("start"))
    kept = merged.where(F.col("notice").isNull() | stands).select(
        "row", "doc_id", words.cast("long").alias("n_words"), "notice", F.when(F.col("notice").isNotNull(), F.col("start")).cast("long").alias("start"), end.cast("long").alias("end"), share.alias("share"),
        "votes", F.coalesce("exact", F.lit(True)).alias("sure"),
    )
    return _without_rivals(stage(kept, "license_spans"), max(len(_hashes(n.text)) for n in spec.notices) + spec.slack)


def _without_rivals(spans: DataFrame, widest: int) -> DataFrame:
    """Spans without those that overlap one of more votes; ``sure`` ones are neither rivals nor have any.

    Spans meet by stretches of the widest span's length, so a text with very many notices is compared stretch by stretch.
    """
    rank = F.struct("votes", "share", (-F.col("notice")).alias("turn")).alias("rank")
    stretches = F.explode(F.sequence(F.floor(F.col("start") / widest), F.floor((F.col("end") - 1) / widest))).alias("stretch")
    open_ = spans.where("not sure").select("row", "notice", "start", "end", rank, stretches)
    other = open_.select("row", "stretch", F.col("start").alias("a"), F.col("end").alias("b"), F.col("rank").alias("other"))
    lost = open_.join(other, ["row", "stretch"]).where((F.col("a") < F.col("end")) & (F.col("b") > F.col("start")) & (F.col("other") > F.col("rank")))
    lost = lost.select("row", "notice", "start").distinct()
    return spans.join(lost, ["row", "notice", "start"], "left_anti").select("row", "doc_id", "n_words", "notice", "start", "end", "share")


def license_scan(docs: DataFrame, spec: LicenseSpec = LicenseSpec()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Base: places where the words of an exact notice stand consecutively. ``labels`` adds the notices found by
    voting. ``score`` is the largest share of a notice's k-grams (1 where a base phrase stands, 0 without any).
    Null and empty texts have no words; repeated rows give repeated rows; other columns are not read.
    """
    spans = license_spans(docs, spec)
    of = lambda values: F.when(F.col("notice").isNotNull(), F.get(F.array(*map(F.lit, values)), F.col("notice")))
    label = of([n.label for n in spec.notices])
    exact = F.coalesce(of([n.exact for n in spec.notices]), F.lit(False))
    joined = lambda what: F.array_join(F.sort_array(F.collect_set(what)), ",")
    return (
        spans.withColumn("label", label)
        .withColumn("exact", exact)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.sum(F.col("exact").cast("long")).alias("n_base"),
            F.min(F.when(F.col("exact"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
            joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
