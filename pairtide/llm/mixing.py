"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, document after document, are one stream that is cut into blocks of a fixed length. A
source's target fixes how many slots of the mix it fills. Output shards have a fixed number of slots and draw how many
of them each source gets; a source numbers its slots across the shards, and slot ``t`` of a source with ``k`` blocks
takes the block at place ``t mod k`` of the source's permutation of pass ``t div k``. Blocks and slots meet by
source and index, so what a join moves is one small row per block; texts are never moved.

Nothing depends on partitioning: positions come from the documents' own values, draws and permutations from hashes.

Draws. A shard's expected count of a source is split: the whole part is given, the rest is a multinomial draw over the
fractional parts. This has the expectation of a plain multinomial with much less noise. The last shard takes what the draws
of the others left of each source's total, so that totals are exact and no block is met more than ``passes`` times.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.session import stage

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
_STEP = 4096


@dataclass(frozen=True)
class MixSpec:
    """Sources in order of name, null last, weigh ``weights``, repeating, and share ``share`` of all words; none gives more than
    ``passes`` times its size. ``block``: words of a block; ``shard``: blocks of an output shard; ``rounds`` of a
    permutation; ``bucket``: documents whose words are counted up in one task; ``task``: slots worked out in one."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.0
    passes: int = 3
    block: int = 64
    shard: int = 1024
    rounds: int = 24
    bucket: int = 4096
    task: int = 100_000
    seed: int = 11


@dataclass(frozen=True)
class Mix:
    """``docs``: a row per document with its place in its source's stream; ``sources``: sizes, weights and targets;
    ``slots``: what each slot of each shard takes; ``spans``: the same as parts of documents."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    spans: DataFrame


def word_count(text: Column) -> Column:
    """Words between white space, without an array of them: each word with what follows it becomes one letter."""
    return F.length(F.ltrim(F.regexp_replace(F.coalesce(text, F.lit("")), _WORD, "x"), F.lit(_SPACE))).cast("long")


def numbers(frame: DataFrame, first: Column, last: Column, name: str, spread: bool = False) -> DataFrame:
    """A row for each number from ``first`` to ``last`` (not below ``first``), in two steps, so that no array grows long;
    ``spread`` deals the steps over tasks, for a few rows with very many numbers."""
    steps = frame.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long"))
    steps = steps.withColumn("_from", F.explode(F.sequence("_first", "_last", F.lit(_STEP).cast("long"))))
    if spread:
        steps = steps.repartition("_from")
    return steps.withColumn(name, F.explode(F.sequence("_from", F.least("_last", F.col("_from") + _STEP - 1)))).drop("_first", "_last", "_from")


def ranked(frame: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``at``, the number of each row in an order of all rows: rows are dealt by range and counted by part."""
    parts = stage(frame.orderBy(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_ahead", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(ahead, "_part").withColumn("at", (F.col("_ahead") + F.col("_own") - 1).cast("long")).drop("_part", "_own", "_ahead")


def running(frame: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys with a smaller ``at``: within steps of it, then over steps."""
    steps = frame.withColumn("_step", F.floor(F.col(at) / _STEP))
    sums = steps.groupBy(*keys, "_step").agg(F.sum(value).alias("_sum"))
    over = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(over(keys or [F.lit(0)], "_step")), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(over([*keys, "_step"], at)), F.lit(0))
    return steps.withColumn("_inside", inside).join(ahead, [*keys, "_step"]).withColumn(name, (F.col("_inside") + F.col("_ahead")).cast("long")).drop("_step", "_inside", "_ahead")


def permuted(at: Column, n: Column, key: Column, rounds: int) -> Column:
    """Where a keyed permutation of ``0 .. n - 1`` puts ``at``: in each round a number and its mirror at a drawn
    point swap places or not, as a hash of the larger of the two says."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), at.cast("long"), turn)


def _targets(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """Adds ``target``: weight times a common level, or ``passes`` times the size where that is less.

    The level rises until the targets add up; each step is one small aggregation over the sources.
    """
    cap, weight = F.col("source_size") * float(spec.passes), F.col("weight")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * spec.share
    level, stopped = 0.0, -1
    while total:
        over = weight * level > cap
        full, free, now = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, weight)), F.count_if(over)).first()
        if now == stopped or not free:
            break
        level, stopped = (total - (full or 0.0)) / free, now
    return sources.withColumn("target", F.least(weight * level, cap) if level else cap * 0.0)


def _streams(docs: DataFrame, spec: MixSpec, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the place of their first word in their source's stream, and the sources with their targets."""
    read = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col)).alias("size"))
    same = stage(read.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")), "sizes")
    sums = same.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"))
    weights = F.array(*(F.lit(float(w)) for w in spec.weights))
    placed = ranked(sums, [F.col("source").isNull(), F.col("source")], "sources").withColumnRenamed("at", "src")
    sources = stage(_targets(stage(placed.withColumn("weight", F.element_at(weights, (F.col("src") % len(spec.weights) + 1).cast("int"))), "weights"), spec), "targets")
    each = numbers(same, F.lit(1), F.col("copies"), "copy").alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    bucket = F.pmod(F.xxhash64(F.lit(spec.seed), "doc_id", "size", "copy"), F.ceil(F.col("rows") / spec.bucket)).alias("bucket")
    each = stage(each.select("src", "s.source", "doc_id", "copy", "size", "source_size", "target", bucket), "documents")
    line = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    ahead = running(each.groupBy("src", "bucket").agg(F.sum("size").alias("held")), ["src"], "bucket", "held", "ahead").drop("held")
    first = (F.coalesce(F.sum("size").over(line), F.lit(0)) + F.col("ahead")).cast("long")
    return stage(each.join(ahead, ["src", "bucket"]).withColumn("first", first).drop("bucket", "ahead"), "streams"), sources


def _draws(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """``(src, blocks, shard, start, n)``: shard takes the slots ``start`` to ``start + n - 1`` of the source.

    Joins of rows that were multiplied before are merge joins by hint: their size is not what a plan's estimate says,
    so it must not decide for a broadcast.
    """
    blocks = F.ceil(F.col("source_size") / spec.block)
    sized = stage(
        sources.where("source_size > 0").select("src", blocks.alias("blocks"), F.round(blocks * F.col("target") / F.col("source_size")).cast("long").alias("slots")),
        "slots",
    )
    total = sized.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // spec.shard))
    share = F.col("slots") * spec.shard
    whole, part = F.floor(share / max(total, 1)), F.pmod(share, F.lit(max(total, 1)))
    sized = stage(running(sized.withColumn("whole", (share - part) / max(total, 1)).withColumn("part", part), [], "src", "part", "low").withColumn("whole", F.col("whole").cast("long")), "shares")
    left = spec.shard - (sized.agg(F.sum("whole")).first()[0] or 0)
    given = numbers(sized.where("whole > 0"), F.lit(0), F.lit(shards - 2), "shard", spread=True).select("src", "blocks", "slots", "shard", F.col("whole").alias("n")) if shards > 1 else None
    drawn = sized.select("src", "blocks", "slots", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("n")).where("false") if given is None else given
    if shards > 1 and left > 0:
        # a draw finds its source through equal cells of the fractional parts' range: about two sources a cell
        width = max(1, -(-left * total // sized.count()))
        cells = numbers(sized.where("part > 0"), F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("part") - 1) / width), "cell")
        spark = sources.sparkSession
        hits = numbers(spark.range(shards - 1).select(F.col("id").alias("shard")), F.lit(1), F.lit(left), "draw")
        hits = hits.withColumn("u", F.pmod(F.xxhash64(F.lit(spec.seed), "shard", "draw"), F.lit(left * total))).withColumn("cell", F.floor(F.col("u") / width))
        met = hits.hint("merge").join(cells, "cell").where("u >= low AND u < low + part")
        drawn = drawn.unionByName(met.groupBy("src", "blocks", "slots", "shard").agg(F.count("*").alias("n")))
    drawn = stage(drawn.groupBy("src", "blocks", "slots", "shard").agg(F.sum("n").alias("n")), "draws")
    placed = running(drawn, ["src"], "shard", "n", "start")
    taken = placed.select("src", "blocks", "shard", "start", F.least("n", F.col("slots") - F.col("start")).alias("n"))
    sums = drawn.groupBy("src").agg(F.sum("n").alias("start"))
    rest = sized.join(sums, "src", "left").withColumn("start", F.coalesce("start", F.lit(0)))
    last = rest.select("src", "blocks", F.lit(shards - 1).cast("long").alias("shard"), "start", (F.col("slots") - F.col("start")).alias("n"))
    return taken.unionByName(last).where("n > 0").repartition(max(1, -(-total // spec.task)), "src", "shard")


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of a table of documents.

    Null and empty texts, and texts of white space, have size 0 and are in no span. A null source is a source of its own, the last in
    order. Repeated rows are documents of their own (``copy`` tells them apart), rows that share an id as well; a null id is one
    like others. A source without words gets nothing, an empty table gives empty tables. Other columns, whatever
    their names, are not read. A document is a third of a source at worst in any number of blocks: only rows of one block
    meet in a group.

    ``spans``: ``(shard, place, src, copy_no, doc_id, first, start, length)``, the words ``start`` to ``start + length - 1`` of the
    document whose first word stands at ``first`` in the stream of source ``src``; ``place`` is the slot's order in its shard,
    ``copy_no`` the pass.
    """
    rows, sources = _streams(docs, spec, id_col, text_col, source_col)
    draws = numbers(_draws(sources, spec), F.col("start"), F.col("start") + F.col("n") - 1, "slot")
    turn = F.floor(F.col("slot") / F.col("blocks"))
    key = F.xxhash64(F.lit(spec.seed), "src", "copy_no")
    slots = draws.withColumn("copy_no", turn).withColumn("block", permuted(F.pmod("slot", "blocks"), F.col("blocks"), key, spec.rounds))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(spec.seed + 1), "src", "slot"), "src", "slot")
    slots = slots.select("shard", "src", "slot", "copy_no", "block").withColumn("place", F.row_number().over(order))
    length = F.lit(spec.block).cast("long")
    parts = numbers(rows.where("size > 0"), F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("size") - 1) / length), "block")
    low, high = F.greatest("first", F.col("block") * length), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * length)
    parts = parts.select("src", "block", "doc_id", "first", (low - F.col("first")).alias("start"), (high - low).alias("length"))
    spans = slots.hint("merge").join(parts, ["src", "block"]).select("shard", "place", "src", "copy_no", "doc_id", "first", "start", "length")
    return Mix(rows, sources, slots, spans)


def taken(mixed: Mix) -> DataFrame:
    """The mix's documents with the words that it takes of each, repeats counted."""
    sums = mixed.spans.groupBy("src", "first").agg(F.sum("length").alias("words"))
    # documents without words share their place with the next one
    rows = mixed.docs.withColumn("at", F.when(F.col("size") > 0, F.col("first")))
    return rows.join(sums.withColumnRenamed("first", "at"), ["src", "at"], "left").withColumn("taken", F.coalesce("words", F.lit(0))).drop("at", "words")
