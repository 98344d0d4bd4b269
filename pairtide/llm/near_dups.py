"""Near-duplicate documents: MinHash bands propose, signatures prune, full shingle sets decide.

Sequential Bayesian verification. Documents with equal shingle sets form a class and only classes are
compared. A signature has ``hashes`` minima; the first ``bands * rows`` of them, cut into bands, propose
candidates. A proposed pair is compared ``step`` minima at a time and dropped as soon as, given the
matches so far and a flat prior, the chance that its similarity reaches the threshold is below ``miss``.
What is left is decided on the two full shingle sets.

Large groups stay linear. In each of some rounds every class is compared with a few members of other components
(members drawn from each bucket, of the buckets shared most often), which leaves few outside their group's component. Between the
rounds labels take few steps: equal labels are one component for certain, and a component under several labels only costs
comparisons. Only the last labels are worked out to the end. Then the
buckets that still hold several components are worked through in blocks of ``block`` members: only members of
different components are compared, and what survives is handed on as one list for each member and block of
partners, to be decided where the block's texts are. No candidate is capped: every pair of a bucket is either in one
component already or compared.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.llm import words as W
from pairtide.llm.tables import fresh, texts
from pairtide.session import stage


@dataclass(frozen=True)
class NearDupSpec:
    """``percent``: linked if 100 * intersection >= percent * union. ``miss``: chance to drop a pair at the threshold per step."""

    shingle: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4
    hashes: int = 192
    step: int = 24
    miss: float = 1e-6
    block: int = 1024
    rounds: int = 2
    draws: int = 2
    held: int = 128


def least_matches(spec: NearDupSpec) -> list[tuple[int, int]]:
    """``(minima compared, matches needed)`` for each step, from the Beta posterior of the similarity."""
    grid = np.linspace(1e-9, 1 - 1e-9, 20001)
    high = grid >= spec.percent / 100
    out = []
    for n in range(spec.step, spec.hashes + 1, spec.step):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[high].sum() >= spec.miss * density.sum():
                out.append((n, m))
                break
    return out


def _shingle_sets(data, limits, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hash)`` of the distinct shingles, sorted; a text of fewer words has its whole sequence as one."""
    at, hashes = W.words(data, limits, W.LOWER_WORD)
    n = len(limits) - 1
    first = W.per_text(at, n)
    gram = W.grams(hashes, k)
    whole = at[: len(gram)] == at[k - 1 :] if len(gram) else np.zeros(0, dtype=bool)
    text, value = at[: len(gram)][whole], gram[whole]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = [W.grams(hashes[first[i] : first[i + 1]], int(count[i]))[0] ^ np.uint64(count[i]) for i in short]
        text, value = np.concatenate((text, short)), np.concatenate((value, np.array(extra, dtype=np.uint64)))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh]


def _digests(value: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits for each set, independent of order."""
    low = np.add.reduceat(W.mix(value ^ np.uint64(0x5851F42D4C957F2D)), starts)
    high = np.add.reduceat(W.mix(value ^ np.uint64(0x14057B7EF767814F)), starts)
    return np.stack((W.mix(low + sizes.astype(np.uint64)), W.mix(high)), axis=1)


def _sketcher(spec: NearDupSpec):
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 1 << 31, spec.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, spec.hashes, dtype=np.uint32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = W.text_bytes(batch.column(1))
            for a, b in W.slices(limits):
                part, cut = data[limits[a] : limits[b]], limits[a : b + 1] - limits[a]
                text, value = _shingle_sets(part, cut, spec.shingle)
                full, starts, sizes = np.unique(text, return_index=True, return_counts=True)
                n = np.zeros(b - a, dtype=np.int64)
                n[full] = sizes
                cls = np.full(b - a, None, dtype=object)
                sig = np.full(b - a, None, dtype=object)
                if len(full):
                    # the upper half of a shingle's hash, permuted as often as there are minima
                    half = (value >> np.uint64(32)).astype(np.uint32)
                    least = np.empty((len(full), spec.hashes), dtype=np.uint16)
                    for j in range(spec.hashes):
                        least[:, j] = np.minimum.reduceat((half ^ shift[j]) * factor[j], starts).astype(np.uint16)
                    digest = _digests(value, starts, sizes)
                    cls[full] = [x.tobytes() for x in digest]
                    sig[full] = [x.tobytes() for x in least]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), batch.column(2).slice(a, b - a)],
                    ["doc_id", "n_shingles", "cls", "sig", "mark"],
                )

    return sketch


def _survive(left: np.ndarray, right: np.ndarray, needed) -> np.ndarray:
    """Row numbers whose signatures pass every step; each step looks at the survivors of the one before."""
    rows, matches, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
    for n, least in needed:
        matches = matches + (left[rows, done:n] == right[rows, done:n]).sum(axis=1)
        keep = matches >= least
        rows, matches, done = rows[keep], matches[keep], n
    return rows


def _signatures(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, hashes)


def _pruned(pairs: DataFrame, sigs: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures do not rule out a link."""
    needed = least_matches(spec)

    def compare(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                rows = _survive(_signatures(part.column(2), spec.hashes), _signatures(part.column(3), spec.hashes), needed)
                yield part.select([0, 1]).take(pa.array(rows))

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b"
    )
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a long, b long")


def _confirmed(pairs: DataFrame, held: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Pairs linked by their full sets. ``held``: ``(node, text)``."""

    def sets_of(values):
        data, limits = W.text_bytes(values)
        out = []
        for a, b in W.slices(limits):
            text, value = _shingle_sets(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], spec.shingle)
            ends = np.searchsorted(text, np.arange(b - a + 1))
            out += [value[ends[i] : ends[i + 1]] for i in range(b - a)]
        return out

    def decide(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                left, right = part.column(2).dictionary_encode(), part.column(3).dictionary_encode()
                sets_a, sets_b = sets_of(left.dictionary), sets_of(right.dictionary)
                linked = []
                for i, j in zip(left.indices.to_pylist(), right.indices.to_pylist()):
                    a, b = sets_a[i], sets_b[j]
                    common = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= spec.percent * max(len(a), len(b)) else 0
                    linked.append(100 * common >= spec.percent * (len(a) + len(b) - common))
                yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(decide, "a long, b long")


def components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """``(node, comp)`` of every linked node: least neighbour and a jump to the label's label, until nothing changes.

    After ``steps``, if given, it ends early: then a component may still have several labels, but no label two components.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    done = 0
    while steps is None or done < steps:
        done += 1
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = stage(step.join(jump, "next", "left").select("node", "old", F.least("next", "far").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if steps is None and moved.where("comp <> old").isEmpty():
            break
    return labels


def _drawn(buckets: DataFrame, comps: DataFrame | None, number: int, spec: NearDupSpec) -> DataFrame:
    """For each class up to ``draws`` partners ``(a, b)`` under other labels: of the members drawn from its buckets, those of most buckets."""
    member = _member(buckets, comps)
    drawn = [F.min_by(F.struct("node", "comp"), F.struct(F.xxhash64("node", F.lit(number * spec.draws + i)), "node")) for i in range(spec.draws)]
    hubs = member.groupBy("band").agg(F.array_distinct(F.array(*drawn)).alias("hubs"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    met = member.join(hubs.select("band", "hubs"), "band").select("node", "comp", F.explode("hubs").alias("hub")).where("comp <> hub.comp")
    shared = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("shared"))
    best = F.sort_array(F.collect_list(F.struct("shared", (-F.col("hub")).alias("less"))), asc=False)
    return shared.groupBy(F.col("node").alias("a")).agg(F.slice(best, 1, spec.draws).alias("best")).select("a", F.explode("best").alias("b")).select("a", (-F.col("b.less")).alias("b"))


def _member(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return buckets.withColumn("comp", F.col("node"))
    return buckets.join(comps, "node", "left").select(*buckets.columns, F.coalesce("comp", "node").alias("comp"))


def _across(buckets: DataFrame, sigs: DataFrame, comps: DataFrame, spec: NearDupSpec) -> DataFrame:
    """``(a, held, partners)``: classes and their undecided partners of other components, by the block that holds the partners' texts."""
    member = _member(buckets, comps)
    mixed = member.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
    split = F.ceil(F.col("size") / spec.block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = (
        member.join(mixed.select("band", split.alias("parts")), "band")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("band_no", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp")
    )
    needed = least_matches(spec)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = [table.column(c).to_numpy() for c in ("band", "lo", "hi")]
        own, node, comp, band_no, held, weight = (table.column(c).to_numpy() for c in ("own", "node", "comp", "band_no", "held", "weight"))
        sig = _signatures(table.column("sig"), spec.hashes)
        group = np.zeros(len(node), dtype=np.int64)
        if len(node):
            group[1:] = np.cumsum(np.any([k[1:] != k[:-1] for k in key], axis=0))
        across = key[1] != key[2]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for gap in range(1, int(np.bincount(group).max(initial=1))):
            left = np.flatnonzero((group[gap:] == group[:-gap]) & (comp[gap:] != comp[:-gap]))
            right = left + gap
            fit = ~across[left] | (own[left] != own[right])
            left, right = left[fit], right[fit]
            if not len(left):
                continue
            rows = _survive(sig[left], sig[right], needed)
            left, right = left[rows], right[rows]
            # a pair that shares several bands is told by the first of them
            same = (sig[left, : spec.bands * spec.rows] == sig[right, : spec.bands * spec.rows]).reshape(-1, spec.bands, spec.rows).all(axis=2)
            told = same.argmax(axis=1) == band_no[left] if len(left) else np.zeros(0, dtype=bool)
            found.append((left[told], right[told]))
        left, right = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
        if not len(left):
            return
        # the member of the smaller component asks
        turn = (weight[left] > weight[right]) | ((weight[left] == weight[right]) & (comp[left] > comp[right]))
        asks, told = np.where(turn, right, left), np.where(turn, left, right)
        order = np.lexsort((held[told], node[asks]))
        asks, told = asks[order], told[order]
        fresh = np.ones(len(asks), dtype=bool)
        fresh[1:] = (node[asks][1:] != node[asks][:-1]) | (held[told][1:] != held[told][:-1])
        begin = np.flatnonzero(fresh)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(asks)).astype(np.int32)), pa.array(node[told]))
        yield pa.RecordBatch.from_arrays([pa.array(node[asks][begin]), pa.array(held[told][begin]), lists], ["a", "held", "partners"])

    def stream(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            key = [waiting.column(c).to_numpy() for c in ("band", "lo", "hi")]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0)) if waiting.num_rows else np.zeros(0, dtype=int)
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from compare(waiting.slice(0, cut).combine_chunks())
                waiting = waiting.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield from compare(waiting.combine_chunks())

    placed = _blocks(sigs, buckets, comps, spec)
    carried = dealt.join(placed.select("node", "sig", "held", "weight"), "node").select("band_no", "band", "lo", "hi", "own", "node", "comp", "held", "weight", "sig")
    return carried.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(stream, "a long, held long, partners array<long>")


def _blocks(nodes: DataFrame, buckets: DataFrame, comps: DataFrame, spec: NearDupSpec) -> DataFrame:
    """``nodes`` with ``weight`` (the size of their component), ``alike`` and ``held``, a block of about ``spec.held`` classes.

    A block holds members of one large component (``alike``), or classes of small ones that have the same largest bucket.
    """
    sizes = comps.groupBy("comp").agg(F.count("*").alias("weight"))
    crowd = buckets.groupBy("band").agg(F.count("*").alias("crowd"))
    lead = buckets.join(crowd, "band").groupBy("node").agg(F.max(F.struct("crowd", "band")).alias("lead"))
    own = nodes.join(comps, "node", "left").join(sizes, "comp", "left").join(lead, "node").withColumn("weight", F.coalesce("weight", F.lit(1)))
    part = lambda size: F.pmod(F.xxhash64("node"), F.ceil(size / spec.held))
    alike = F.col("weight") >= spec.held
    held = F.when(alike, F.xxhash64("comp", part(F.col("weight")))).otherwise(F.xxhash64("lead.band", part(F.col("lead.crowd")), F.lit(1)))
    return own.withColumn("alike", alike).withColumn("held", held).drop("comp", "lead")


def _decided(asked: DataFrame, held: DataFrame, blocks: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Links ``(a, b)`` among lists of partners: each block's sets are built once and meet all that ask for its members."""

    def sets_of(values: pa.Array) -> list[np.ndarray]:
        data, limits = W.text_bytes(values)
        text, value = _shingle_sets(data, limits, spec.shingle)
        ends = np.searchsorted(text, np.arange(len(values) + 1))
        return [value[ends[i] : ends[i + 1]] for i in range(len(values))]

    def stream(batches):
        block, sets = None, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for key, node, partners, own, alike in zip(*(part.column(c).to_pylist() for c in (0, 2, 3)), sets_of(part.column(4)), part.column(5).to_pylist()):
                    if key != block:
                        block, sets = key, {}
                    if partners is None:
                        sets[node] = own, alike
                        continue
                    for b in partners:
                        other, one = sets.get(b, (own[:0], False))
                        if not len(other) or 100 * min(len(own), len(other)) < spec.percent * max(len(own), len(other)):
                            continue
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * common >= spec.percent * (len(own) + len(other) - common):
                            out.append((node, b))
                            if one:
                                # all members of such a block are of one component: one link is as good as all
                                break
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    wanted = asked.select("held").distinct()
    there = held.join(blocks.select("node", "held", "alike"), "node").join(wanted, "held", "left_semi").select("held", F.lit(0).alias("turn"), "node", F.lit(None).cast("array<long>").alias("partners"), "text", "alike")
    asks = asked.join(held, asked["a"] == held["node"]).select("held", F.lit(1).alias("turn"), F.col("a").alias("node"), "partners", "text", F.lit(False).alias("alike"))
    return there.union(asks).repartition("held").sortWithinPartitions("held", "turn").mapInArrow(stream, "a long, b long")


def near_dups(docs: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, mark`` (``mark``: a hash of the text).

    Words are lower-cased (A-Z) runs without white space. A null or wordless text has no shingle, is linked
    with nothing and is kept. A null id is linked with nothing either: its component is null and it is kept.
    A document of fewer words than a shingle has its whole sequence as its one shingle. Repeated rows give
    repeated rows; rows that share an id but not a text are documents of their own. Other columns of
    ``docs`` are not read.
    """
    source = texts(docs).withColumn("mark", F.xxhash64("text"))
    rows = stage(source.mapInArrow(_sketcher(spec), "doc_id long, n_shingles long, cls binary, sig binary, mark long"), "sketches")
    nodes = stage(
        rows.where("cls is not null and doc_id is not null")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    width = 2 * spec.rows
    banded = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(spec.bands - 1))).alias("band_no")).select(
        "node", "band_no", F.expr(f"xxhash64(band_no, substring(sig, 1 + {width} * band_no, {width}))").alias("band")
    )
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("band", "hub")
    buckets = stage(banded.join(hubs, "band", "left_semi"), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("node", "cls", F.col("rep").alias("doc_id"))
    # repeated rows: one text is enough; the join has dealt rows by id already
    own = wanted.join(source, "doc_id").dropDuplicates(["doc_id", "node", "mark"])
    held = stage(own.select("node", "cls", "text").mapInArrow(_own_text(spec), "node long, text string"), "texts")
    links, comps = None, None
    for number in range(spec.rounds):
        fresh = stage(_confirmed(_pruned(_drawn(buckets, comps, number, spec), nodes, spec), held, spec), "links")
        links = fresh if links is None else links.union(fresh)
        comps = components(links, steps=1)
    asked = stage(_across(buckets, nodes, comps, spec), "asked")
    comps = components(links.union(_decided(asked, held, _blocks(nodes.select("node"), buckets, comps, spec), spec)))
    placed = nodes.join(comps, "node", "left").select("cls", "rep", F.coalesce("comp", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "comp").select(F.col("cls").alias("named"), "component_id")
    at = F.when(rows.doc_id.isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(named, rows.cls == F.col("named"), "left").select(
        "doc_id", "n_shingles", at.alias("component_id"), F.coalesce(at == F.col("doc_id"), F.lit(True)).alias("kept"), "mark"
    )


def without_near_dups(docs: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """The rows of ``docs`` without those of near-duplicates of a smaller id; of rows with equal id and text one stays."""
    kept = near_dups(docs, spec).where("kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    own, print_ = fresh(docs.columns, "_kept_id", "_kept_mark")
    marked = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(print_, F.xxhash64(F.col("text").cast("string")))
    stay = marked.join(kept, marked[own].eqNullSafe(kept["_id"]) & (marked[print_] == kept["_mark"]), "left_semi")
    return stay.dropDuplicates([own, print_]).drop(own, print_)


def _own_text(spec: NearDupSpec):
    """Keeps one text per node: that whose set is the node's (an id may come with several texts)."""

    def check(batches):
        for batch in batches:
            node, cls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, limits = W.text_bytes(batch.column(2))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for a, b in W.slices(limits):
                text, value = _shingle_sets(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], spec.shingle)
                full, starts, sizes = np.unique(text, return_index=True, return_counts=True)
                if len(full):
                    for i, digest in zip(full, _digests(value, starts, sizes)):
                        keep[a + i] = digest.tobytes() == cls[a + i]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(2).filter(pa.array(keep))], ["node", "text"])

    return check
