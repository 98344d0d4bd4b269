"""Personal data: generators propose spans, boosted trees weigh them, a calibrated threshold selects.

Base kinds (email, ip, card, phone) are found by their own patterns and always stay. Beside them generators of high recall
propose spans that may overlap each other and the base: numbers grouped in any way, addresses spelled out,
dotted numbers. Boosted trees judge a proposal by its format and its surroundings; those that overlap no base span can be added.

Labels do not come from the base match of a proposal, which a span to add never has, but from
* proposals free of the base in all documents: checksum, cue word beside, format (``_evidence``);
* base spans of all documents said in a form the base does not find (address spelled out, telephone number without its plus behind a cue, card
  with other separators) and counter-examples of the same form (no domain, no cue, wrong checksum), likewise of a few built-in
  texts, so that every kind has both labels on any corpus;
* findings that a reviewer has labelled, if given.
All of them are learned from. The threshold is the lowest, from an even chance up, that reaches the wanted precision on all of
them, each judged by trees of the other folds that have not seen it.

Everything on the way is columns: matches, features, trees (written out as CASE) and the choice of spans, all within
a row, and no Python runs on the executors. Only the training rows are shuffled, to be counted: proposals of equal label
and features become one row with their number in each fold.
"""

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairtide.llm.matches import find, let
from pairtide.llm.tables import texts
from pairtide.llm.trees import boosted_chance
from pairtide.session import stage

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns. They match what the plain ones match, but begin only where a run begins and never
#: repeat a group without bound, so long runs cost linear time and no stack.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])(?>[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-])))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

_AT, _DOT = r" ?[\[({] ?(?i:at) ?[\])}] ?", r"(?: ?[\[({] ?(?i:dot) ?[\])}] ?| (?i:dot) )"
_LABEL, _LAST = "[A-Za-z0-9-]{1,63}+", "[A-Za-z][A-Za-z0-9-]{1,62}+"

#: Proposals: kind, pattern.
PROPOSALS = (
    ("email", rf"(?<!{_LOCAL})(?:{_LOCAL}{{1,64}}+{_DOT}){{0,3}}{_LOCAL}{{1,64}}+(?:{_AT}{_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{0,4}}(?:{_DOT}|\.){_LAST}| (?i:at) {_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}{_LAST})"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]{1,200}+"),
    ("ip", r"(?<![0-9.])[0-9]{1,5}+(?:\.[0-9]{1,5}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){11,19}(?![0-9])"),
    ("phone", r"(?<![0-9])[+(]?[0-9](?:[ ().-]{0,3}[0-9]){6,15}(?![0-9])"),
)

FEATURES = ("length", "digits", "groups", "dots", "at", "plus", "brackets", "lead", "spaced", "spelled", "cue", "quoted", "letters_beside", "kind_no", "dashes", "biggest", "named", "domain", "checksum", "form", "dated")

#: Words just before a span that announce its kind.
_NAMED = {
    "phone": r"(?i)(?:\btel|phone|\bcall|\bfax|mobile|\bcell|whatsapp|anruf|\bhandy|rufnummer|\btél|teléfono|telefon|móvil|portable)[^0-9]{0,12}$",
    "card": r"(?i)(?:\bcard|visa\b|amex|tarjeta|\bcarte\b|karte)[^0-9]{0,16}$",
}
#: Formats that speak for themselves: an area code in brackets, a card number in its groups.
_FORM = {"phone": r"^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$", "card": r"^[0-9]{4}(?:[ .-]{1,2}[0-9]{4}){3}$|^[0-9]{4}[ .-]{1,2}[0-9]{6}[ .-]{1,2}[0-9]{5}$"}
_DOMAIN = r"(?i)(?:[. \])}])(?:com|org|net|edu|gov|info|biz|name|app|dev|[a-z]{2})$"
_DATED = r"^(?:19|20)[0-9]{2}(?:[. -][01]?[0-9][. -][0-3]?[0-9]|[01][0-9][0-3][0-9])(?![0-9])|^[0-3]?[0-9][. -][01]?[0-9][. -](?:19|20)[0-9]{2}(?![0-9])"

#: Invented texts whose renderings give every kind both labels, whatever the corpus holds.
_BUILT_IN = (
    "please write to jane.doe7@mail.example.org before noon", "contact: bob@example.com, room 12", "Kontakt k_meier@firma.de oder", "the author (li+wei@lab.example.edu) said",
    "x99@y.net", "escriba a ana@correo.example.es hoy", "you reach us under +1 (212) 555-0187 all day", "+49 30 5550 1234", "or +33 1 55 50 12 34, then", "ask +442079460123 for",
    "she paid with 4111 1111 1111 1111 and left", "5500005555555559", "the number 4012-8888-8888-1881 is", "look at the polka dot dress", "we met at point dot matrix",
    "order 7719 4402 1830 of 20240115 10", "pi 3.14159 26535 89793", "items 1000200030 and 555 010 2020", "version 10.20.300.4000",
)


@dataclass(frozen=True)
class PiiSpec:
    """``precision`` is asked of added spans; ``bins``, split candidates of a feature, is more than any has values, and raised
    where there are more than its square of different training rows, as Spark ML would draw the candidates from a sample of them."""

    bins: int = 1024
    folds: int = 4
    trees: int = 12
    depth: int = 4
    precision: float = 0.97
    seed: int = 2


#: The square of the bins has to be a 32-bit integer.
_MOST_BINS = 46_340

_SPANS = "array<struct<kind_no:int,start:int,end:int>>"


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.when(b > 9, b - 9).otherwise(b)) % 10 == 0


def _holds(kind: str, said: Column) -> Column:
    """Whether a base match passes its kind's test."""
    if kind == "ip":
        return F.forall(F.split(said, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+(?=.)", "")).between(1, 3) & (F.right(F.concat(F.lit("00"), F.regexp_replace(part, "^0+(?=.)", "")), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return let(_digits(said), _luhn)
    if kind == "phone":
        return F.length(_digits(said)).between(9, 15)
    return F.lit(True)


#: A cheap test before a pattern is tried on a whole text.
_HINT = {"email": "@", "phone": "+"}


def _base(text: Column, kind: str) -> Column:
    """Array of the base matches of a kind."""
    found = F.filter(find(text, PATTERNS[kind], kind), lambda m: _holds(kind, m["said"]))
    return F.when(text.contains(_HINT[kind]), found).otherwise(F.array()) if kind in _HINT else found


def base_spans(text: Column) -> Column:
    """Array of ``(kind_no, start, end)`` of the base spans of a text, in order."""

    def of(number: int, kind: str) -> Column:
        return F.transform(_base(text, kind), lambda m: F.struct(F.lit(number).alias("kind_no"), m["start"].alias("start"), m["end"].alias("end"))).cast(_SPANS)

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def proposals(text: Column) -> Column:
    """Array of proposed matches of all generators."""
    return F.concat(*[find(text, pattern, kind) for kind, pattern in PROPOSALS])


def _by_kind(m: Column, patterns: dict[str, str], on: Column) -> Column:
    """Whether ``on`` matches the pattern of the match's kind; false for kinds without one."""
    out = F.lit(False)
    for kind, pattern in patterns.items():
        out = F.when(m["kind"] == kind, on.rlike(pattern)).otherwise(out)
    return out


def _checked(m: Column) -> Column:
    """Whether a card's digits pass their checksum."""
    return F.when(m["kind"] == "card", let(_digits(m["said"]), lambda d: F.length(d).between(13, 19) & _luhn(d))).otherwise(False)


def _beside(m: Column) -> Column:
    return F.lower(m["left"]).rlike(r"[a-z_]$") | m["right"].rlike("^[A-Za-z_]")


def _features(m: Column) -> list[Column]:
    said, left = m["said"], F.lower(m["left"])
    count = lambda what: F.length(said) - F.length(F.regexp_replace(said, what, ""))
    cue = r"mail|e-mail|contact|tel|phone|call|fax|mobile|card|visa|account|\bip\b|host|server|adress|address|correo|courriel|anruf|tarjeta|carte"
    values = [
        F.length(said), count("[0-9]"), F.size(F.split(said, "[^0-9]+")), count(r"\."), count("@"), count(r"\+"), count(r"[()\[\]]"),
        F.coalesce(F.substring(_digits(said), 1, 1).try_cast("int"), F.lit(-1)), count(" "), said.rlike(r"(?i) dot |[\[({] ?(?:at|dot) ?[\])}]").cast("int"),
        left.rlike(cue).cast("int"), left.rlike(r"[=\"'/:_]\s?$").cast("int"),
        _beside(m).cast("int"),
        F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]), count("-"),
        F.coalesce(F.array_max(F.transform(F.split(said, r"[^0-9]+"), lambda g: F.length(g))), F.lit(0)),
        _by_kind(m, _NAMED, m["left"]).cast("int"), _by_kind(m, {"email": _DOMAIN}, said).cast("int"), _checked(m).cast("int"), _by_kind(m, _FORM, said).cast("int"), said.rlike(_DATED).cast("int"),
    ]
    return [v.cast("double") for v in values]


def _evidence(m: Column) -> Column:
    """Whether a proposal that overlaps no base span is personal data by checksum, cue or format."""
    named, form = _by_kind(m, _NAMED, m["left"]), _by_kind(m, _FORM, m["said"])
    return (
        F.when(m["kind"] == "email", ~m["said"].contains("@") & _by_kind(m, {"email": _DOMAIN}, m["said"]))
        .when(m["kind"] == "card", _checked(m) & (named | form))
        .when(m["kind"] == "phone", (named | form) & ~_beside(m) & F.length(_digits(m["said"])).between(7, 15) & ~m["said"].rlike(_DATED))
        .otherwise(False)
    )


def _renderings(base: Column) -> Column:
    """Array of ``(kind, start, before, said, after, label)``: a text's base matches in forms that the base does not find, and counter-examples."""

    def rows(m: Column, made: list[tuple[Column, Column, int]]) -> list[Column]:
        return [F.struct(m["kind"].alias("kind"), m["start"].alias("start"), before.alias("before"), said.alias("said"), m["right"].alias("after"), F.lit(float(label)).alias("label")) for before, said, label in made]

    def email(m: Column) -> list:
        name, domain = F.substring_index(m["said"], "@", 1), F.substring_index(m["said"], "@", -1)
        spelt = lambda at, dot, d: F.concat(name, F.lit(at), F.replace(d, F.lit("."), F.lit(dot)))
        forms = ((" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."))
        return [(m["left"], spelt(at, dot, domain), 1) for at, dot in forms] + [(m["left"], spelt(at, dot, F.regexp_replace(domain, r"\.[^.]*$", f".{word}")), 0) for at, dot, word in ((" at ", " dot ", "matrix"), (" at ", " dot ", "dress"), ("(at)", "(dot)", "product"))]

    def phone(m: Column) -> list:
        bare = F.regexp_replace(m["said"], r"^\+[0-9]{1,3}?[ .-]*(?=[(0-9])", "")
        digits, kept = _digits(bare), F.regexp_replace(m["left"], _NAMED["phone"], "")
        grouped = [digits, *(F.regexp_replace(digits, "^([0-9]{3})([0-9]{3})([0-9]+)$", f"$1{gap}$2{gap}$3") for gap in "- .")]
        named = [(F.concat(kept, F.lit(cue)), said, 1) for cue in (" tel. ", " phone: ", " call ", " fax ") for said in (*grouped, bare, F.substring(m["said"], 2, 99))]
        plain = [(F.concat(kept, F.lit(lead)), said, 0) for lead in (" order ", " item: ", " total of ", " account ") for said in grouped]
        return named + plain + [(F.concat(kept, F.lit(f" {lead} ")), F.lit(date), 0) for lead in ("call on", "phone") for date in ("2024-01-15 10", "15.01.2024", "20240115")]

    def card(m: Column) -> list:
        digits = _digits(m["said"])
        wrong = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        return [(m["left"], F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{gap}"), label) for d, label in ((digits, 1), (wrong, 0)) for gap in (".", "  ", " -")]

    def of(kind: str, made) -> Column:
        return F.flatten(F.transform(F.filter(base, lambda m: m["kind"] == kind), lambda m: F.array(*rows(m, made(m)))))

    return F.concat(of("email", email), of("phone", phone), of("card", card))


def _proposed(docs: DataFrame) -> DataFrame:
    """Labelled ``(given, label, draw, m)``, ``given`` unless from a built-in text: free proposals of the documents, renderings of their base spans and of the built-in texts."""
    text = F.coalesce("text", F.lit(""))
    seeds = docs.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1 - i).cast("long").alias("doc_id"), F.lit(t).alias("text")) for i, t in enumerate(_BUILT_IN)])).alias("s")).select("s.*")
    every = texts(docs).withColumn("given", F.lit(True)).union(seeds.withColumn("given", F.lit(False)))
    # one pass: base matches are found once, for what they leave free and for their renderings
    based = every.select("doc_id", "given", text.alias("text"), F.concat(*[_base(text, k) for k in KINDS]).alias("base"))
    row = lambda at, label, m: F.struct(at.alias("at"), label.cast("double").alias("label"), m.alias("m"))

    def own(base: Column) -> Column:
        free = F.filter(proposals(F.col("text")), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        return F.transform(free, lambda m: row(m["start"], _evidence(m), m))

    def met(r: Column) -> Column:
        begin = F.length(r["before"])
        found = F.filter(let(F.concat(r["before"], r["said"], r["after"]), proposals), lambda m: (m["kind"] == r["kind"]) & (m["start"] == begin) & (m["end"] == begin + F.length(r["said"])))
        return F.transform(found, lambda m: row(r["start"], r["label"], m))

    shown = F.flatten(F.transform(_renderings(F.col("base")), met))
    rows = based.select("doc_id", "given", F.explode(F.concat(own(F.col("base")), shown)).alias("r"))
    return rows.select("given", "r.label", F.crc32(F.concat_ws(":", "doc_id", "r.at").cast("binary")).alias("draw"), "r.m")


def train_pii(docs: DataFrame, spec: PiiSpec = PiiSpec(), findings: DataFrame | None = None):
    """``(model, threshold)`` from all documents and, if given, reviewers' ``findings`` ``(kind, said, left, right,
    label)``; None if the documents have neither a proposal nor a base span and there are no findings."""
    rows = _proposed(docs)
    if findings is not None:
        m = F.struct("kind", F.lit(0).alias("start"), F.length("said").alias("end"), "said", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
        known = findings.where("said is not null and label in (0, 1)")
        rows = rows.union(known.select(F.lit(True), F.col("label").cast("double"), F.crc32(F.concat_ws(":", "kind", "left", "said").cast("binary")), m))
    alike, folds = ["label", *FEATURES], [f"fold{k}" for k in range(spec.folds)]
    each = rows.select("given", "label", (F.col("draw") % spec.folds).alias("fold"), *[c.alias(f) for f, c in zip(FEATURES, _features(F.col("m")))])
    counted = each.groupBy(*alike).agg(F.max("given").alias("given"), *[F.count_if(F.col("fold") == k).cast("double").alias(f) for k, f in enumerate(folds)])
    drawn = stage(counted.sortWithinPartitions(*alike), "proposals")
    if drawn.where("given").isEmpty():
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(drawn)
    bins = max(spec.bins, min(math.isqrt(drawn.count()) + 1, _MOST_BINS))
    trees = GBTClassifier(maxIter=spec.trees, maxDepth=spec.depth, maxBins=bins, seed=spec.seed, featuresCol="features", labelCol="label", weightCol="weight")

    def learned(names: list[str]):
        """Trees from the rows of these folds."""
        return trees.fit(vectors.select("features", "label", reduce(add, map(F.col, names)).alias("weight")).where("weight > 0"))

    def judged(fold: str) -> DataFrame:
        """The rows of a fold with their chance, in thousandths, under trees of the others."""
        chance = boosted_chance(learned([f for f in folds if f != fold]), lambda k: F.col(FEATURES[k]))
        return drawn.where(F.col(fold) > 0).select(F.floor(chance * 1000).alias("step"), "label", F.col(fold).alias("weight"))

    model = learned(folds)
    # precision of everything at or above a chance: a table of 1001 rows at most
    steps = reduce(DataFrame.union, map(judged, folds)).groupBy("step").agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("all"))
    down = Window.orderBy(F.desc("step"))
    good = steps.select("step", (F.sum("right").over(down) / F.sum("all").over(down)).alias("precision")).where((F.col("precision") >= spec.precision) & (F.col("step") >= 500))
    least = good.agg(F.min("step")).first()[0]
    return model, 1.01 if least is None else least / 1000


def _added(text: Column, base: Column, trained) -> Column:
    """Proposals at or above the threshold that overlap no base span and no better proposal."""
    none = F.array().cast(_SPANS)
    if trained is None:
        return none
    model, threshold = trained

    def weighed(m: Column) -> Column:
        number = F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]).cast("int") - 1
        score = let(F.array(*_features(m)), lambda f: boosted_chance(model, lambda k: F.get(f, F.lit(k))))
        return F.struct((-score).alias("rank"), number.alias("kind_no"), m["start"].alias("start"), m["end"].alias("end"))

    clash = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter(proposals(text), lambda m: ~F.exists(base, lambda b: clash(m, b)))
    chosen = F.array_sort(F.filter(F.transform(free, weighed), lambda s: s["rank"] <= -threshold))
    apart = let(chosen, lambda all_: F.filter(all_, lambda s, i: ~F.exists(F.slice(all_, 1, i), lambda better: clash(s, better))))
    return F.transform(apart, lambda s: F.struct(s["kind_no"].alias("kind_no"), s["start"].alias("start"), s["end"].alias("end"))).cast(_SPANS)


def personal_spans(docs: DataFrame, trained) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text``) with ``base`` and ``spans``: arrays of ``(kind_no, start, end)`` by kind, then start.

    A null text has no span. Repeated rows give repeated rows; a null id stays null; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    based = texts(docs).select("doc_id", "text", F.array_sort(base_spans(text)).alias("base"))
    return based.select("doc_id", "text", "base", let(F.col("base"), lambda b: F.array_sort(F.concat(b, _added(text, b, trained)))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind_no"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame, trained) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one, named after the first.

    All other columns and rows without a span are unchanged; a null text stays null.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(base_spans(text))
    spans = let(base, lambda b: F.array_sort(F.transform(F.concat(b, _added(text, b, trained)), lambda s: F.struct(s["start"], s["end"], s["kind_no"]))))
    # union of overlapping spans: a span begins a new one if it starts at or behind the furthest end before it
    reach = lambda all_, i: F.coalesce(F.array_max(F.transform(F.slice(all_, 1, i), lambda s: s["end"])), F.lit(0))
    first = lambda all_: F.filter(F.transform(all_, lambda s, i: F.struct(s["start"].alias("start"), reach(all_, i).alias("reach"), s["kind_no"].alias("kind_no"))), lambda s: s["start"] >= s["reach"])
    mark = lambda s: F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), s["kind_no"])), F.lit("]"))
    piece = lambda s: F.concat(F.substr(text, s["reach"] + 1, s["start"] - s["reach"]), mark(s))
    tail = lambda all_: F.substr(text, F.array_max(F.transform(all_, lambda s: s["end"])) + 1, F.length(text))
    clean = let(spans, lambda all_: F.when(F.size(all_) == 0, text).otherwise(F.concat(F.array_join(F.transform(first(all_), piece), ""), tail(all_))))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))
