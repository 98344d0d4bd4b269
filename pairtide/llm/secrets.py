"""Secrets: long tokens as candidates, a random forest to drop false positives.

A candidate is a run of token characters, whatever is assigned to a credential's name (quoted or not, in a URL's parameters, of any
length from four characters and with any symbols), the password of a ``user:password@host`` or the body of a private key block. The forest sees its length, how often its characters change class, how much
of it is made of dictionary words, whether it is part of a path, and the words beside it. It learns from labelled
findings: rows with a candidate's text and surroundings and a label 1 (a secret) or 0. Scoring is column
expressions only: features and trees (written out as CASE) are worked out within a row.
"""

import random
import string
import uuid
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairtide.llm.matches import find, let
from pairtide.llm.tables import texts
from pairtide.llm.trees import vote_share
from pairtide.session import stage

CANDIDATE = r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{16,}+={0,2}(?![A-Za-z0-9_+/.-])"
FEATURES = ("length", "changes", "digit_share", "capital_share", "dictionary", "longest_letters", "path", "suffix", "cue", "assigned", "quoted", "kinds", "hex", "named", "symbols", "userinfo", "reference", "issuer", "block", "pieces", "uuid")

#: Words that announce a credential.
_CUE = r"(?i)token|secret|passw|api.?key|access.?key|credential|bearer|auth|private.?key"

#: From a credential's name to where its value begins.
_NAME = r"(?i:passw|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential|private[_ -]?key|auth(?!or(?!i[sz])))[A-Za-z0-9_-]{0,40}+[\"'\]]{0,2}\s{0,3}(?:=>|:=|={1,2}|:)\s{0,3}(?:(?i:bearer|basic|token)\s{1,3})?"
#: A quoted value, or a run up to white space, a quote or a separator before another name.
_PLAIN = r"[^\s\"'<>&,;]*+"
_VALUE = rf"(?:\"[^\"\n]{{4,}}+\"|'[^'\n]{{4,}}+'|(?![\"']){_PLAIN}(?:[&,;](?!\s|$|[A-Za-z_][\w.-]{{0,40}}+[=:]|#?\w{{1,8}}+;){_PLAIN}){{0,64}}+)"
ASSIGNMENT = _NAME + _VALUE
#: A password in front of a host.
USERINFO = r"://[^\s/:@\"'<>]{0,256}+:[^\s/\"'<>]{1,2048}@"

#: A private key between its lines.
BLOCK = r"(?<=PRIVATE KEY-----\s{0,4}|PRIVATE KEY BLOCK-----\s{0,4})[A-Za-z0-9+/=][A-Za-z0-9+/=:,. \r\n]{30,}[A-Za-z0-9+/=](?=\s{0,4}-----END)"

# Formats in which services issue credentials (name, prefix, then what follows it in full).
ISSUED = {
    "cloud access key": (r"A[KS]IA", r"[A-Z0-9]{16}"),
    "code host token": (r"gh[pousr]_", r"[A-Za-z0-9]{36}"),
    "code host fine token": (r"github_pat_", r"[A-Za-z0-9]{22}_[A-Za-z0-9]{59}"),
    "code host access token": (r"glpat-", r"[A-Za-z0-9_-]{20}"),
    "chat token": (r"xox[abprs]-", r"[0-9]{8,13}-(?:[0-9]{8,13}-){0,2}[A-Za-z0-9]{16,}"),
    "payment key": (r"[rs]k_(?:live|test)_", r"[A-Za-z0-9]{24,}"),
    "map key": (r"AIza", r"[A-Za-z0-9_-]{35}"),
    "sign-in token": (r"ya29\.", r"[A-Za-z0-9_-]{30,}"),
    "mail key": (r"SG\.", r"[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    "package token": (r"npm_", r"[A-Za-z0-9]{36}"),
    "web token": (r"eyJ", r"[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{16,}"),
}
_ISSUER = "^(?:" + "|".join(prefix for prefix, _ in ISSUED.values()) + ")"
_WHOLE = "^(?:" + "|".join(prefix + rest for prefix, rest in ISSUED.values()) + ")$"
_UUID = r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
_KEY_LINE = r"PRIVATE KEY(?: BLOCK)?-----\s*$"
#: A quoted value behind a password's name may be plain words.
_PASSPHRASE = r"(?i)(?:passw[a-z]*|passphrase|pwd)[\"'\]]{0,2}\s{0,3}(?:=>|:=|={1,2}|:)\s{0,3}[\"']$"

_NAMED = rf"{_NAME}[\"']?$"
#: A value that stands for one held elsewhere: a variable, a place holder, a call.
_REFERENCE = r"(?i)^(?:\$\{?[a-z_(]|\{\{|%\(|<|\*+$|x+$|\.{3}|(?:your|my|the|example)[_-]|(?:none|null|true|false|password|passwd|pass|secret|token|changeme)$|[a-z_][a-z0-9_.]*[(\[])"


@dataclass(frozen=True)
class SecretSpec:
    """``sample`` bounds the findings and documents that are fitted (about); a word in ``dictionary_share`` of all documents or more is in the dictionary."""

    sample: int = 20_000
    trees: int = 15
    depth: int = 7
    threshold: float = 0.5
    dictionary_share: float = 0.02
    seed: int = 1


_SHAPE = "array<struct<kind:string,start:int,end:int,said:string,left:string,right:string>>"


def _carved(found: Column, lead: str, tail: str) -> Column:
    """The matches without what ``lead`` matches at their beginning and ``tail`` at their end, which go to their surroundings."""

    def one(m: Column) -> Column:
        def cut(front: Column) -> Column:
            rest = F.substr(m["said"], F.length(front) + 1, F.length(m["said"]))
            return let(F.regexp_extract(rest, tail, 0), lambda back: F.struct(
                m["kind"].alias("kind"), (m["start"] + F.length(front)).alias("start"), (m["end"] - F.length(back)).alias("end"),
                F.substr(rest, F.lit(1), F.length(rest) - F.length(back)).alias("said"),
                F.right(F.concat(m["left"], front), F.lit(40)).alias("left"), F.substring(F.concat(back, m["right"]), 1, 40).alias("right"),
            ))

        return let(F.regexp_extract(m["said"], lead, 0), cut)

    return F.transform(found, one).cast(_SHAPE)


def _beyond(found: Column) -> Column:
    """The matches with surroundings of 40 characters that reach over the neighbouring match."""
    side = lambda m, *parts: F.concat(*[F.coalesce(m[p], F.lit("")) for p in parts])
    return F.transform(found, lambda m, i: F.struct(
        m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["said"].alias("said"),
        F.right(F.concat(side(F.get(found, i - 1), "left", "said"), m["left"]), F.lit(40)).alias("left"),
        F.substring(F.concat(m["right"], side(F.get(found, i + 1), "said", "right")), 1, 40).alias("right"),
    )).cast(_SHAPE)


def candidates(text: Column) -> Column:
    """Array of ``(kind, start, end, said, left, right)`` of a text's candidates: runs with a digit or 24 characters, values of
    four characters or more behind a credential's name, passwords before a host. No two have the same place; they may overlap."""
    runs = F.filter(let(find(text, CANDIDATE, "token", context=40), _beyond), lambda m: m["said"].rlike("[0-9]") | (F.length(m["said"]) >= 24))
    quoted_or_trailing = r"[\"']$|(?<![(\[{][^\n]{0,200})[)\]}.,;:]+$|[.,;:]+$"
    assigned = F.filter(_carved(find(text, ASSIGNMENT, "assigned", context=40), rf"^{_NAME}[\"']?", quoted_or_trailing), lambda m: F.length(m["said"]) >= 4)
    userinfo = F.when(text.contains("://"), _carved(find(text, USERINFO, "userinfo", context=40), r"^://[^:]*:", "@$")).otherwise(F.array().cast(_SHAPE))
    same = lambda all_: lambda m: ~F.exists(all_, lambda o: (o["start"] == m["start"]) & (o["end"] == m["end"]))
    more = let(assigned, lambda a: F.concat(a, F.filter(userinfo, same(a))))
    return let(more, lambda m_: F.concat(m_, F.filter(runs, same(m_))))


def candidate_rows(frame: DataFrame) -> DataFrame:
    """A row ``m`` beside the other columns of ``frame`` for each candidate of its ``text``: bodies of private keys, and what ``candidates``
    finds outside them."""
    text = F.coalesce("text", F.lit(""))
    kept = [c for c in frame.columns if c != "text"]
    # step by step, as each step is resolved on its own
    found = frame.select(*kept, find(text, BLOCK, "block", context=40).alias("_keys"), candidates(text).alias("_all"))
    apart = lambda m: ~F.exists("_keys", lambda o: (o["start"] <= m["start"]) & (o["end"] >= m["end"]))
    return found.select(*kept, F.explode(F.concat("_keys", F.when(F.size("_keys") == 0, F.col("_all")).otherwise(F.filter("_all", apart)))).alias("m"))


def dictionary(docs: DataFrame, spec: SecretSpec = SecretSpec()) -> list[str]:
    """The letter runs of at least a share of all documents, by number of documents, then by name: under 1 / share times the runs of a document."""
    runs = texts(docs).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,12}+"), F.lit(0)))).alias("word"))
    return [r[0] for r in runs.groupBy("word").count().where(F.col("count") >= spec.dictionary_share * docs.count()).orderBy(F.desc("count"), "word").collect()]


def _in_front_of_host(m: Column) -> Column:
    return m["left"].rlike(r"[^\s/:@]*:$") & m["left"].rlike("://") & m["right"].rlike("^@")


def features(m: Column, words: list[str]) -> list[Column]:
    """Features of one candidate, in the order of ``FEATURES``."""
    said = m["said"]
    size = F.length(said)
    share = lambda what: (size - F.length(F.regexp_replace(said, what, ""))) / size
    # a change: a letter beside a digit, or lower case before a capital
    changes = F.size(F.regexp_extract_all(said, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]"), F.lit(0)))
    runs = F.regexp_extract_all(F.lower(said), F.lit("[a-z]{3,}+"), F.lit(0))
    known = F.array(*map(F.lit, words)).cast("array<string>")
    covered = F.aggregate(F.filter(runs, lambda w: F.array_contains(known, w)), F.lit(0), lambda a, w: a + F.length(w))
    longest = F.coalesce(F.array_max(F.transform(runs, lambda w: F.length(w))), F.lit(0))
    values = [
        size, changes / size, share("[0-9]"), share("[A-Z]"), covered / size, longest, share("[/.]"),
        said.rlike(r"(?i)\.(?:py|js|com|org|net|html?|txt|md|json|png|jpe?g|ya?ml|csv|php)\b").cast("int"),
        m["left"].rlike(_CUE).cast("int"), m["left"].rlike(r"[=:]\s*[\"']?$").cast("int"), (m["left"].rlike("[\"']$") & m["right"].rlike("^[\"']")).cast("int"),
        said.rlike("[0-9]").cast("int") + said.rlike("[a-z]").cast("int") + said.rlike("[A-Z]").cast("int"), said.rlike("^[0-9a-f]+$").cast("int"),
        m["left"].rlike(_NAMED).cast("int"), share("[^A-Za-z0-9]"), _in_front_of_host(m).cast("int"), said.rlike(_REFERENCE).cast("int"),
        said.rlike(_ISSUER).cast("int"), m["left"].rlike(_KEY_LINE).cast("int"), F.size(F.split(said, "[._-]")), said.rlike(_UUID).cast("int"),
    ]
    return [v.cast("double") for v in values]


def evidence(m: Column) -> Column:
    """Whether what is known of credentials confirms a candidate: the whole of a format that a service issues, a key between its
    lines, or an assignment to a credential's name (or a place in front of a host) of something that is no reference: letters
    mixed with digits or symbols, or quoted words behind a password's name."""
    said, left = m["said"], m["left"]
    mixed = said.rlike("[A-Za-z]") & said.rlike(r"[^A-Za-z\s_./-]")
    held = (left.rlike(_NAMED) | _in_front_of_host(m)) & mixed
    phrase = left.rlike(_PASSPHRASE) & (F.length(said) >= 8)
    return said.rlike(_WHOLE) | left.rlike(_KEY_LINE) | ((held | phrase) & ~said.rlike(_REFERENCE))


def known_findings(docs: DataFrame, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """Labelled findings ``(said, left, right, label)`` of about ``sample`` documents, where reviewers' labels are missing.

    A candidate with ``evidence`` counts as confirmed, any other as refuted: hashes, unique ids, paths and names among
    them. Confirmed values are also shown unquoted, in a shell's and a URL's assignments, and built-in texts show each format that
    services issue and what only begins like it, as a corpus may hold one form only.
    """
    n = docs.count()
    drawn = texts(docs).sample(fraction=min(1.0, spec.sample / n) if n else 1.0, seed=spec.seed).select("text")
    shown = docs.sparkSession.range(1).select(F.explode(F.split(F.lit("\x1e".join(_built_in(spec.seed))), "\x1e")).alias("text"))
    m = candidate_rows(drawn.union(shown)).select("m.*")
    forms = ((None, None), ("\nAPI_KEY=", "\n"), ("export AWS_SECRET_ACCESS_KEY=", "\n"), ("https://example.com/a?access_token=", "&x=1"))
    ways = F.array(*[F.struct(F.lit(left).cast("string").alias("left"), F.lit(right).cast("string").alias("right")) for left, right in forms])
    sure = evidence(F.struct("said", "left", "right"))
    told = m.select("said", "left", "right", sure.cast("int").alias("label"))
    one_line = ~F.col("said").contains("\n")
    return told.withColumn("way", F.explode(F.when((F.col("label") == 1) & one_line, ways).otherwise(F.slice(ways, 1, 1)))).select("said", F.coalesce("way.left", "left").alias("left"), F.coalesce("way.right", "right").alias("right"), "label")


def _drawn(rng: random.Random, letters: str, size: int) -> str:
    return "".join(rng.choice(letters) for _ in range(size))


def _built_in(seed: int = 1) -> list[str]:
    """Invented texts of every form, with values that are secrets and values that are not."""
    values = ["hunter2!", "P@ssw0rd", "s3cr3t#9", "Tr0ub4dor&3", "aB3dE6gH9jK2", "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLE", "9f86d081884c7d659a2feaa0c55ad015", "x7.Qz-4_Lm"]
    other = ["please", "required", "${DB_PASS}", "os.getenv(NAME1)", "<your_key_1>", "changeme", "****", "settings.v2[0]"]
    named = ["PASSWORD={}\nPORT=80", "export API_KEY={}\n", "https://a.example.com/x?access_token={}&page=2", "secret: {} and", 'auth_token = "{}"', "'passwd': '{}',", "Authorization: Bearer {}\n", "postgres://user:{}@db.example.com/x"]
    plain = ["path {} and", "commit={}\n", "https://a.example.com/x?page_id={}&b=2", 'file = "{}"', "host:{}@"]
    phrases = ["correct horse battery", "open the old gate", "blue river stone"]
    texts_ = [form.format(v) for form in named for v in values + other] + [form.format(v) for form in plain for v in values]
    texts_ += [f'{name} = "{v}"' for name in ("password", "DB_PASSWORD", "passphrase") for v in phrases] + [f'title = "{v}"' for v in phrases]
    rng = random.Random(seed)
    alnum, upper, hexa, wide = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "_-"
    for _ in range(12):
        token = lambda letters, size: _drawn(rng, letters, size)
        issued = [
            "AKIA" + token(upper, 16), "ASIA" + token(upper, 16), "ghp_" + token(alnum, 36), "gho_" + token(alnum, 36), "github_pat_" + token(alnum, 22) + "_" + token(alnum, 59),
            "glpat-" + token(wide, 20), f"xoxb-{token(string.digits, 11)}-{token(string.digits, 12)}-{token(alnum, 24)}", "sk_live_" + token(alnum, 24), "rk_test_" + token(alnum, 28),
            "AIza" + token(wide, 35), "ya29." + token(wide, 60), "SG." + token(wide, 22) + "." + token(wide, 43), "npm_" + token(alnum, 36),
            "eyJ" + token(alnum, 17) + ".eyJ" + token(alnum, 60) + "." + token(wide, 43),
        ]
        beside = [
            token(hexa, 32), token(hexa, 40), token(hexa, 64), str(uuid.UUID(int=rng.getrandbits(128))), token(string.digits, 20), "src/main/java/" + token(string.ascii_lowercase, 8) + "/Foo.java12",
            "AKIA-" + "-".join(token(string.ascii_lowercase, 6) for _ in range(3)), "ghp_" + token(string.ascii_lowercase, 14), "sk_live_documentation_page_" + token(string.digits, 2), "eyJ" + token(string.ascii_lowercase, 15),
            "xoxb-" + token(string.ascii_lowercase, 14), "npm_install_" + token(string.ascii_lowercase, 9), token(string.ascii_lowercase, 26), "v1.2.3-rc4+build." + token(string.digits, 4), "https://example.com/a/" + token(alnum, 11),
        ]
        texts_ += [f"{a} {v} {b}" for v in issued + beside for a, b in (("of the", "and on"), ("(", ")"))]
        texts_ += [f'id = "{v}"\n' for v in issued + beside]
        lines = "\n".join(token(alnum + "+/", 64) for _ in range(rng.randrange(2, 6)))
        texts_ += [f"a\n-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----\nb" for kind in ("", "RSA ", "OPENSSH ")]
        texts_.append(f"a\n-----BEGIN CERTIFICATE-----\n{lines}\n-----END CERTIFICATE-----\nb")
    return texts_


def train_secrets(findings: DataFrame, words: list[str], spec: SecretSpec = SecretSpec()):
    """A forest from labelled findings; None if they are all of one label."""
    rows = findings.where("said is not null and label in (0, 1)")
    n = rows.count()
    if not n:
        return None
    drawn = rows.sample(fraction=min(1.0, spec.sample / n), seed=spec.seed).withColumn("m", F.struct("said", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right")))
    described = stage(drawn.select(F.col("label").cast("double").alias("label"), *[c.alias(name) for name, c in zip(FEATURES, features(F.col("m"), words))]), "findings")
    if described.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described).select("features", "label")
    return RandomForestClassifier(numTrees=spec.trees, maxDepth=spec.depth, seed=spec.seed).fit(vectors)


def secrets(docs: DataFrame, forest, words: list[str], spec: SecretSpec = SecretSpec()) -> DataFrame:
    """``(doc_id, start, end, said, score, is_secret)``: every candidate of every text with the share of trees that hold it a
    secret (0 without a forest). Null and empty texts have no candidate; repeated rows give repeated rows; other columns are not read."""
    rows = candidate_rows(texts(docs))
    score = let(F.array(*features(F.col("m"), words)), lambda f: vote_share(forest, lambda k: F.get(f, F.lit(k)))) if forest else F.lit(0.0)
    return rows.withColumn("score", score).select("doc_id", "m.start", "m.end", "m.said", "score", (F.col("score") >= spec.threshold).alias("is_secret"))
