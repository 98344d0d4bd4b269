"""The pipeline end to end: what goes, what stays, what changes."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairtide.llm import steps
from pairtide.session import stage

SMALL = "/root/testdata/sf0.001"


def test_stages_decide(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12 34 !!", "en", "s", 8), (90_003, docs.first().text, "fr", "s", 1)], docs.schema)
    mail = spark.createDataFrame([(90_004, docs.where("doc_id = 1").first().text + " a@b.example.com", "en", "s", 1)], docs.schema)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    leak = spark.createDataFrame([(90_005, item, "en", "s", 1)], docs.schema)
    now = docs.union(junk).union(mail).union(leak)
    seen = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, SMALL), name)
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert not {90_001, 90_002} & set(seen["language"]) and {90_003, 90_005} <= set(seen["language"])
    assert len(seen["language"]) >= docs.count()
    assert not {90_003, 90_004} & set(seen["near_duplicates"])  # copies of a smaller id
    assert 90_005 in seen["near_duplicates"] and 90_005 not in seen["decontamination"]
    assert set(seen["personal_data"]) == set(seen["decontamination"])
    assert not any(re.search(r"[\w.%+-]+@[\w-]+\.[\w-]+", t) for t in seen["personal_data"].values())
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(seen["personal_data"])


CLASHING = ("_language", "_chance", "_kept_id", "_kept_mark", "_id", "_mark", "_text", "_ask", "_bucket", "_own", "_rank", "_LANGUAGE_", "score", "a.b", "spans", "found", "piece")


def with_clashes(docs):
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    return docs


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_clashing_columns_pass_through(spark, name, step):
    """Columns named like the stage's own come out with the values they had."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    extra = step(spark, with_clashes(docs), SMALL)
    if name == "packing":
        assert extra.columns == step(spark, docs, SMALL).columns and extra.count() >= docs.count()
        return
    assert extra.columns == [*docs.columns, *CLASHING]
    rows = extra.collect()
    assert {r.doc_id for r in rows} <= set(range(60)) and len(rows) > 40
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING)


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_empty_and_awkward_tables(spark, name, step):
    """No row, and only null, empty, blank, very long and repeated texts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert step(spark, docs.where("false"), SMALL).count() == 0
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t "), (4, long), (4, long), (None, "text without an id"), (5, "text without an id")]
    odd = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], docs.schema)
    out = step(spark, odd, SMALL).collect()
    kept = {"language": 4, "near_duplicates": None, "decontamination": 7, "personal_data": 7}
    if name == "near_duplicates":
        assert sorted(r.doc_id for r in out if r.doc_id in (1, 2, 3, 4)) == [1, 2, 3, 4] and any(r.text == "text without an id" for r in out)
    elif name == "packing":
        assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and {r.doc_id for r in out} == {1, 2, 3, 4, 5, None}
    else:
        assert len(out) == kept[name]
        assert {r.text for r in out} <= {t for _, t in rows}


def test_personal_data_of_one_document(spark):
    """The stage learns from every document: the only one with personal data is found and redacted."""
    said = F.when(F.col("id") == 30_007, "my phone: 2435555526.").otherwise("plain words")
    docs = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("doc_id"), said.alias("text"))
    told = {r.text: r["count"] for r in steps.personal_data(spark, docs, None).groupBy("text").count().collect()}
    assert told == {"plain words": 59_999, "my phone: [PHONE].": 1}


def test_personal_data_is_learned_in_every_fold(spark):
    """Telephone numbers that all fall into one fold, which the threshold is judged on, are learned from and redacted."""
    assert all(zlib.crc32(f"{i}:5".encode()) % 4 == 0 for i in (0, 4, 8))
    docs = spark.createDataFrame([(i, "call 243 555 5526 of") for i in (0, 4, 8)], "doc_id long, text string")
    assert [r.text for r in steps.personal_data(spark, docs, None).collect()] == ["call [PHONE] of"] * 3
