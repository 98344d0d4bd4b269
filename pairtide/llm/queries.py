"""The queries of this subpackage by name; each applies one operator to its whole table."""

from pyspark.sql import functions as F

from pairtide.llm.decontaminate import leaks
from pairtide.llm.infill import infill, restored
from pairtide.llm.language import identify, train_language
from pairtide.llm.licenses import license_scan
from pairtide.llm.lloyd import lloyd, with_inertia
from pairtide.llm.mixing import mix, taken
from pairtide.llm.near_dups import NearDupSpec, near_dups
from pairtide.llm.nearest import nearest
from pairtide.llm.oracle import ORACLE  # noqa: F401
from pairtide.llm.packing import pack, pieces
from pairtide.llm.pii import personal_spans, train_pii, written
from pairtide.llm.quality import quality
from pairtide.llm.repeats import remove_repeats
from pairtide.llm.secrets import dictionary, known_findings, secrets, train_secrets
from pairtide.llm.tables import read, split_of


def op1_secret_scan(spark, sf_dir):
    """Candidates with their verdict. The value itself is not shown, only its hash."""
    docs = read(spark, sf_dir, "documents")
    words = dictionary(docs)
    found = secrets(docs, train_secrets(known_findings(docs), words), words)
    return found.select("doc_id", "start", "end", F.sha2(F.col("said").cast("binary"), 256).alias("said_sha256"), "score", "is_secret")


def op2_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = personal_spans(docs, train_pii(docs))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def op3_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    fold = split_of("doc_id", 5)
    net = train_language(docs.where(fold != 0))
    return identify(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), net).drop("text")


def op4_quality_classifier(spark, sf_dir):
    fold = split_of("doc_id", 3)
    found = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn=fold != 1)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_benchmark_decontamination(spark, sf_dir):
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_dups(read(spark, sf_dir, "documents"), NearDupSpec(shingle=4)).drop("mark")


def op7_substring_dedup(spark, sf_dir):
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_license_scan(spark, sf_dir):
    return license_scan(read(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_best_fit_packing(spark, sf_dir):
    cut = pieces(read(spark, sf_dir, "documents"))
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op11_source_mixing(spark, sf_dir):
    return taken(mix(read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op12_fill_in_middle(spark, sf_dir):
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return infill(read(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_centroid_clustering(spark, sf_dir):
    return with_inertia(*lloyd(read(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_source_mixing": op11_source_mixing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_centroid_clustering": op13_centroid_clustering,
}
