"""The stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and decides over all rows of ``docs``.

All stages but the last return the columns of ``docs`` as they came, whatever their names; an empty table stays empty.
Repeated rows are decided alike (near-duplicates keep one), and texts of any length are read whole.
"""

from pyspark.sql import functions as F

from pairtide.llm.decontaminate import without_leaks
from pairtide.llm.language import identify, train_language
from pairtide.llm.near_dups import without_near_dups
from pairtide.llm.packing import pack, pieces
from pairtide.llm.pii import redact, train_pii
from pairtide.llm.tables import fresh, read

#: A text goes if no language reaches this chance; an even guess among the four languages here has 0.25.
LEAST_CHANCE = 0.3


def named(docs):
    """The columns of ``docs`` by name, dots and blanks in a name included."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark, docs, sf_dir):
    """Documents whose language is known: those without a letter or of no clear language go, null and empty texts among them."""
    said, chance = fresh(docs.columns, "_language", "_chance")
    told = identify(docs, train_language(docs), names=(said, chance))
    return told.where((F.col(said) != "und") & (F.col(chance) >= LEAST_CHANCE)).select(*named(docs))


def near_duplicates(spark, docs, sf_dir):
    """The document of the smallest id of each near-duplicate group (five-word shingles, similarity 0.8); null and empty texts stay."""
    return without_near_dups(docs).select(*named(docs))


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item; null and empty texts and rows without an id stay."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark")).select(*named(docs))


def personal_data(spark, docs, sf_dir):
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text. Null and empty texts stay as they are."""
    clean = redact(docs, train_pii(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*named(docs))


def packing(spark, docs, sf_dir):
    """Where each piece of each document stands in the packed sequences; a null or empty text is its closing token alone."""
    return pack(pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
