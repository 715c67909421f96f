"""A corpus pipeline: rules, language, near duplicates, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes each stage's result as
Parquet in the shared folder and hands the re-read table to the next stage; all but the last
return the columns of ``documents``. A stage works on every document that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm import jaccard, langid, packing, quality, suffix
from itemforge.llm.queries import table
from itemforge.llm.shared import ship, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document's language must have at least this mean marginal.
SURE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail the base rules or the log ratio.

    Null and empty texts have too few words and go; every row is judged by itself, so equal rows and
    null ids share a verdict; an empty table stays empty; columns beyond those of documents are left out.
    """
    verdict = quality.quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return verdict.where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a language (no letters, or no language above ``SURE``).

    Null and empty texts and texts without a letter go; between equal languages the first by name counts;
    without a labelled row every document goes; null ids and equal rows are judged each by itself.
    """
    ship(spark)
    found = langid.identify(docs, keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest id.

    Null ids count as larger than all others; of rows with one id the text with the smaller hash stays,
    of rows equal in both one. Documents without a word are near nothing and stay, equal ones once.
    """
    ship(spark)
    return jaccard.drop_near_duplicates(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every string of 200 bytes that also starts elsewhere; a text left without a word goes.

    A cut may part a character; what is left of it becomes U+FFFD. Null, empty and blank texts go too; equal
    rows are copies of each other and lose what is long enough; null ids do not matter.
    """
    ship(spark)
    cut = suffix.drop_repeated_bytes(docs, keep=COLUMNS)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    out = cut.select("doc_id", text.alias("text"), "lang", "source", F.col("n_chars").alias("before"), "n_removed")
    out = out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") == 0, F.col("before")).otherwise(F.char_length("text")).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of power-of-two length.

    Null and empty texts are the end id alone; equal rows and null ids are packed each on its own; no rows
    give no sequences.
    """
    ship(spark)
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packing_stage),
]

#: Training and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
