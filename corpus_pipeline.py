"""From raw documents to token ids: quality, line dedup, near-dedup, decontamination, encoding.

Every stage takes any rows: null or empty texts, null and repeated ids, very
long texts, repeated rows, an empty table, and extra columns, whatever their
names, which come back untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linededup, neardup, pieces, quality
from tessera.llm._store import live, materialise, release, sweep, table


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with other names for columns that a stage only hands on, so that they can't meet an operator's own."""
    return docs.toDF(*(c if c in used else f"_c{k}" for k, c in enumerate(docs.columns)))


def _together(found: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, from a frame made of ``_apart(docs, *used)``."""
    return found.select(*_apart(docs, *used).columns).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text is rejected; a null language is one of its own; a
    text just at a bound stays; repeated rows go or stay together.
    """
    used = ("text", "lang")
    return _together(quality.assess(_apart(docs, *used), with_text=True).where("kept"), docs, *used)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay only in the largest document that holds them; n_chars follows the text.

    A null text becomes an empty one; rows of null id lose nothing; rows that
    share an id are one document.
    """
    used = ("doc_id", "text", "n_chars")
    found = linededup.keep_bitmaps(_apart(docs, *used), with_input=True).withColumn("text", linededup.kept_text("text", "keep_bitmap"))
    return _together(found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs, *used)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id.

    Rows of null id or null text are in no class and stay; rows that share the
    id that stays all stay.
    """
    gone = neardup.classes(spark, docs.select("doc_id", "text")).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = _apart(docs, "doc_id")
    return _together(rows.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"), docs, "doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a null or empty text holds none."""
    found = decontam.find_items(spark, _apart(docs, "text"), table(spark, sf_dir, "benchmark"), with_text=True)
    return _together(found.where("not contaminated"), docs, "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as ids of the public piece vocabulary, in place of the column ``text``.

    A null text has null ids. Columns of the input called n_tokens, ids or
    round_trip are replaced by the operator's.
    """
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Hashed signatures, edit distances and vocabularies are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what a stage read and made on its way goes once it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, there = docs, live()
        docs = materialise(spark, stage(spark, before, sf_dir), name)
        sweep(spark, there, docs)
        release(before)
    return docs
