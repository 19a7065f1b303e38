"""Corpus pipeline: the training-data stages over ``documents``, in order.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are
written as Parquet and read again as the next stage's documents.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.catalog import tokenizer_path
from pagewright.llm.decontam import find_leaks
from pagewright.llm.langid import UNKNOWN, fit, identify
from pagewright.llm.packing import pack
from pagewright.llm.pii import find_personal_data, redacted
from pagewright.llm.pii import fit as pii_fit
from pagewright.llm.probminhash import near_duplicates
from pagewright.llm.rows import numbered
from pagewright.session import scratch_path
from pagewright.sources import folders
from pagewright.sources.tables import read_table

MIN_SCORE = 0.5  # of the likeliest language
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language: those predicted ``und`` (a null
    text, no letter) go, and those of which no language is likelier than all
    others together.  The context trees are fitted on this stage's input; rows
    without an id are judged like others, repeated rows alike."""
    found = identify(docs, fit(docs), carry=("text", "lang", "source", "n_chars"))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class: the smallest id, a null id
    only if the class has no other.  Rows are told apart by a key of their own,
    so rows without an id and different texts under one id are compared too."""
    rows = numbered(docs, COLUMNS)
    classes = near_duplicates(rows, "row").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keep = classes.groupBy("class_id").agg(first.alias("first")).select("first.row")
    return rows.join(keep, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.  Rows are told apart by a
    number of their own: a row without an id is judged by its text, and so is
    each of the rows that share an id.  Null and empty texts hold no item;
    repeated rows go or stay together; an empty table stays empty."""
    rows = numbered(docs, COLUMNS)
    leaks = find_leaks(rows, read_table(spark, sf_dir, "benchmark"), "row").select("row").distinct()
    return rows.join(leaks, "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; every row stays, also one
    without an id, and a null text stays null.  An empty table stays empty."""
    rows = docs.select(*COLUMNS)
    found = find_personal_data(rows, pii_fit(rows))
    clean = found.withColumn("text", redacted("text", "found"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rows that are left into training sequences, each for itself;
    a null or empty text has its end token only.  An empty table gives none."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again; what a
    stage has left is deleted when the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folders.delete(spark, before)
        before = path
    return docs
