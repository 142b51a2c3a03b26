"""A training-data pipeline: each stage keeps, changes or packs all that its predecessor kept.

Every stage takes documents (any columns, doc_id and text among them) and gives
back the same columns; the last one gives pieces of packed sequences with their
token ids.  Stages hand over Parquet files, so a lost executor costs a stage at most.

All stages take texts of any length whole, tables without rows (and give none), and
further columns of any name.  Rows with null or repeated ids are rows of their own,
but for near duplicates and packing, as told there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convoke.llm.decontaminate import drop_contaminated
from convoke.llm.nearcopies import drop_near_copies
from convoke.llm.packing import pack
from convoke.llm.quality import keep_good
from convoke.llm.secrets import redact
from convoke.plans.tables import shared, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't reject.

    A null or empty text scores the classifier's bias alone; without labels all stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more): the one with the smallest doc_id.

    Null, empty and blank texts are copies of each other.  Of rows with one id, or none, one
    row of the group stays (null ids last).
    """
    return drop_near_copies(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null and empty texts have none and stay; without benchmark items all stay.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; where secrets overlap, the first one stands for all.

    Null texts stay null; n_chars, if there, follows the text.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences; a null or empty text is its end alone.

    doc_id comes along as it is, so rows with one id give pieces of one id.
    """
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("secrets", secrets),
    ("packing", packing),
]
#: A trained classifier, fuzzy links and a tokenizer decide rows: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), shared(spark))
    return docs
