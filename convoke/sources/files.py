"""Collected documents and registries from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENT, schema

COLUMNS = DOCUMENT + ", error string"


def documents(frame: DataFrame) -> DataFrame:
    """Rows with all columns of documents: what is missing is null, final_url is url, and text bodies become bytes."""
    rows = frame
    if "final_url" not in rows.columns and "url" in rows.columns:
        rows = rows.withColumn("final_url", F.col("url"))
    wanted = schema(COLUMNS).fields
    return rows.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from Parquet, or from JSON lines if the path ends so."""
    if path.rstrip("/").endswith((".json", ".jsonl", ".ndjson")):
        return documents(spark.read.json(path))
    return documents(spark.read.parquet(path))


def read_folder(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Documents from files: ``index`` has file (its name), source, url and content_type."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("body"), F.col("modificationTime").alias("fetched_at"))
    return documents(files.join(index, "file").withColumn("status", F.lit(200)))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, from any file system that Spark reaches."""
    rows = spark.read.text(path, wholetext=True).collect()
    return "".join(r[0] for r in rows)
