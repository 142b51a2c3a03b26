"""Health of sources: what a fetch's outcome means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source status by kind of fetch error.
STATUS_BY_ERROR = {
    "timeout": "timeout", "http_status": "http_error", "too_large": "http_error", "redirect": "http_error", "network": "http_error",
    "robots_denied": "robots_denied", "budget_exhausted": "budget_exhausted", "parse": "parse_error",
}
BACKOFF_MS = 500


def error_status(kind: Column) -> Column:
    """The source status of a fetch error."""
    found = F.lit(None).cast("string")
    for k, v in STATUS_BY_ERROR.items():
        found = F.when(kind == k, v).otherwise(found)
    return found


def retries(status: Column) -> Column:
    """Whether an answer's status is worth another try."""
    return status.isin(408, 429) | status.between(500, 599)


def backoff_ms(attempt: Column, remaining_ms: Column) -> Column:
    """The pause before the next try, doubling, within the time that is left."""
    return F.least((F.lit(BACKOFF_MS) * F.pow(F.lit(2), attempt - 1)).cast("long"), remaining_ms)


def source_status(stubs: Column, enriched: Column, failed: Column, parse_failed: Column, cut: Column) -> Column:
    """ok, partial or parse_error from a source's counts."""
    return F.when((stubs > 0) & (enriched == 0) & (parse_failed == failed) & (failed > 0), "parse_error").when((failed > 0) | cut, "partial").otherwise("ok")


def with_missing(sources: DataFrame, results: DataFrame) -> DataFrame:
    """A health row for every source, in order of ids; one whose task gave none is a parse error."""
    rows = sources.select(F.col("id").alias("source")).join(results, "source", "left")
    lost = F.col("status").isNull()
    return rows.withColumn("message", F.when(lost, "no result").otherwise(F.col("message"))).withColumn("status", F.coalesce("status", F.lit("parse_error"))).fillna(0, ["duration_ms", "requests", "events"]).orderBy("source")


def usable(health: DataFrame) -> bool:
    """Whether any source is ok or partial."""
    return bool(health.agg(F.bool_or(F.col("status").isin("ok", "partial"))).first()[0])


def healthy_share(health: DataFrame) -> DataFrame:
    """total, healthy and their ratio."""
    good = F.col("status").isin("ok", "partial").cast("int")
    return health.agg(F.count("*").alias("total"), F.sum(good).alias("healthy"), F.avg(good).alias("ratio"))
