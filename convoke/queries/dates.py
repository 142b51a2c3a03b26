"""Dates in many forms, windows and modes."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..sources import adapters as A
from . import query, table

_FORMS = [
    ("yyyy-MM-dd", "", "day"), ("yyyy-MM-dd'T'HH:mm:ss", "", "day"), ("MMMM d, yyyy", "", "day"), ("d MMM yyyy", "", "day"),
    ("yyyy-MM-dd", "/", "range"), ("MMMM d, yyyy", " - ", "range"), ("d MMMM yyyy", " to ", "range"), ("yyyy-MM-dd", " ", "range"),
]


def _written(day: Column, key: Column) -> Column:
    """A day, or it and three days later, in one of the forms."""
    out = F.lit("TBD")
    for k, (form, joint, _) in enumerate(_FORMS):
        text = F.date_format(day, form)
        if joint:
            text = F.concat(text, F.lit(joint), F.date_format(F.date_add(day, 3), form))
        out = F.when(key % (len(_FORMS) + 1) == k, text).otherwise(out)
    return out


@query("date_parse_formats", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 8 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS first,
  CASE WHEN o_orderkey % 9 BETWEEN 4 AND 7 THEN CAST(CAST(o_orderdate AS DATE) + 3 AS VARCHAR) END AS last,
  CASE WHEN o_orderkey % 9 < 4 THEN 'day' WHEN o_orderkey % 9 < 8 THEN 'range' ELSE 'unknown' END AS precision FROM orders
""")
def date_parse_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _written(F.to_date("o_orderdate"), F.col("o_orderkey")).alias("t"))
    d = D.parse_date(F.col("t"))
    return rows.select("o_orderkey", d["start"].cast("string").alias("first"), d["end"].cast("string").alias("last"), d["precision"].alias("precision"))


@query("date_yearless_rollover", """
SELECT o_orderkey, CAST(CASE WHEN make_date(1998, month(d), day(d)) >= DATE '1998-06-15' THEN make_date(1998, month(d), day(d)) ELSE make_date(1999, month(d), day(d)) END AS VARCHAR) AS first
FROM (SELECT o_orderkey, CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN DATE '1998-02-28' ELSE CAST(o_orderdate AS DATE) END AS d FROM orders)
""")
def date_yearless_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    shown = F.when(F.date_format(day, "MM-dd") == "02-29", F.lit("Feb 28")).otherwise(F.date_format(day, "MMM d"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("t"))
    d = D.parse_date_with_reference(F.col("t"), F.lit(datetime.date(1998, 6, 15)))
    return rows.select("o_orderkey", d["start"].cast("string").alias("first"))


@query("date_year_crossing", """
SELECT s_suppkey, CAST(DATE '2026-12-01' + CAST(s_suppkey % 31 AS INT) AS VARCHAR) AS first, CAST(DATE '2027-01-01' + CAST(s_suppkey % 28 AS INT) AS VARCHAR) AS last FROM supplier
""")
def date_year_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from December to January without a year."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Dec "), (k % 31 + 1).cast("string"), F.lit(" – January "), (k % 28 + 1).cast("string")).alias("t"))
    d = D.parse_date(F.col("t"), F.lit(2026))
    return rows.select("s_suppkey", d["start"].cast("string").alias("first"), d["end"].cast("string").alias("last"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the dates of their shipping: the first, and up to ten days after it; none without lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("ship"), F.count("*").alias("lines"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", "first", F.least("ship", F.date_add("first", 10)).alias("last"), F.coalesce("lines", F.lit(0)).alias("lines"))


_DATED = "(SELECT o_orderkey, first, CASE WHEN ship > first + 10 THEN first + 10 ELSE ship END AS last, coalesce(lines, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS ship, count(*) AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
_LOW, _HIGH = datetime.date(1998, 5, 16), datetime.date(1998, 12, 12)
_IN = "(first IS NULL OR (first <= DATE '1998-12-12' AND last >= DATE '1998-05-16'))"


@query("interval_overlap", f"SELECT o_orderkey, {_IN} AS meets FROM {_DATED}")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", D.interval_overlap(F.col("first"), F.col("last"), F.lit(_LOW), F.lit(_HIGH)).alias("meets"))


def _mode(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        low, high = D.window_bounds(datetime.date(1998, 6, 15), 30, 180)
        inside = D.interval_overlap(F.col("first"), F.col("last"), F.lit(low), F.lit(high))
        return _dated(spark, sf_dir).filter(D.selected(F.col("first").isNotNull(), F.col("lines") % 2 == 0, inside, mode)).select("o_orderkey")

    return run


query("window_upcoming", f"SELECT o_orderkey FROM {_DATED} WHERE first IS NOT NULL AND {_IN}")(_mode("upcoming"))
query("window_recordings", f"SELECT o_orderkey FROM {_DATED} WHERE lines % 2 = 0 AND (first IS NULL OR {_IN})")(_mode("recordings"))
query("window_both", f"SELECT o_orderkey FROM {_DATED} WHERE (first IS NOT NULL AND {_IN}) OR (lines % 2 = 0 AND first IS NULL)")(_mode("both"))


@query("calendar_ranges", """
SELECT o_orderkey, CAST(d AS VARCHAR) AS first, CAST(CASE o_orderkey % 4 WHEN 0 THEN d + 2 WHEN 1 THEN d + 3 WHEN 2 THEN d + 9 END AS VARCHAR) AS last
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def calendar_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar starts with an exclusive date, a time, a duration or no end."""
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(day, "yyyyMMdd").alias("s"), F.when(kind == 0, F.date_format(F.date_add(day, 3), "yyyyMMdd")).when(kind == 1, F.concat(F.date_format(F.date_add(day, 3), "yyyyMMdd"), F.lit("T120000Z"))).alias("e"), F.when(kind == 2, "P1W3D").when(kind == 3, "PT5H").alias("p"))
    d = A.calendar_range(F.col("s"), F.col("e"), F.col("p"))
    return rows.select("o_orderkey", d["start"].cast("string").alias("first"), d["end"].cast("string").alias("last"))
