"""Caps, budgets and order of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STUBS_PER_SOURCE, CANDIDATES, TALKS, PARTS = 2000, 10_000, 300, 64


def capped_stubs(stubs: DataFrame, most: int = STUBS_PER_SOURCE) -> DataFrame:
    """The first stubs of each source by stub_ord; ``cut`` tells that the source had more.

    Parts of a source are cut first, so that no task sorts all stubs of a large one.
    """
    part = F.pmod(F.xxhash64("stub_ord"), F.lit(PARTS))
    parts = Window.partitionBy("source", "_part").orderBy("stub_ord")
    rows = stubs.withColumn("_part", part).withColumn("_n", F.row_number().over(parts)).filter(F.col("_n") <= most + 1)
    own = Window.partitionBy("source").orderBy("stub_ord")
    rows = rows.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= most + 1).drop("_part")
    rows = rows.withColumn("cut", F.max("_n").over(Window.partitionBy("source")) > most)
    return rows.filter(F.col("_n") <= most).drop("_n")


def capped_candidates(events: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The first candidates by source and discovery order."""
    return events.orderBy("source", "stub_ord").limit(most)


def survivors(events: DataFrame) -> DataFrame:
    """Source evidence rows by source."""
    return events.select(F.explode("sources").alias("s")).groupBy(F.col("s.source_id").alias("source")).agg(F.count("*").alias("events"))


def recounted(health: DataFrame, kept: DataFrame) -> DataFrame:
    """Health with the survivors' numbers; a source that lost some is partial."""
    n = survivors(kept).withColumnRenamed("events", "_n")
    left = F.coalesce(F.col("_n"), F.lit(0)).cast("int")
    lost = (left < F.col("events")) & (F.col("status") == "ok")
    return health.join(n, "source", "left").withColumns({"status": F.when(lost, "partial").otherwise(F.col("status")), "events": left}).drop("_n")


def ranked(events: DataFrame) -> DataFrame:
    """Events from the highest score on, ties by id."""
    return events.orderBy(F.desc("score"), F.asc("id"))


def top_events(events: DataFrame, most: int | None) -> DataFrame:
    """The first events of the order."""
    return ranked(events) if most is None else ranked(events).limit(most)


def talk_budget(events: DataFrame, most: int = TALKS) -> DataFrame:
    """Events in order while the talks before them are below the budget; the crossing one is cut.

    With a budget of 0 all events stay, without talks.  The running total is over the
    first events with talks, of which no more than the budget can matter.
    """
    if most == 0:
        return events.withColumn("talks", F.slice("talks", 1, 0))
    n = F.coalesce(F.when(F.col("talks").isNotNull(), F.size("talks")), F.lit(0))
    talked = ranked(events.select("score", "id", n.alias("n")).filter("n > 0")).limit(most)
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score"), F.asc("id")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = talked.withColumn("before", before).filter((F.col("before") < most) & (F.col("before") + F.col("n") >= most))
    one = crossing.agg(F.first("score").alias("_score"), F.first("id").alias("_id"), F.first(F.lit(most) - F.col("before")).cast("int").alias("_left"))
    rows = events.crossJoin(F.broadcast(one))
    last = (F.col("score") == F.col("_score")) & (F.col("id") == F.col("_id"))
    early = F.col("_id").isNull() | (F.col("score") > F.col("_score")) | last | ((F.col("score") == F.col("_score")) & (F.col("id") < F.col("_id")))
    rows = rows.filter(F.coalesce(early, F.lit(False)))
    return rows.withColumn("talks", F.when(last, F.slice("talks", F.lit(1), F.col("_left"))).otherwise(F.col("talks"))).select(events.columns)
