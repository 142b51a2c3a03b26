"""Scans as a stream: rows gather until their scan ends, then the scan is stored."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.state import RETENTION_DAYS, ScanStore
from ..plans.tables import drop, exists


def store_scans(events: DataFrame, health: DataFrame | None, store: ScanStore, checkpoint: str) -> StreamingQuery:
    """Stores every scan of a stream of events (with scan_id and scanned_at) until the input is used up.

    A row whose id is null ends its scan; until then the scan's rows, of however many
    batches, wait beside the checkpoint.  Scans that end in one batch are stored in
    order of their times.  Stored scans are kept in the state by their ids, in the
    commit of the scan itself, so a batch that runs again stores nothing twice.
    """
    waiting = f"{checkpoint.rstrip('/')}/waiting"

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("scan_id").parquet(f"{waiting}/batch={number:09d}")
        shape = batch.schema
        ended = batch.filter("id IS NULL").select("scan_id", "scanned_at").distinct().orderBy("scanned_at", "scan_id").collect()
        for scan_id, at in ended:
            if scan_id not in store.pointer()["scans"]:
                rows = spark.read.schema(shape).parquet(waiting).filter((F.col("scan_id") == scan_id) & F.col("id").isNotNull())
                found = store.table("health").limit(0) if health is None else health.filter(F.col("scan_id") == scan_id).drop("scan_id")
                store.store_scan(rows.select([c for c in batch.columns if c not in ("scan_id", "scanned_at")]), found, at, scan_id)
        for scan_id, _ in ended:
            for n in range(number + 1):
                at = f"{waiting}/batch={n:09d}/scan_id={scan_id}"
                if exists(spark, at):
                    drop(spark, at)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(sightings: DataFrame, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """id, first_seen_at, last_seen_at and sightings of each id by a stream of (id, seen_at).

    An id that comes back within the retention keeps its first time; later it is new.
    What is kept of an id goes when the stream is past its last sighting by twice the
    retention; sightings that are late by more than the retention are left out.
    """
    span = datetime.timedelta(days=retention_days)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for f in frames for t in f["seen_at"])
        first, last, n = state.get if state.exists else (None, None, 0)
        for t in times:
            if last is None or t - last > span:
                first, n = t, 0
            last, n = t if last is None else max(last, t), n + 1
        state.update((first, last, n))
        # Times without a zone count as UTC; a timeout may not lie before the watermark.
        state.setTimeoutTimestamp(max(pd.Timestamp(last + span).value // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [key[0]], "first_seen_at": [first], "last_seen_at": [last], "sightings": [n]})

    shape = "id string, first_seen_at timestamp, last_seen_at timestamp, sightings long"
    timed = sightings.withWatermark("seen_at", f"{int(span.total_seconds())} seconds")
    return timed.groupBy("id").applyInPandasWithState(update, shape, "first timestamp, last timestamp, n long", "update", GroupStateTimeout.EventTimeTimeout)
