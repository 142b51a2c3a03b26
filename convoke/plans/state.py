"""Stored scans: versioned events, tombstones, health and changes.

A commit writes its tables into a new folder and then creates the next version's
pointer file, ``CURRENT.<version>``, which must not exist: the file is written under
another name and renamed without overwriting.  Nothing that readers use is ever
deleted or replaced, so they see the old version or the new one, whole, and a
crash between any two steps leaves the old one.  Of two writers on one version
the second finds the file there and fails.  ``now`` is always given.

Events and tombstones are whole in each version.  Health and changes are logs: a
version adds a folder of its own rows, and its pointer lists the folders that
still hold rows within the retention; reads leave out what is older, and what a
later folder has again.  When there are more than ``LOGS`` folders they are
written as one.
"""

from __future__ import annotations

import datetime
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as G
from ..schemas import CHANGE, EVENT, HEALTH, schema
from .tables import drop, exists, names, put_once, read_text

SCHEMA_VERSION, RETENTION_DAYS, LOGS = 3, 90, 32
TABLES = {
    "events": EVENT,
    "tombstones": "id string, first_seen_at timestamp, cancelled_at timestamp",
    "health": HEALTH,
    "changes": CHANGE,
}
#: Tables that grow by rows, and what tells their rows apart.
LOG_KEYS = {"health": ["source", "recorded_at"], "changes": ["detected_at", "event_id", "kind", "detail"]}
LOG_TIMES = {"health": "recorded_at", "changes": "detected_at"}


class StateError(RuntimeError):
    """State that can't be read or written."""


class ScanStore:
    """The state under a folder, on a file system whose rename never overwrites (local folders get a link instead)."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False) -> None:
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        found = self.pointer()
        if found is None:
            if read_only:
                raise StateError("there is no state to read")
            self._point({"schema": SCHEMA_VERSION, "version": 0, "folder": None, "logs": {}, "scans": {}}, None)
        elif found["schema"] > SCHEMA_VERSION:
            raise StateError(f"state of schema {found['schema']} is newer than {SCHEMA_VERSION}")
        elif found["schema"] < SCHEMA_VERSION:
            if read_only:
                raise StateError(f"state of schema {found['schema']} needs a migration")
            self._migrate(found)

    # The pointer

    def _versions(self) -> list[int]:
        """Versions that have a pointer, in order."""
        return sorted(int(n[8:]) for n in names(self.spark, self.path) if n.startswith("CURRENT.") and n[8:].isdigit())

    def pointer(self) -> dict[str, Any] | None:
        """Schema, version, folder and logs of the newest version; None if there is no state."""
        known = self._versions()
        # Older states have one pointer without a number.
        name = f"CURRENT.{known[-1]}" if known else "CURRENT"
        return self._pointed(name) if known or exists(self.spark, f"{self.path}/{name}") else None

    def _pointed(self, name: str) -> dict[str, Any]:
        return {"logs": {}, "scans": {}} | json.loads(read_text(self.spark, f"{self.path}/{name}"))

    def _point(self, to: dict[str, Any], seen: dict[str, Any] | None) -> None:
        if self.pointer() != seen:
            raise StateError("another writer was faster")
        if not put_once(self.spark, f"{self.path}/CURRENT.{to['version']}", json.dumps(to)):
            raise StateError("another writer was faster")

    def schema_version(self) -> int:
        found = self.pointer()
        return found["schema"] if found else 0

    def _migrate(self, old: dict[str, Any]) -> None:
        """Rewrites an older state; columns that it lacks are null."""
        frames = {}
        for name, ddl in TABLES.items():
            have = self._read(old, name) if self._has(old, name) else self.spark.createDataFrame([], schema(ddl))
            frames[name] = have.select(*[(F.col(f.name).cast(f.dataType) if f.name in have.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(ddl).fields])
        if not frames["events"].filter("id IS NULL").isEmpty():
            raise StateError("a stored event has no id")
        self._commit(frames, old)

    def _has(self, pointer: dict[str, Any], name: str) -> bool:
        return bool(pointer["logs"].get(name)) or pointer["folder"] is not None and exists(self.spark, f"{self.path}/{pointer['folder']}/{name}")

    def _read(self, pointer: dict[str, Any], name: str) -> DataFrame:
        """A table as a version has it, whatever its columns."""
        return self.spark.read.parquet(*[f"{self.path}/{f}/{name}" for f in pointer["logs"].get(name, [pointer["folder"]])])

    def table(self, name: str) -> DataFrame:
        """One table of the current version; empty before the first commit."""
        return self._table(self.pointer(), name)

    def _table(self, now: dict[str, Any] | None, name: str) -> DataFrame:
        shape = schema(TABLES[name])
        if now is None or now["folder"] is None:
            return self.spark.createDataFrame([], shape)
        if name not in LOG_KEYS:
            return self.spark.read.schema(shape).parquet(f"{self.path}/{now['folder']}/{name}")
        folders = now["logs"].get(name, [now["folder"]])
        rows = None if folders else self.spark.createDataFrame([], shape)
        for k, f in enumerate(folders):
            own = self.spark.read.schema(shape).parquet(f"{self.path}/{f}/{name}").withColumn("_at", F.lit(k))
            rows = own if rows is None else rows.unionByName(own)
        if folders and now.get("cutoff"):
            rows = rows.filter(F.col(LOG_TIMES[name]) >= F.lit(now["cutoff"]).cast("timestamp"))
        if len(folders) > 1:
            last = F.max(F.struct("_at", *[c for c in shape.names if c not in LOG_KEYS[name]])).alias("_row")
            rows = rows.groupBy(*LOG_KEYS[name]).agg(last).select(*LOG_KEYS[name], "_row.*")
        return rows.select(shape.names)

    def _commit(self, frames: dict[str, DataFrame], seen: dict[str, Any], added: dict[str, DataFrame] | None = None, cutoff: datetime.datetime | None = None, scans: dict[str, str] | None = None) -> dict[str, Any]:
        """Writes a version: whole tables, and rows added to logs (or whole logs among the frames); its pointer."""
        if self.read_only:
            raise StateError("the state is open for reading only")
        version = seen["version"] + 1
        folder = f"v{version:09d}-{uuid.uuid4().hex[:12]}"
        logs = {}
        for name in LOG_KEYS:
            before = seen["logs"].get(name, [seen["folder"]] if seen["folder"] else [])
            if added is not None and name in added and len(before) >= LOGS:
                whole = self._table(seen | {"cutoff": str(cutoff) if cutoff else seen.get("cutoff")}, name)
                frames = frames | {name: _latest(whole, added[name], name)}
            logs[name] = [folder] if name in frames else [*before, folder] if added is not None and name in added else before
        for name, frame in (frames | {n: f for n, f in (added or {}).items() if n not in frames}).items():
            out = frame.select(*[f.name for f in schema(TABLES[name]).fields]).write.mode("overwrite")
            (out.partitionBy("source") if name == "health" else out).parquet(f"{self.path}/{folder}/{name}")
        to = {"schema": SCHEMA_VERSION, "version": version, "folder": folder, "logs": logs, "cutoff": str(cutoff) if cutoff else seen.get("cutoff"), "scans": seen["scans"] if scans is None else scans}
        self._point(to, seen)
        return to

    def vacuum(self, keep: int = 2) -> None:
        """Removes pointers but the newest ones', and folders that none of those uses."""
        known = self._versions()[-keep:]
        used: set[str] = set()
        for v in known:
            found = self._pointed(f"CURRENT.{v}")
            used |= {str(found["folder"])} | {f for own in found["logs"].values() for f in own}
        for name in names(self.spark, self.path):
            old = name.startswith("CURRENT.") and name[8:].isdigit() and int(name[8:]) not in known
            # A folder beyond the newest version may be a commit that is under way.
            if old or name[:1] == "v" and name[1:10].isdigit() and int(name[1:10]) <= (known or [0])[-1] and name not in used:
                drop(self.spark, f"{self.path}/{name}")

    # Reads

    def list_events(self) -> DataFrame:
        return self.table("events").orderBy("id")

    def get_event(self, event_id: str) -> DataFrame:
        return self.table("events").filter(F.col("id") == event_id)

    def list_health(self, source: str) -> DataFrame:
        return self.table("health").filter(F.col("source") == source).orderBy("recorded_at")

    def list_changes(self, since: datetime.datetime) -> DataFrame:
        return self.table("changes").filter(F.col("detected_at") >= F.lit(since)).orderBy("detected_at", "event_id", "kind", "detail")

    # Writes

    def store_event(self, event: DataFrame, now: datetime.datetime) -> None:
        """Puts single events in; first_seen_at stays as it was."""
        seen = self.pointer()
        old = self._table(seen, "events")
        first = old.select("id", F.col("first_seen_at").alias("_first"))
        new = event.join(first, "id", "left").withColumns({"first_seen_at": F.coalesce("_first", F.lit(now)), "last_seen_at": F.lit(now).cast("timestamp")}).drop("_first")
        rest = old.join(new.select("id"), "id", "left_anti")
        self._commit({"events": rest.unionByName(new.select(old.columns)), "tombstones": self._table(seen, "tombstones")}, seen)

    def store_scan(self, events: DataFrame, health: DataFrame, now: datetime.datetime, scan_id: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Stores a scan's events and health in one commit; the stored events and what changed.

        ``scan_id``, if given, is kept with the commit, for the retention.
        """
        if self.read_only:
            raise StateError("the state is open for reading only")
        seen = self.pointer()
        parts = additions(self._table(seen, "events"), self._table(seen, "tombstones"), events, health, now)
        logs = {n: parts.pop(n) for n in LOG_KEYS}
        cutoff = now - datetime.timedelta(days=RETENTION_DAYS)
        scans = {k: t for k, t in seen["scans"].items() if t >= cutoff.isoformat()} | ({scan_id: now.isoformat()} if scan_id is not None else {})
        to = self._commit(parts, seen, logs, cutoff, scans)
        stored = self._table(to, "events").join(events.select("id"), "id", "left_semi")
        return stored, self._table(to, "changes").filter(F.col("detected_at") == F.lit(now))


def _latest(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """A log with rows added: a new row takes the place of one with its keys."""
    return old.join(new.select(LOG_KEYS[name]), LOG_KEYS[name], "left_anti").unionByName(new.select(old.columns))


def authoritative(health: DataFrame) -> DataFrame:
    """One row, full: whether every source was ok (no sources count as ok)."""
    return health.agg(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("full"))


def living(tombstones: DataFrame, now: datetime.datetime) -> DataFrame:
    """Tombstones that are not older than the retention."""
    return tombstones.filter(F.col("cancelled_at") >= F.lit(now - datetime.timedelta(days=RETENTION_DAYS)))


def first_seen(events: DataFrame, previous: DataFrame, tombstones: DataFrame, now: datetime.datetime) -> DataFrame:
    """events with first_seen_at (as stored, else as before their cancellation, else now) and last_seen_at."""
    p = previous.select("id", F.col("first_seen_at").alias("_p"))
    t = living(tombstones, now).select("id", F.col("first_seen_at").alias("_t"))
    rows = events.join(p, "id", "left").join(t, "id", "left")
    return rows.withColumns({"first_seen_at": F.coalesce("_p", "_t", F.lit(now)), "last_seen_at": F.lit(now).cast("timestamp")}).drop("_p", "_t")


def additions(previous: DataFrame, tombstones: DataFrame, events: DataFrame, health: DataFrame, now: datetime.datetime) -> dict[str, DataFrame]:
    """events and tombstones after a scan, and the rows of health and changes that it adds.

    Unless every source was ok, absent events stay and are not cancelled.
    """
    full = F.broadcast(authoritative(health))
    found = G.detect_changes(previous, events, now).crossJoin(full).filter("full OR kind <> 'event_cancelled'")
    absent = previous.join(events.select("id"), "id", "left_anti").crossJoin(full)
    stored = first_seen(events, previous, tombstones, now).select(previous.columns)
    kept = absent.filter("NOT full").select(previous.columns)
    dead = absent.filter("full AND first_seen_at IS NOT NULL").select("id", "first_seen_at", F.lit(now).cast("timestamp").alias("cancelled_at"))
    old = living(tombstones, now).join(events.select("id"), "id", "left_anti").join(dead.select("id"), "id", "left_anti")
    return {
        "events": stored.unionByName(kept),
        "tombstones": old.unionByName(dead),
        "health": health.withColumn("recorded_at", F.coalesce("recorded_at", F.lit(now))).select([f.name for f in schema(HEALTH).fields]),
        "changes": found.select("event_id", "kind", "detected_at", F.translate("detail", "\x00", "").alias("detail")).distinct(),
    }


def bundle(previous: DataFrame, tombstones: DataFrame, old_health: DataFrame, log: DataFrame, events: DataFrame, health: DataFrame, now: datetime.datetime) -> dict[str, DataFrame]:
    """The four whole tables after a scan."""
    cutoff = F.lit(now - datetime.timedelta(days=RETENTION_DAYS))
    parts = additions(previous, tombstones, events, health, now)
    whole = {"health": _latest(old_health, parts["health"], "health"), "changes": _latest(log, parts["changes"], "changes")}
    return parts | {n: f.filter(F.col(LOG_TIMES[n]) >= cutoff) for n, f in whole.items()}
