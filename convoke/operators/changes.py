"""What changed between two scans, as a full outer join by event id."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CHANGE_KINDS


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def talk_ids(talks: Column) -> Column:
    return F.coalesce(F.transform(talks, lambda t: t["id"]), F.array().cast("array<string>"))


def people_keys(people: Column) -> Column:
    return F.coalesce(F.transform(people, lambda p: F.concat_ws("\x1f", p["canonical_name"], p["role"])), F.array().cast("array<string>"))


def speakers(people: Column, talks: Column) -> Column:
    """Names of an event's speakers, then of its talks', first places only."""
    own = F.transform(F.filter(people, lambda p: p["role"] == "speaker"), lambda p: p["canonical_name"])
    theirs = F.flatten(F.transform(talks, lambda t: F.transform(t["speaker"], lambda s: s["canonical_name"])))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(own, none), F.coalesce(theirs, none)))


def is_updated(prev: Column, curr: Column) -> Column:
    """Whether what an event says changed; how its date was written doesn't count."""
    differs = lambda a, b: ~a.eqNullSafe(b)
    date = lambda e: F.struct(e["date"]["start"], e["date"]["end"], e["date"]["timezone"])
    return (
        differs(prev["title"], curr["title"])
        | differs(date(prev), date(curr))
        | differs(prev["location"], curr["location"])
        | differs(prev["description"], curr["description"])
        | differs(_set(talk_ids(prev["talks"])), _set(talk_ids(curr["talks"])))
        | differs(_set(people_keys(prev["people"])), _set(people_keys(curr["people"])))
    )


def detect_changes(previous: DataFrame, current: DataFrame, now: datetime.datetime) -> DataFrame:
    """event_id, kind, detected_at, detail and ord, the place within an event."""
    need = ["id", "title", "date", "location", "description", "talks", "people", "media"]
    p = previous.select("id", F.struct(*need).alias("p"))
    c = current.select("id", F.struct(*need).alias("c"))
    both = p.join(c, "id", "full_outer")
    prev, curr = F.col("p"), F.col("c")
    stays = prev.isNotNull() & curr.isNotNull()

    def one(kind: str, when: Column) -> Column:
        return F.when(when, F.array(F.struct(F.lit(CHANGE_KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("detail")))).otherwise(none)

    def many(kind: str, details: Column) -> Column:
        made = F.transform(details, lambda d: F.struct(F.lit(CHANGE_KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), d.alias("detail")))
        return F.coalesce(F.when(stays, made), none)

    none = F.array().cast("array<struct<k:int,kind:string,detail:string>>")
    urls = lambda m: F.coalesce(F.transform(m, lambda x: x["url"]), F.array().cast("array<string>"))
    new_media = F.filter(curr["media"], lambda m: ~F.array_contains(urls(prev["media"]), m["url"]))
    pick = lambda live: F.transform(F.filter(new_media, lambda m: (m["media_type"] == "livestream") == F.lit(live)), lambda m: m["url"])
    old_talks, old_names = talk_ids(prev["talks"]), speakers(prev["people"], prev["talks"])
    found = F.concat(
        one("event_added", prev.isNull()),
        one("event_cancelled", curr.isNull()),
        one("event_updated", stays & is_updated(prev, curr)),
        many("schedule_added", F.filter(talk_ids(curr["talks"]), lambda t: ~F.array_contains(old_talks, t))),
        many("speaker_added", F.filter(speakers(curr["people"], curr["talks"]), lambda s: ~F.array_contains(old_names, s))),
        many("livestream_added", pick(True)),
        many("media_added", pick(False)),
        many("media_removed", F.filter(urls(prev["media"]), lambda u: ~F.array_contains(urls(curr["media"]), u))),
    )
    rows = both.select("id", F.posexplode(found).alias("ord", "x"))
    return rows.select(F.col("id").alias("event_id"), "x.kind", F.lit(now).cast("timestamp").alias("detected_at"), "x.detail", F.col("x.k").alias("kind_ord"), "ord")


def in_order(changes: DataFrame) -> DataFrame:
    """Changes by event, kind and detail order."""
    return changes.orderBy("event_id", "kind_ord", "ord").select("event_id", "kind", "detected_at", "detail")
