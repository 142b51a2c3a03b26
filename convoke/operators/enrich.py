"""Matching of events against registries of topics and scholars.

A registry is small by nature and checked to be (``MOST`` surfaces); it enters
the plan as one literal array, so each event is matched where it is: no join, no
shuffle, no rows per pair.
"""

from __future__ import annotations

import unicodedata
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as X

MOST = 20_000
#: Surnames too common to count alone in running text.
AMBIGUOUS = ["li", "wang", "tao", "yau", "gross", "wei", "wu"]


def plain_name(name: str) -> str:
    """NFC, lower case, squeezed."""
    return " ".join(unicodedata.normalize("NFC", name).lower().split())


def _surfaces(records: list[dict[str, Any]], name: str) -> list[tuple[int, int, str, str]]:
    """Record, place (the canonical name is 0), surface and normalized surface of every name."""
    found = [(k, j, s, plain_name(s)) for k, r in enumerate(records) for j, s in enumerate([r[name], *r.get("aliases", [])])]
    if len(found) > MOST:
        raise ValueError(f"a registry of {len(found)} names is beyond {MOST}")
    return [x for x in found if x[3]]


def _literal(rows: list[Column], ddl: str) -> Column:
    return F.array(*rows).cast(f"array<{ddl}>")


def _found(text: Column, own: Column, loose: Column) -> Column:
    """Whether a surface occurs; loose ones anywhere, others as whole words."""
    pattern = F.concat(F.lit(r"(?<![\p{IsAlphabetic}\p{N}])\Q"), own, F.lit(r"\E(?![\p{IsAlphabetic}\p{N}])"))
    return text.contains(own) & (loose | F.regexp(text, pattern))


def merged_topics(known: Column, found: Column) -> Column:
    """Topics by id: the first place, and the strictly higher confidence."""

    def add(acc: Column, t: Column) -> Column:
        there = F.exists(acc, lambda x: x["topic_id"] == t["topic_id"])
        better = F.transform(acc, lambda x: F.when((x["topic_id"] == t["topic_id"]) & (t["confidence"] > x["confidence"]), t).otherwise(x))
        return F.when(there, better).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(found, known, add)


_TOPIC = "struct<topic_id:string,canonical_name:string,matched_text:string,confidence:float>"
_PERSON = "struct<canonical_name:string,matched_text:string,role:string,evidence:string,confidence:float,scholar_tags:array<string>>"


def topic_matches(normal: Column, topics: list[dict[str, Any]]) -> Column:
    """Topics that a normalized text names: the canonical name counts 1.0, the first alias 0.8."""
    rows = []
    for k, j, surface, own in _surfaces(topics, "name"):
        t = topics[k]
        rows.append(F.struct(F.lit(own).alias("own"), F.lit(not own.isascii() or " " in own).alias("loose"), F.struct(F.lit(t["id"]).alias("topic_id"), F.lit(t["name"]).alias("canonical_name"), F.lit(surface).alias("matched_text"), F.lit(1.0 if j == 0 else 0.8).cast("float").alias("confidence")).alias("topic")))
    none = F.array().cast(f"array<{_TOPIC}>")
    if not rows:
        return none
    known = _literal(rows, f"struct<own:string,loose:boolean,topic:{_TOPIC}>")
    hits = F.transform(F.filter(known, lambda c: _found(normal, c["own"], c["loose"])), lambda c: c["topic"])
    return F.coalesce(merged_topics(none, hits), none)


def scholar_matches(normal: Column, scholars: list[dict[str, Any]], context: str = "title", role: str = "speaker", words: Column | None = None) -> Column:
    """Scholars that a normalized text names, one hit each with the longest surface.

    Contexts: ``field`` gives the role with confidence 1, ``title`` and ``body``
    a title_mention with 0.5; in a body a lone common surname needs two words of the full name.
    """
    none = F.array().cast(f"array<{_PERSON}>")
    sure = context == "field"
    rows = []
    by_record: dict[int, list[tuple[int, str, str]]] = {}
    for k, j, surface, own in _surfaces(scholars, "canonical_name"):
        by_record.setdefault(k, []).append((j, surface, own))
    for k, names in by_record.items():
        s = scholars[k]
        surfaces = _literal([F.struct(F.lit(own).alias("own"), F.lit(any(c.isspace() for c in own) or not own.isascii()).alias("loose"), F.lit(len(surface.encode())).alias("size"), F.lit(j).alias("place"), F.lit(surface).alias("surface")) for j, surface, own in names], "struct<own:string,loose:boolean,size:int,place:int,surface:string>")
        tags = _literal([F.lit(t) for t in s.get("tags", [])], "string") if s.get("tags") else F.array().cast("array<string>")
        rows.append(F.struct(surfaces.alias("surfaces"), F.lit(s["canonical_name"]).alias("name"), F.array(*[F.lit(w) for w in plain_name(s["canonical_name"]).split()]).cast("array<string>").alias("words"), tags.alias("tags")))
    if not rows:
        return none
    known = _literal(rows, "struct<surfaces:array<struct<own:string,loose:boolean,size:int,place:int,surface:string>>,name:string,words:array<string>,tags:array<string>>")
    longest = lambda s: F.array_max(F.transform(F.filter(s["surfaces"], lambda c: _found(normal, c["own"], c["loose"])), lambda c: F.struct(c["size"], c["place"], c["surface"], c["own"])))
    hits = F.filter(F.transform(known, lambda s: F.struct(longest(s).alias("best"), s["name"].alias("name"), s["words"].alias("words"), s["tags"].alias("tags"))), lambda h: h["best"].isNotNull())
    if context == "body":
        told = words if words is not None else X.word_list(normal)
        hits = F.filter(hits, lambda h: ~h["best"]["own"].isin(AMBIGUOUS) | (F.size(F.filter(h["words"], lambda w: F.array_contains(told, w))) >= 2))
    person = lambda h: F.struct(h["name"].alias("canonical_name"), h["best"]["surface"].alias("matched_text"), F.lit(role if sure else "title_mention").alias("role"), F.lit(None).cast("string").alias("evidence"), F.lit(1.0 if sure else 0.5).cast("float").alias("confidence"), h["tags"].alias("scholar_tags")).cast(_PERSON)
    return F.coalesce(F.transform(hits, person), none)


def with_topics(events: DataFrame, topics: list[dict[str, Any]]) -> DataFrame:
    """Topics of titles, then of descriptions, merged into those that are there."""
    if not topics:
        return events
    title = events.withColumn("_t", X.normalize_name(F.col("title"))).withColumn("_d", X.normalize_name(F.coalesce("description", F.lit(""))))
    found = merged_topics(merged_topics(F.col("topics"), topic_matches(F.col("_t"), topics)), topic_matches(F.col("_d"), topics))
    return title.withColumn("topics", found).drop("_t", "_d")


def with_scholars(events: DataFrame, scholars: list[dict[str, Any]]) -> DataFrame:
    """Tags and canonical names of known people without tags; then scholars that only the title names."""
    if not scholars:
        return events
    rows = [F.struct(F.lit(own).alias("own"), F.lit(k).alias("k"), F.lit(scholars[k]["canonical_name"]).alias("name"), F.array(*[F.lit(t) for t in scholars[k].get("tags", [])]).cast("array<string>").alias("tags")) for k, _, _, own in _surfaces(scholars, "canonical_name")]
    known = _literal(rows, "struct<own:string,k:int,name:string,tags:array<string>>")

    own_names = F.create_map(*[F.lit(x) for s in scholars for x in (s["canonical_name"], plain_name(s["canonical_name"]))])

    def filled(p: Column, name: Column) -> Column:
        """A person and the normalized name, both as the registry has them where it fills in."""
        own = F.get(F.filter(known, lambda s: s["own"] == name), F.lit(0))
        new = F.struct(own["name"].alias("canonical_name"), p["matched_text"].alias("matched_text"), p["role"].alias("role"), p["evidence"].alias("evidence"), p["confidence"].alias("confidence"), own["tags"].alias("scholar_tags")).cast(_PERSON)
        stays = (F.size(p["scholar_tags"]) > 0) | own.isNull()
        return F.struct(F.when(stays, p).otherwise(new).alias("person"), F.when(stays, name).otherwise(F.element_at(own_names, own["name"])).alias("name"))

    # Names are composed once and outside of lambdas: those run in generated code, composition doesn't.
    events = events.withColumns({"_t": X.normalize_name(F.col("title")), "_n": X.normalize_names(F.transform("people", lambda p: p["canonical_name"]))})
    events = events.withColumns({"_z": F.zip_with("people", "_n", filled), "_h": scholar_matches(F.col("_t"), scholars)})
    names = F.transform("_z", lambda z: z["name"])
    new = F.zip_with("_h", F.array_repeat(names, F.size("_h")), lambda h, all_: F.when(~F.array_contains(all_, F.element_at(own_names, h["canonical_name"])), h))
    return events.withColumn("people", F.concat(F.transform("_z", lambda z: z["person"]), F.array_compact(new))).drop("_t", "_n", "_z", "_h")


def with_scores(events: DataFrame, tiers: dict[str, str], interests: dict[str, float] | None = None) -> DataFrame:
    """score, score_components and rank_reasons from tiers by source id and weights by topic id."""
    table = F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair]) if tiers else F.create_map().cast("map<string,string>")
    best = F.coalesce(F.array_max(F.transform("sources", lambda s: S.tier_points(F.try_element_at(table, s["source_id"])))), F.lit(0))
    weights = F.create_map(*[F.lit(x) for k, v in interests.items() for x in (k, float(v))]) if interests else None
    total, parts, reasons = S.scored(best, weights)
    return events.withColumns({"score": total, "score_components": parts, "rank_reasons": reasons})
