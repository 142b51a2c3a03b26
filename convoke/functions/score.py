"""Explainable scores: six capped parts of what an event shows.

All parts are expressions over the event's nested columns; only the tiers of its
sources come from a dimension (see ``operators.enrich.with_tier``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The most that each part can give, and what its signals give.
CAPS = {"topic": 30, "media": 25, "access": 15, "source_tier": 10, "people": 10, "completeness": 10}
TIER_POINTS = {"s": 10, "a": 7, "b": 4, "unknown": 0}
IMPORTANT_TAGS = ["fields", "abel", "wolf", "crafoord"]


def half_up(x: Column) -> Column:
    """Rounded half up, held to 0 to 255."""
    return F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("int")


def weight(x: Column) -> Column:
    """An interest weight held to 0 to 1; 1 if it is missing or not finite."""
    x = x.cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, 1.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def topic_points(w: Column) -> Column:
    """What one matched topic gives."""
    return half_up(F.lit(15.0) * (0.5 + 0.5 * weight(w)))


def topic_score(topics: Column, interests: Column | None = None) -> Column:
    """All topics' points, capped."""
    own = lambda t: topic_points(F.try_element_at(interests, t["topic_id"])) if interests is not None else F.lit(15)
    total = F.aggregate(F.transform(topics, own), F.lit(0), lambda a, x: a + x)
    return F.least(F.coalesce(total, F.lit(0)), F.lit(CAPS["topic"]))


def media_points(kind: Column, access: Column) -> Column:
    """What one medium gives."""
    return (
        F.when((kind == "video") & (access == "open"), 25)
        .when((kind == "video") & (access == "registration_required"), 18)
        .when((kind == "audio") & (access == "open"), 15)
        .when(kind.isin("slides", "lecture_notes"), 10)
        .otherwise(0)
    )


def media_score(media: Column) -> Column:
    """The best medium's points."""
    return F.coalesce(F.array_max(F.transform(media, lambda m: media_points(m["media_type"], m["public_access"]))), F.lit(0))


def has_recording(media: Column) -> Column:
    """Whether a medium is a recording, or slides or notes, that is open."""
    return F.coalesce(F.exists(media, lambda m: (m["public_access"] == "open") & m["media_type"].isin("video", "audio", "slides", "lecture_notes")), F.lit(False))


def access_score(online: Column) -> Column:
    """What live access gives."""
    return F.when(online == "livestream", 15).when(online == "hybrid", 12).when(online == "recording_expected", 10).otherwise(0)


def tier_points(tier: Column) -> Column:
    """What a source's tier gives."""
    found = F.lit(0)
    for name, points in TIER_POINTS.items():
        found = F.when(tier == name, points).otherwise(found)
    return found


def is_important(tags: Column) -> Column:
    """Whether a scholar's tags hold a major prize."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t).isin(IMPORTANT_TAGS)), F.lit(False))


def person_points(role: Column, important: Column) -> Column:
    """What one person gives."""
    return (
        F.when(role.isin("title_mention", "unknown"), 0)
        .when(role.isin("speaker", "lecturer") & important, 10)
        .when(role.isin("organizer", "panelist") & important, 5)
        .otherwise(3)
    )


def best_person(people: Column) -> Column:
    """points, name and role of the first person with the most points; null without people."""
    scored = F.transform(people, lambda p, i: F.struct(person_points(p["role"], is_important(p["scholar_tags"])).alias("points"), (-i).alias("order"), p["canonical_name"].alias("name"), p["role"].alias("role")))
    return F.array_max(scored)


def completeness_score(description: Column, talks: Column, location: Column) -> Column:
    """Points for a description, an abstract, a place and three talks."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    abstract = F.coalesce(F.exists(talks, lambda t: filled(t["abstract_text"])), F.lit(False))
    return F.when(filled(description), 3).otherwise(0) + F.when(abstract, 3).otherwise(0) + F.when(location.isNotNull(), 2).otherwise(0) + F.when(F.size(talks) >= 3, 2).otherwise(0)


def scored(tier: Column, interests: Column | None = None) -> tuple[Column, Column, Column]:
    """score, score_components and rank_reasons of event rows; ``tier`` is the best tier's points."""
    topics, media, people, talks = F.col("topics"), F.col("media"), F.col("people"), F.col("talks")
    best = best_person(people)
    parts = {
        "topic": topic_score(topics, interests),
        "media": media_score(media),
        "access": access_score(F.col("access")["online"]),
        "source_tier": F.coalesce(tier, F.lit(0)),
        "people": F.coalesce(best["points"], F.lit(0)),
        "completeness": completeness_score(F.col("description"), talks, F.col("location")),
    }
    total = sum((parts[k] for k in CAPS), F.lit(0)).cast("float")
    components = F.struct(*[parts[k].cast("short").alias(k) for k in CAPS])
    online = F.col("access")["online"]
    label = F.when(best["role"].isin("speaker", "lecturer"), "important_speaker").when(best["role"] == "organizer", "important_organizer").when(best["role"] == "panelist", "important_panelist").otherwise("important_person")
    reasons = F.concat(
        F.transform(topics, lambda t: F.concat(F.lit("matched_topic: "), t["topic_id"])),
        F.array_compact(F.array(
            F.when(has_recording(media), "public_recording_available"),
            F.when(online.isin("livestream", "hybrid"), online),
            F.when(parts["source_tier"] >= 10, "major_research_institute"),
            F.when(parts["people"] >= 5, F.concat(label, F.lit(": "), best["name"])),
            F.when(parts["completeness"] >= 10, "program_complete"),
        )),
    )
    return total, components, reasons
