"""Types of events and of what they are made from."""

from __future__ import annotations

from pyspark.sql import types as T

# The names that event records may hold.
EVENT_TYPES = ["conference", "workshop", "research_program", "public_lecture", "distinguished_lecture", "lecture_series", "summer_school", "mini_course", "colloquium", "panel", "award_lecture", "memorial_conference", "seminar", "unknown"]
EVENT_STATUSES = ["announced", "registration_open", "upcoming", "ongoing", "completed", "media_pending", "media_available", "archived", "cancelled", "unknown"]
MEDIA_TYPES = ["video", "audio", "slides", "lecture_notes", "transcript", "program_pdf", "abstract_pdf", "livestream", "playlist", "other"]
ACCESS = ["open", "registration_required", "institution_login", "paywalled", "in_person_only", "unknown"]
ONLINE = ["livestream", "hybrid", "recording_available", "recording_expected", "no_online_access", "unknown"]
SOURCE_STATUSES = ["ok", "partial", "timeout", "http_error", "parse_error", "robots_denied", "dynamic_unsupported", "budget_exhausted", "disabled"]
ROLES = ["speaker", "lecturer", "organizer", "participant", "panelist", "honoree", "series_namesake", "title_mention", "unknown"]
PRECISIONS = ["year", "month", "day", "date_time", "range", "unknown"]
TIERS = ["s", "a", "b", "unknown"]
KINDS = ["institution_calendar", "conference_series", "rss_feed", "ics_feed", "indico", "json_ld", "media_archive", "other"]
ADAPTERS = ["rss", "ics", "json_ld", "indico", "html_config", "html_generic", "none"]
#: In order: a change's place among those of one event.
CHANGE_KINDS = ["event_added", "event_updated", "schedule_added", "speaker_added", "livestream_added", "media_added", "media_removed", "event_cancelled"]

DATE = "struct<start:date,end:date,timezone:string,original_text:string,precision:string>"
PERSON = "struct<canonical_name:string,matched_text:string,role:string,evidence:string,confidence:float,scholar_tags:array<string>>"
TOPIC = "struct<topic_id:string,canonical_name:string,matched_text:string,confidence:float>"
MEDIA = "struct<url:string,media_type:string,title:string,platform:string,public_access:string,published_at:timestamp>"
SOURCE = "struct<source_id:string,source_url:string,evidence:string,captured_at:timestamp,native_id:string>"
LOCATION = "struct<name:string,city:string,country:string,venue:string>"
TALK = f"struct<id:string,title:string,speaker:array<{PERSON}>,abstract_text:string,date_time:struct<start:timestamp,end:timestamp,timezone:string>,media:array<{MEDIA}>,topics:array<{TOPIC}>>"
COMPONENTS = "struct<topic:short,media:short,access:short,source_tier:short,people:short,completeness:short>"
EVENT = (
    f"id string, title string, url string, event_type string, status string, date {DATE}, location {LOCATION}, description string, "
    f"topics array<{TOPIC}>, people array<{PERSON}>, talks array<{TALK}>, media array<{MEDIA}>, "
    f"access struct<access:string,online:string>, sources array<{SOURCE}>, score float, score_components {COMPONENTS}, "
    "rank_reasons array<string>, first_seen_at timestamp, last_seen_at timestamp"
)
HEALTH = "source string, status string, duration_ms long, requests int, events int, message string, recorded_at timestamp"
CHANGE = "event_id string, kind string, detected_at timestamp, detail string"
DOCUMENT = "source string, url string, final_url string, status int, content_type string, body binary, fetched_at timestamp"
STUB = f"source string, title string, url string, native_id string, date_hint {DATE}, source_url string, stub_ord long"


def schema(ddl: str) -> T.StructType:
    """The type of a DDL string."""
    return T._parse_datatype_string(ddl)
