"""Classes of events, access and media as column expressions over text and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from . import urls as U

# The phrases that decide access, from the strictest class on.
PAYWALLED = ["subscription", "paywall", "paid", "fee required", "purchase required"]
LOGIN = ["login required", "sign in", "institutional access", "university login", "sso"]
REGISTRATION = ["register", "registration required", "sign up", "rsvp"]
OPEN = ["free", "open access", "no registration", "public"]
NOT_REQUIRED = ["no registration required", "no registration needed", "registration not required", "registration not necessary", "no sign up required", "no sign up needed", "sign up not required"]

# Event types by the phrases that name them, special ones first.
TYPE_PHRASES = [
    ("memorial_conference", ["memorial conference", "memorial meeting"]),
    ("award_lecture", ["award lecture", "prize lecture", "memorial lecture"]),
    ("summer_school", ["summer school", "winter school", "spring school"]),
    ("distinguished_lecture", ["distinguished lecture", "plenary lecture"]),
    ("public_lecture", ["public lecture", "public talk"]),
    ("lecture_series", ["lecture series", "lecture programme"]),
    ("research_program", ["research program", "research programme", "thematic program", "semester program"]),
    ("mini_course", ["mini course", "minicourse", "short course"]),
    ("workshop", ["workshop"]),
    ("colloquium", ["colloquium"]),
    ("panel", ["panel"]),
    ("seminar", ["seminar"]),
    ("conference", ["conference", "meeting", "symposium"]),
]

# Link texts and targets of navigation, words that mark events, and file endings of media.
NAVIGATION = ["home", "about", "contact", "login", "sign in", "register", "sign up", "menu", "navigation", "search", "help", "faq", "privacy", "terms", "sitemap", "back", "next", "previous", "more"]
EVENT_WORDS = ["conference", "workshop", "seminar", "lecture", "summer school", "winter school", "spring school", "colloquium", "panel", "mini course", "minicourse", "short course", "research program", "research programme", "thematic program", "award lecture", "prize lecture", "memorial", "symposium", "meeting", "school"]
VIDEO_FILES = ["mp4", "webm", "mkv", "mov", "avi", "m4v"]
AUDIO_FILES = ["mp3", "ogg", "opus", "wav", "m4a", "aac", "flac"]
VIDEO_HOSTS = ["youtube.com", "youtu.be", "youtube-nocookie.com"]
VIDEO_FAMILIES = [".youtube.com", ".youtube-nocookie.com"]
MONTH_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december"


def access_class(text: Column) -> Column:
    """Public access by the phrases of a page's text and meta contents; unknown without any."""

    def choice(t: Column) -> Column:
        spared = X.any_phrase(t, NOT_REQUIRED)
        return (
            F.when(X.any_phrase(t, PAYWALLED), "paywalled")
            .when(X.any_phrase(t, LOGIN), "institution_login")
            .when(~spared & X.any_phrase(t, REGISTRATION), "registration_required")
            .when(X.any_phrase(t, OPEN) | spared, "open")
            .otherwise("unknown")
        )

    return X.let(X.normalize_text(F.coalesce(text, F.lit(""))), choice)


def event_type(text: Column) -> Column:
    """The event type that a text names; unknown without any."""

    def choice(t: Column) -> Column:
        found = None
        for name, phrases in TYPE_PHRASES:
            hit = F.lit(False)
            for p in phrases:
                hit = hit | t.contains(p)
            found = F.when(hit, name) if found is None else found.when(hit, name)
        return found.otherwise("unknown")

    return X.let(X.normalize_text(F.coalesce(text, F.lit(""))), choice)


def tube_host(host: Column) -> Column:
    """Whether a host, or the family of hosts that it is of, shows hosted videos."""
    found = host.isin(VIDEO_HOSTS)
    for family in VIDEO_FAMILIES:
        found = found | host.endswith(family)
    return found


def video_platform(url: Column) -> Column:
    """youtube, vimeo, bilibili or null."""
    host, path = U.host(url), U.path(url)
    tube = tube_host(host) & ((host == "youtu.be") | (path == "/watch") | path.startswith("/watch/") | path.contains("/embed/") | path.contains("/shorts/"))
    return (
        F.when(tube, "youtube")
        .when((host == "vimeo.com") | host.endswith(".vimeo.com"), "vimeo")
        .when(((host == "bilibili.com") | host.endswith(".bilibili.com")) & path.contains("/video/"), "bilibili")
    )


def ending(url: Column) -> Column:
    """What follows the last dot of the path, in lower case."""
    return F.lower(F.substring_index(U.path(url), ".", -1))


def link_media_type(url: Column, link_text: Column, title: Column) -> Column:
    """The media type of a link's target; null if it is no media."""
    words = F.lower(F.concat_ws(" ", F.coalesce(link_text, F.lit("")), title, U.path(url)))
    pdf = (
        F.when(words.contains("slides") | words.contains("presentation") | words.contains("handout"), "slides")
        .when(words.contains("program"), "program_pdf")
        .when(words.contains("abstract"), "abstract_pdf")
        .otherwise("other")
    )
    kind = ending(url)
    return F.when(video_platform(url).isNotNull(), "video").when(kind == "pdf", pdf).when(kind.isin(VIDEO_FILES), "video").when(kind.isin(AUDIO_FILES), "audio")


def canonical_media_url(url: Column) -> Column:
    """One address for all forms of a hosted video; others as they are."""
    host = U.host(url)
    code = r"([A-Za-z0-9_-]{11})(?:[/?&#]|$)"
    found = F.coalesce(
        F.nullif(F.when(host == "youtu.be", F.regexp_extract(url, rf"^[^:]+://[^/]+/{code}", 1)), F.lit("")),
        F.nullif(F.regexp_extract(url, rf"/(?:embed|shorts)/{code}", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, rf"[?&]v={code}", 1), F.lit("")),
    )
    return F.when(tube_host(host) & found.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), found)).otherwise(url)


def is_navigation(text: Column, href: Column) -> Column:
    """Whether a link leads about the site and not to an event."""
    target = F.lower(F.trim(href))
    return F.lower(F.trim(text)).isin(NAVIGATION) | target.isin("", "/") | target.rlike("^(#|javascript:|mailto:|tel:)")


def looks_like_event(text: Column) -> Column:
    """Whether a link's text has an event word, a month name or a year."""
    t = F.lower(text)
    return X.any_phrase(t, EVENT_WORDS) | t.rlike(MONTH_NAMES) | t.rlike(r"(19|20)[0-9]{2}")
