"""From documents to events: what each kind of source means by its fields.

``discover`` turns listings into stubs, ``enrich`` stubs and their pages into
events.  Parsers give raw fields (see ``parse``); everything else here is columns.
A listing or page that can't be read is a row with its error, never the end of a
scan.  An ``Adapter`` is a kind of source; ``register`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import dates as D
from ..functions import text as X
from ..functions import urls as U
from ..schemas import COMPONENTS, LOCATION, MEDIA, PERSON, SOURCE, TALK, TOPIC
from . import parse as P

def _no_time() -> Column:
    return F.lit(None).cast("timestamp")


def _none() -> Column:
    return F.lit(None).cast("string")


def _stub(rows: DataFrame, title: Column, url: Column, date: Column, native_id: Column, evidence: Column) -> DataFrame:
    """Stubs, and a row with its error for each listing that could not be read."""
    return rows.select(
        "source", title.alias("title"), url.alias("url"), native_id.cast("string").alias("native_id"), date.alias("date_hint"),
        F.col("final_url").alias("source_url"), evidence.cast("string").alias("evidence"), F.col("ord").alias("stub_ord"), "error",
    )


_KEEP = ["source", "final_url", "fetched_at"]


#: Records of one document before the next one's numbers begin, where a listing comes in several documents.
_ROOM = 1 << 32


def _read(docs: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """Records of listings, numbered by the documents' places (``part``, if docs have it) and then within each."""
    if "part" not in docs.columns:
        return P.rows_of(docs, fn, ddl, _KEEP)
    rows = P.rows_of(docs, fn, ddl, [*_KEEP, "part"])
    return rows.withColumn("ord", F.coalesce(F.col("part").cast("long"), F.lit(0)) * _ROOM + F.col("ord")).drop("part")


def feed_stubs(docs: DataFrame) -> DataFrame:
    rows = _read(docs, P.feed, P.ENTRY)
    return _stub(rows, F.col("title"), F.col("url"), D.parse_date(F.col("date")), F.nullif(F.col("native_id"), F.lit("")), _none())


def calendar_day(value: Column) -> Column:
    """The date of a calendar's DATE or DATE-TIME."""
    found = F.regexp_extract(F.trim(value), r"^(\d{8})(?:T\d{4,6}Z?)?$", 1)
    return F.when(found != "", F.concat_ws("-", F.substring(found, 1, 4), F.substring(found, 5, 2), F.substring(found, 7, 2)).try_cast("date"))


def duration_days(value: Column) -> Column:
    """Whole days of a calendar duration; null for a negative or broken one."""
    pattern = r"^\+?P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(value, pattern, k), F.lit("")).try_cast("bigint"), F.lit(0))
    return F.when(value.rlike(pattern) & ~value.rlike(r"^\+?P$|T$"), part(1) * 7 + part(2))


def calendar_range(dtstart: Column, dtend: Column, duration: Column) -> Column:
    """A date from a calendar's start, end and duration; a DATE end is the day after the last."""
    start, end = calendar_day(dtstart), calendar_day(dtend)
    by_end = end.isNotNull() & (end >= start)
    last = F.when(F.trim(dtend).rlike(r"^\d{8}$"), F.greatest(F.date_sub(end, 1), start)).otherwise(end)
    days = duration_days(duration)
    by_duration = ~F.coalesce(by_end, F.lit(False)) & (days > 0)
    done = F.when(by_end, last).when(by_duration, F.date_add(start, (days - 1).cast("int")))
    told = F.when(by_end, F.concat(dtstart, F.lit("/"), dtend)).when(by_duration, F.concat(dtstart, F.lit("/"), duration)).otherwise(dtstart)
    made = F.struct(start.alias("start"), done.alias("end"), _none().alias("timezone"), told.alias("original_text"), F.lit("day").alias("precision"))
    return F.when(start.isNotNull(), made.cast(D.TYPE))


def calendar_stubs(docs: DataFrame) -> DataFrame:
    rows = _read(docs, P.calendar, P.CALENDAR)
    return _stub(rows, F.col("title"), F.col("url"), calendar_range(F.col("dtstart"), F.col("dtend"), F.col("duration")), F.col("native_id"), F.lit("ics"))


def linked_stubs(docs: DataFrame) -> DataFrame:
    rows = _read(docs, P.linked, P.NODE)
    address = lambda c: F.when(U.is_http(F.col(c)), F.col(c))
    numbered = F.concat("final_url", F.when(F.col("final_url").contains("?"), "&").otherwise("?"), F.lit("event-node="), (F.col("ord") % _ROOM).cast("string"))
    return _stub(rows, F.coalesce("name", F.lit("Untitled")), F.coalesce(address("url"), address("id"), numbered), D.parse_date(F.col("start")), _none(), _none())


def first_date(texts: Column, today: Column | None = None) -> Column:
    """The first of the texts that is a date."""
    read = (lambda t: D.parse_date_with_reference(t, today)) if today is not None else D.parse_date
    return F.get(F.filter(F.transform(texts, read), lambda d: d["precision"] != "unknown"), F.lit(0))


def configured_stubs(docs: DataFrame) -> DataFrame:
    """docs need selectors."""
    rows = _read(docs, P.listed, P.LISTED)
    return _stub(rows, F.col("title"), F.col("url"), first_date(F.col("date_texts"), F.to_date("fetched_at")), _none(), _none())


def generic_stubs(docs: DataFrame) -> DataFrame:
    rows = _read(docs, P.anchors, P.ANCHOR)
    rows = rows.filter(F.col("error").isNotNull() | (~C.is_navigation(F.col("text"), F.col("href")) & C.looks_like_event(F.col("text")) & U.is_http(F.col("url"))))
    return _stub(rows, F.col("text"), F.col("url"), F.lit(None).cast(D.TYPE), _none(), F.col("text"))


def unread_stubs(docs: DataFrame) -> DataFrame:
    """Listings of a kind that can't be read: each is an error."""
    rows = docs.select("source", "final_url", F.lit(0).cast("long").alias("ord"), F.lit("sources of this kind can't be read").alias("error"))
    return _stub(rows, _none(), _none(), F.lit(None).cast(D.TYPE), _none(), _none())


def discover(docs: DataFrame, specs: DataFrame, adapters: list[str]) -> DataFrame:
    """Stubs (and errors) of listings (docs) by their sources' adapters; ``adapters`` are those in use."""
    rows = docs.join(specs.select(F.col("id").alias("source"), "adapter", "selectors", "media_strategy"), "source")
    out = None
    for name in adapters:
        own = ADAPTERS[name].discover(rows.filter(F.col("adapter") == name)).withColumn("adapter", F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no adapter in use")
    return out


def media_of(links: Column) -> Column:
    """Media from links, frames and files: the first of each canonical address."""
    def one(x: Column) -> Column:
        url, tag = x["url"], x["tag"]
        kind = F.when(tag == "a", C.link_media_type(url, x["text"], x["title"])).when(tag == "iframe", F.when(C.video_platform(url).isNotNull(), "video")).otherwise(tag)
        made = F.struct(url.alias("url"), kind.alias("media_type"), _none().alias("title"), C.video_platform(url).alias("platform"), F.lit("unknown").alias("public_access"), _no_time().alias("published_at"))
        return F.struct(F.when(U.is_http(url), kind).alias("kind"), C.canonical_media_url(url).alias("key"), made.cast(MEDIA).alias("media"))

    rows = F.filter(F.transform(links, one), lambda m: m["kind"].isNotNull())
    none = F.array().cast(f"array<struct<kind:string,key:string,media:{MEDIA}>>")
    kept = F.aggregate(rows, none, lambda acc, m: F.when(F.exists(acc, lambda a: a["key"] == m["key"]), acc).otherwise(F.concat(acc, F.array(m))))
    return F.coalesce(F.transform(kept, lambda m: m["media"]), F.array().cast(f"array<{MEDIA}>"))


def scaffold(rows: DataFrame, title: Column, date: Column, **given: Column) -> DataFrame:
    """Event rows from stub rows: what every adapter sets alike, and what is given."""
    array = lambda kind: F.array().cast(f"array<{kind}>")
    source = F.struct(F.col("source").alias("source_id"), F.col("source_url"), F.col("evidence"), F.col("fetched_at").alias("captured_at"), F.col("native_id")).cast(SOURCE)
    canonical = F.coalesce(U.canonical_url(F.col("url")), F.col("url"))
    access = F.struct(given.get("access", F.lit("unknown")).alias("access"), given.get("online", F.lit("unknown")).alias("online"))
    place = given.get("location", _none())
    return rows.select(
        X.deterministic_id(X.normalize_name(title), canonical).alias("id"), title.alias("title"), F.col("url"),
        given.get("event_type", C.event_type(title)).alias("event_type"), given.get("status", F.lit("unknown")).alias("status"),
        F.coalesce(date, D.unknown(F.lit(""))).alias("date"),
        F.when(place.isNotNull(), F.struct(place.alias("name"), _none().alias("city"), _none().alias("country"), _none().alias("venue")).cast(LOCATION)).alias("location"),
        given.get("description", _none()).alias("description"), array(TOPIC).alias("topics"), given.get("people", array(PERSON)).alias("people"),
        given.get("talks", array(TALK)).alias("talks"), given.get("media", array(MEDIA)).alias("media"), access.alias("access"),
        F.array(source).alias("sources"), F.lit(0).cast("float").alias("score"),
        F.lit(None).cast(COMPONENTS).alias("score_components"),
        F.array().cast("array<string>").alias("rank_reasons"), _no_time().alias("first_seen_at"), _no_time().alias("last_seen_at"),
        F.col("source"), F.col("stub_ord"), given.get("broken", F.lit(False)).alias("broken"),
    )


def _speaker(name: Column, evidence: Column) -> Column:
    return F.struct(name.alias("canonical_name"), name.alias("matched_text"), F.lit("speaker").alias("role"), evidence.alias("evidence"), F.lit(1.0).cast("float").alias("confidence"), F.array().cast("array<string>").alias("scholar_tags")).cast(PERSON)


def _talk(talk_id: Column, title: Column, speakers: Column) -> Column:
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return F.struct(talk_id.alias("id"), title.alias("title"), speakers.alias("speaker"), _none().alias("abstract_text"), F.lit(None).cast("struct<start:timestamp,end:timestamp,timezone:string>").alias("date_time"), none(MEDIA).alias("media"), none(TOPIC).alias("topics")).cast(TALK)


def _with_pages(stubs: DataFrame, pages: DataFrame) -> DataFrame:
    """Stubs with their page's fields (null without a page) and broken, if there is a page that can't be read."""
    pages = pages.withColumnRenamed("error", "p_error").withColumn("found", F.col("p_error").isNull())
    return stubs.drop("error").join(pages, ["source", "url"], "left").withColumn("broken", F.col("p_error").isNotNull())


def _pages(docs: DataFrame, fn: Callable, ddl: str, only_html: bool = False) -> DataFrame:
    own = docs.filter(F.col("error").isNull())
    if only_html:
        own = own.filter(F.coalesce(F.lower("content_type").contains("html"), F.lit(False)))
    return P.rows_of(own, fn, ddl, ["source", "url"]).drop("ord")


def enrich_pages(stubs: DataFrame, docs: DataFrame, now: Column, feed: bool = False) -> DataFrame:
    """Events of feeds and generic listings from their pages.  A page's date text counts even if it is none.

    A feed's entry keeps its own title, and so its id and type; a page found by a link gives its title.
    """
    fields = _pages(docs, P.page, P.PAGE, only_html=feed).withColumnsRenamed({"title": "p_title"})
    rows = _with_pages(stubs, fields).withColumn("fetched_at", now)
    title = F.col("title") if feed else F.coalesce("p_title", "title")
    kind = title if feed else F.concat_ws(" ", title, "description")
    date = F.when(F.col("date_text").isNotNull(), D.parse_date(F.col("date_text"))).otherwise(F.col("date_hint"))
    return scaffold(
        rows, title, date, event_type=C.event_type(kind), description=F.col("description"), broken=F.col("broken"),
        location=F.col("location_text"), media=media_of(F.col("links")), access=F.when(F.col("found"), C.access_class(F.col("words"))).otherwise("unknown"),
    )


def enrich_channel(stubs: DataFrame, now: Column) -> DataFrame:
    """Events of video channels: the entry is an open recording, and no page is asked."""
    video = F.struct(F.col("url"), F.lit("video").alias("media_type"), F.col("title"), F.lit("youtube").alias("platform"), F.lit("open").alias("public_access"), _no_time().alias("published_at")).cast(MEDIA)
    return scaffold(stubs.withColumn("fetched_at", now), F.col("title"), F.col("date_hint"), media=F.array(video), access=F.lit("open"), online=F.lit("recording_available"))


def enrich_configured(stubs: DataFrame, docs: DataFrame, specs: DataFrame, now: Column) -> DataFrame:
    """Events of configured listings; a page without a readable date keeps the listing's."""
    own = docs.join(specs.select(F.col("id").alias("source"), "selectors"), "source")
    fields = _pages(own, P.detail, P.DETAIL).withColumnsRenamed({"title": "p_title"})
    rows = _with_pages(stubs, fields).withColumn("fetched_at", now)
    title = F.coalesce("p_title", "title")
    names = F.coalesce("speakers", F.array().cast("array<string>"))
    rows = rows.withColumns({"_title": title, "_names": names})
    talks = F.transform("_names", lambda n: _talk(X.deterministic_id(F.col("_title"), n, F.col("url")), F.col("_title"), F.array(_speaker(n, _none()))))
    return scaffold(
        rows, F.col("_title"), F.coalesce(first_date(F.col("date_texts")), F.col("date_hint")), description=F.col("description"), location=F.col("location"),
        people=F.transform("_names", lambda n: _speaker(n, _none())), talks=talks, media=media_of(F.col("links")), broken=F.col("broken"),
        access=F.when(F.col("found"), C.access_class(F.col("words"))).otherwise("unknown"),
    )


def enrich_calendar(stubs: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Events of calendars are announced; a page with markup gives description and place."""
    marked = docs.filter(F.coalesce(F.contains("body", F.lit(b"<")), F.lit(False)))
    rows = _with_pages(stubs, _pages(marked, P.page, P.PAGE).drop("title")).withColumn("fetched_at", now)
    return scaffold(rows, F.col("title"), F.col("date_hint"), status=F.lit("announced"), description=F.col("description"), location=F.col("location_text"), broken=F.col("broken"))


def enrich_linked(stubs: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Events of JSON-LD pages: the nodes with the stub's address, else the only one with its name and no address.

    A stub without a page of its own (``listed``) is looked up in its listing.  Nodes meet
    stubs by equal keys, so a listing of many nodes costs what it holds.
    """
    own = docs.filter(F.col("error").isNull()).withColumnRenamed("url", "page")
    pages = P.rows_of(own, P.linked_page, P.LINKED, ["source", "page"])
    named = lambda c: F.concat(F.lit("n"), F.coalesce(c, F.lit("Untitled")))
    entry = lambda key, rank, n: F.struct(key.alias("key"), F.lit(rank).alias("rank"), n.alias("node"))
    keys = F.flatten(F.transform("nodes", lambda n: F.array(entry(F.concat(F.lit("u"), n["url"]), 1, n), entry(F.concat(F.lit("u"), n["id"]), 1, n), entry(F.when(n["no_address"], named(n["name"])), 2, n))))
    none = F.lit(None).cast(P.schema(P.LINKED)["nodes"].dataType.elementType)
    page = F.array(entry(F.lit("p"), 0, none))
    pages = pages.select("source", "page", "error", C.access_class(F.col("words")).alias("access"), F.inline(F.concat(page, F.coalesce(F.filter(keys, lambda k: k["key"].isNotNull()), F.slice(page, 1, 0)))))
    asked = F.array(F.lit("p"), F.concat(F.lit("u"), F.col("url")), named(F.col("title")))
    listed = F.col("listed") if "listed" in stubs.columns else F.regexp_replace("url", r"[?&]event-node=[0-9]+$", "") == F.col("source_url")
    rows = stubs.withColumn("page", F.when(listed, F.col("source_url")).otherwise(F.col("url"))).drop("listed", "error")
    whole = [c for c in rows.columns if c not in ("date_hint", "page")]
    rows = rows.withColumn("key", F.explode(asked)).join(pages, ["source", "page", "key"], "left")
    found = F.array_sort(F.collect_set(F.when(F.col("node").isNotNull(), F.struct("node.ord", "rank", "node"))))
    rows = rows.groupBy(*whole, F.to_json("date_hint").alias("_date")).agg(found.alias("_all"), F.max("access").alias("_access"), F.max(F.col("error").isNotNull()).alias("broken"))
    exact, by_name = F.filter("_all", lambda n: n["rank"] == 1), F.filter("_all", lambda n: n["rank"] == 2)
    nodes = F.when(F.size(exact) > 0, exact).when(F.size(by_name) == 1, by_name).otherwise(F.slice(exact, 1, 0))
    rows = rows.withColumns({"nodes": nodes, "date_hint": F.from_json("_date", D.TYPE), "fetched_at": now})
    first = lambda k: F.get(F.filter(F.transform("nodes", lambda n: n["node"][k]), lambda v: v.isNotNull()), F.lit(0))
    talks = F.flatten(F.transform("nodes", lambda n: F.transform(n["node"]["talks"], lambda t: _talk(X.deterministic_id(F.coalesce(t["title"], F.col("title")), F.array_join(t["names"], ", ")), F.coalesce(t["title"], F.col("title")), F.transform(t["names"], lambda p: _speaker(p, t["evidence"]))))))
    people = F.flatten(F.transform("nodes", lambda n: F.flatten(F.transform(n["node"]["talks"], lambda t: F.transform(t["names"], lambda p: _speaker(p, t["evidence"]))))))
    return scaffold(rows, F.col("title"), F.col("date_hint"), description=first("description"), location=first("location"), talks=talks, people=people, access=F.coalesce("_access", F.lit("unknown")), broken=F.coalesce("broken", F.lit(False)))


def enrich_feed(stubs: DataFrame, docs: DataFrame, specs: DataFrame, now: Column) -> DataFrame:
    """Events of feeds: channels of videos need no page."""
    channels = specs.filter(F.col("media_strategy") == "youtube_channel").select(F.col("id").alias("source"))
    return enrich_channel(stubs.join(channels, "source", "left_semi"), now).unionByName(enrich_pages(stubs.join(channels, "source", "left_anti"), docs, now, feed=True))


@dataclass(frozen=True)
class Adapter:
    """A kind of source.

    ``discover`` gives stubs of listings (documents of its sources, with their selectors);
    ``enrich`` gives events of stubs, pages (by source and url), sources and the time.
    """

    discover: Callable[[DataFrame], DataFrame]
    enrich: Callable[[DataFrame, DataFrame, DataFrame, Column], DataFrame]


_generic = Adapter(generic_stubs, lambda stubs, docs, specs, now: enrich_pages(stubs, docs, now))
ADAPTERS: dict[str, Adapter] = {
    "rss": Adapter(feed_stubs, enrich_feed),
    "ics": Adapter(calendar_stubs, lambda stubs, docs, specs, now: enrich_calendar(stubs, docs, now)),
    "json_ld": Adapter(linked_stubs, lambda stubs, docs, specs, now: enrich_linked(stubs, docs, now)),
    "html_config": Adapter(configured_stubs, enrich_configured),
    "html_generic": _generic,
    "none": _generic,
    "indico": Adapter(unread_stubs, lambda stubs, docs, specs, now: enrich_pages(stubs, docs, now)),
}


def register(name: str, adapter: Adapter) -> None:
    """Adds a kind of source under a new name, which sources may then give as their adapter."""
    if name in ADAPTERS:
        raise ValueError(f"there is an adapter {name}")
    ADAPTERS[name] = adapter


def enrich(stubs: DataFrame, docs: DataFrame, specs: DataFrame, adapters: list[str], now: Column) -> DataFrame:
    """Events of all stubs (with adapter) from their pages (docs, by source and url); broken where a page can't be read."""
    out = None
    for name in adapters:
        made = ADAPTERS[name].enrich(stubs.filter(F.col("adapter") == name).drop("adapter", "error"), docs, specs, now)
        out = made if out is None else out.unionByName(made)
    return out
