"""A scan: from collected documents to ranked events, changes and output."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import urls as U
from ..operators import changes as G
from ..operators import dedup, enrich, health, limits
from ..schemas import CHANGE, EVENT, schema
from ..sources import adapters, registry, web
from .output import detailed
from .state import ScanStore
from .tables import written


class ScanError(RuntimeError):
    """A scan that can't go on; ``code`` is what a command would exit with."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Query:
    """What a scan shows."""

    today: datetime.date
    mode: str = "both"
    before: int = 30
    after: int = 180
    max_events: int | None = None
    max_talks: int = limits.TALKS
    detail: str = "compact"

    def __post_init__(self) -> None:
        if self.mode not in ("upcoming", "recordings", "both"):
            raise ScanError(2, f"no such mode: {self.mode}")
        if self.before < 0 or self.after < 0 or self.max_talks < 0:
            raise ScanError(2, "days and talks may not be negative")


@dataclass
class Registries:
    """Sources (a DataFrame) and the names that events are matched with."""

    sources: DataFrame
    topics: list[dict[str, Any]] = field(default_factory=list)
    scholars: list[dict[str, Any]] = field(default_factory=list)
    interests: dict[str, float] | None = None


@dataclass
class Scan:
    """What a scan gives: events in order, health by source, changes in order."""

    events: DataFrame
    health: DataFrame
    changes: DataFrame


def _specs(registries: Registries) -> tuple[DataFrame, list[str]]:
    """The enabled sources and the adapters in use."""
    specs = registry.enabled(registry.validated(registries.sources))
    used = sorted(r[0] for r in specs.select("adapter").distinct().collect())
    if not used:
        raise ScanError(4, "no source is enabled")
    return specs, used


def discovered(specs: DataFrame, used: list[str], listings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stubs (listed: they have no page of their own), plans of their pages, and (source, message) of listings that can't be read."""
    found = written(adapters.discover(listings.filter(F.col("error").isNull()), specs, used))
    broken = found.filter(F.col("error").isNotNull()).groupBy("source").agg(F.min("error").alias("message"))
    stubs = limits.capped_stubs(found.filter(F.col("error").isNull()).drop("error"))
    asks = specs.select(F.col("id").alias("source"), "max_depth", (F.coalesce("media_strategy", F.lit("")) == "youtube_channel").alias("channel"))
    rows = stubs.join(asks, "source").withColumn("listed", web.is_listed(F.col("url"), F.col("source_url")) | F.col("channel"))
    rows = written(rows.drop("channel"))
    plans = web.detail_plans(rows.filter("NOT listed"), F.col("max_depth"))
    return rows.drop("max_depth"), plans, broken


def collected(registries: Registries, listings: DataFrame, pages: DataFrame, now: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """Events (with source and stub_ord) and health of all enabled sources from their documents.

    Documents have source, url, final_url, status, content_type, body, fetched_at and error.  A source's listing may
    come in several documents of their own addresses; then ``part`` (long) tells their order.
    """
    specs, used = _specs(registries)
    stubs, plans, broken = discovered(specs, used, listings)
    return _enriched(specs, used, listings, stubs, plans, broken, pages, now)


def crawled(registries: Registries, transport: web.Transport, now: datetime.datetime, policy: web.Policy | None = None) -> tuple[DataFrame, DataFrame]:
    """collected, with all documents fetched: listings, then the pages that stubs plan, within each source's hosts, robots rules, budget and depth."""
    specs, used = _specs(registries)
    hosts = F.when(F.size("allowed_hosts") > 0, F.col("allowed_hosts")).otherwise(F.array(U.host(F.col("entrypoint"))))
    own = specs.select(F.col("id").alias("source"), F.col("entrypoint").alias("url"), hosts.alias("allowed_hosts"), "request_budget")
    listings = written(web.documents(own.withColumn("ord", F.lit(0).cast("long")), transport, now, policy))
    stubs, plans, broken = discovered(specs, used, listings)
    told = listings.select("source", F.col("requests").alias("spent"), "rules")
    # Beyond its budget a source asks for nothing: those plans are errors without a request.
    pages = written(web.documents(plans.join(own.drop("url"), "source").join(told, "source"), transport, now, policy))
    return _enriched(specs, used, listings.drop("requests", "rules"), stubs, plans, broken, pages.drop("requests", "rules"), now)


def _enriched(specs: DataFrame, used: list[str], listings: DataFrame, stubs: DataFrame, plans: DataFrame, broken: DataFrame, pages: DataFrame, now: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    at = F.lit(now).cast("timestamp")
    asked = plans.groupBy("source").agg(F.count("*").alias("asked"))
    # A stub without any plan is enriched from its listing.
    own = listings.filter(F.col("error").isNull()).join(stubs.filter("listed").select("source").distinct(), "source", "left_semi")
    own = own.withColumn("url", F.coalesce("final_url", "url")).select(pages.columns)
    made = written(adapters.enrich(stubs.drop("cut"), pages.unionByName(own).dropDuplicates(["source", "url"]), specs, used, at))
    lost = pages.filter(F.col("error").isNotNull()).groupBy("source").agg(F.count("*").alias("failed"))
    unread = made.filter("broken").groupBy("source").agg(F.count("*").alias("unread"))
    events = made.filter("NOT broken").drop("broken")
    count = events.groupBy("source").agg(F.count("*").alias("events"))
    cut = stubs.groupBy("source").agg(F.count("*").alias("stubs"), F.max("cut").alias("cut"))
    first = listings.groupBy("source").agg(F.first("error", ignorenulls=True).alias("error"), F.count("*").alias("entries"))
    rows = first
    for other in (count, cut, lost, unread, asked, broken):
        rows = rows.join(other, "source", "left")
    rows = rows.fillna(0, ["events", "stubs", "failed", "unread", "asked"]).fillna(False, ["cut"])
    failed = F.col("failed") + F.col("unread")
    # A listing that can't be read says nothing about its events: that is no empty source.
    status = F.coalesce(health.error_status(F.col("error")), F.when(F.col("message").isNotNull(), "parse_error"), health.source_status(F.col("stubs"), F.col("events"), failed, F.col("unread"), F.col("cut")))
    results = rows.select(
        "source", status.alias("status"), F.lit(0).cast("long").alias("duration_ms"), (F.col("entries") + F.col("asked")).cast("int").alias("requests"),
        F.col("events").cast("int").alias("events"), F.coalesce("error", "message").alias("message"), at.alias("recorded_at"),
    )
    return events, health.with_missing(specs, results).withColumn("recorded_at", F.coalesce("recorded_at", at))


def refined(events: DataFrame, registries: Registries) -> DataFrame:
    """Events with topics, scholars and scores, without duplicates, scored again on what was merged."""
    columns = [f.name for f in schema(EVENT).fields]
    tiers = {r["id"]: r["tier"] for r in registries.sources.select("id", "tier").collect()}
    rows = enrich.with_scholars(enrich.with_topics(events.select(columns), registries.topics), registries.scholars)
    rows = written(enrich.with_scores(rows, tiers, registries.interests))
    return enrich.with_scores(dedup.dedup(rows), tiers, registries.interests)


def shown(events: DataFrame, query: Query) -> DataFrame:
    """The events that a query asks for, in order, within its caps and detail."""
    low, high = D.window_bounds(query.today, query.before, query.after)
    start, end = F.col("date")["start"], F.col("date")["end"]
    hit = D.selected(start.isNotNull(), F.size("media") > 0, D.interval_overlap(start, end, F.lit(low), F.lit(high)), query.mode)
    rows = limits.top_events(events.filter(F.coalesce(hit, F.lit(False))), query.max_events)
    return limits.ranked(detailed(limits.talk_budget(rows, query.max_talks), query.detail))


def run(registries: Registries, listings: DataFrame, pages: DataFrame, query: Query, now: datetime.datetime, store: ScanStore | None = None) -> Scan:
    """A whole scan over collected documents.  State, if any, takes all events before the window hides some."""
    return _finished(registries, *collected(registries, listings, pages, now), query, now, store)


def crawl(registries: Registries, transport: web.Transport, query: Query, now: datetime.datetime, store: ScanStore | None = None, policy: web.Policy | None = None) -> Scan:
    """A whole scan that fetches its documents through a transport."""
    return _finished(registries, *crawled(registries, transport, now, policy), query, now, store)


def _finished(registries: Registries, events: DataFrame, found: DataFrame, query: Query, now: datetime.datetime, store: ScanStore | None) -> Scan:
    spark = events.sparkSession
    kept = written(limits.capped_candidates(events))
    found = written(limits.recounted(found, kept))
    if not health.usable(found):
        raise ScanError(4, "no source could be used")
    final = written(refined(kept, registries))
    if store is None:
        changes = spark.createDataFrame([], schema(CHANGE))
    else:
        final, changes = store.store_scan(final, found, now)
        order = F.array_position(F.lit(G.CHANGE_KINDS), F.col("kind"))
        changes = changes.orderBy("event_id", order, "detail")
    return Scan(shown(final, query), found.orderBy("source"), changes)
