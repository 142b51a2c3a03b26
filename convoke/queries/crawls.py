"""Whole crawls over a made-up web, broken documents, detail pages and output."""

from __future__ import annotations

import datetime
import io
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import output as O
from ..plans import scan as N
from ..plans import state as S
from ..plans.tables import shared
from ..schemas import EVENT, schema
from ..sources import adapters as A
from ..sources import parse as P
from ..sources import registry as R
from ..sources import web as W
from . import query, table
from .duplicates import event_rows
from .sourced import _at, _docs

_NOW = datetime.datetime(2026, 6, 1, tzinfo=datetime.UTC)


def _registry(spark: SparkSession, sf_dir: str, adapter: str, **given: str) -> DataFrame:
    """Nations as sources of one kind."""
    keys = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    more = "".join(f"{k} = {v}\n" for k, v in given.items())
    return R.sources(spark, "".join(f'[[sources]]\nid = "n{k}"\nname = "n{k}"\nadapter = "{adapter}"\nentrypoint = "https://n{k}.org/"\n{more}' for k in keys))


@query("broken_listing", """
SELECT 'n' || n_nationkey AS source, CASE n_nationkey % 5 WHEN 1 THEN 'parse_error' WHEN 3 THEN 'parse_error' ELSE 'ok' END AS status, CASE n_nationkey % 5 WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS events,
  CAST(0 AS BIGINT) AS cancelled, (SELECT CAST(count(*) FILTER (n_nationkey % 5 IN (0, 4)) AS BIGINT) + count(*) FILTER (n_nationkey % 5 = 4) + count(*) FROM nation) AS stored FROM nation
""")
def broken_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that are good, cut off, empty, of odd types, or partly odd: health tells which, and stored events of broken ones aren't cancelled."""
    k = F.col("n_nationkey")
    link = lambda n: F.concat(F.lit("https://n"), k.cast("string"), F.lit(f".org/{n}"))
    item = lambda n: F.concat(F.lit("<item><title>Talk "), F.col("n_name"), F.lit("</title><link>"), link(n), F.lit("</link></item>"))
    body = (
        F.when(k % 5 == 0, F.concat(F.lit("<rss><channel>"), item(1), F.lit("</channel></rss>")))
        .when(k % 5 == 1, F.concat(F.lit("<rss><channel>"), item(1), F.lit("<item><title>cut")))
        .when(k % 5 == 2, "<rss><channel></channel></rss>")
        .when(k % 5 == 3, '{"items": [{"title": "x", "url": {"a": 1}}, {"title": 7}]}')
        .otherwise(F.concat(F.lit("<rss><channel>"), item(1), F.lit("<item><title>no link</title></item>"), item(2), F.lit("</channel></rss>")))
    )
    nation = table(spark, sf_dir, "nation")
    listings = _docs(nation, F.concat(F.lit("n"), k.cast("string")), link(""), body, "application/rss+xml")
    events, health = N.collected(N.Registries(_registry(spark, sf_dir, "rss")), listings, listings.limit(0), _NOW)
    before = event_rows(nation, id=F.concat(F.lit("old"), k.cast("string")), title=F.col("n_name"), first_seen_at=_at(), last_seen_at=_at())
    empty = lambda n: spark.createDataFrame([], S.schema(S.TABLES[n]))
    parts = S.bundle(before, empty("tombstones"), empty("health"), empty("changes"), events.select(before.columns), health, _NOW)
    lost = parts["changes"].agg(F.count(F.when(F.col("kind") == "event_cancelled", 1)).alias("cancelled"))
    return health.select("source", "status", "events").crossJoin(lost).crossJoin(parts["events"].agg(F.count("*").alias("stored")))


def made_up_web(url: str, timeout: float) -> W.Answer:
    """Sites n<k>.org: a listing of three events, their pages, and robots rules on the even ones."""
    found = re.fullmatch(r"https://n(\d+)\.org/(.*)", url)
    if not found:
        return W.Answer(404)
    k, path = int(found[1]), found[2]
    if path == "robots.txt":
        return W.Answer(200, b"User-agent: *\nDisallow: /private\n") if k % 2 == 0 else W.Answer(404)
    if k % 7 == 3:
        return W.Answer(500)
    if path == "":
        return W.Answer(200, b"<a href='/1'>Conference 2026 one</a><a href='/2'>Conference 2026 two</a><a href='/private'>Conference 2026 three</a><a href='/about'>About</a>", {"content-type": "text/html"})
    return W.Answer(200, f"<h1>Talk {k} {path}</h1><time>2 August 2026</time>".encode(), {"content-type": "text/html"})


@query("crawl_sources", """
SELECT 'n' || n_nationkey AS source, CASE WHEN n_nationkey % 7 = 3 THEN 'http_error' WHEN n_nationkey % 5 = 0 OR n_nationkey % 2 = 0 THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN n_nationkey % 7 = 3 THEN 0 ELSE 3 END AS events, CASE WHEN n_nationkey % 7 = 3 THEN 0 WHEN n_nationkey % 5 = 0 THEN 1 WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END AS paged FROM nation
""")
def crawl_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls of sites with robots rules, small budgets and broken servers: health, events, and those whose page was read."""
    sources = _registry(spark, sf_dir, "html_generic")
    sources = sources.withColumn("request_budget", F.when(F.regexp_extract("id", r"(\d+)$", 1).cast("int") % 5 == 0, 3).otherwise(F.col("request_budget")))
    events, health = N.crawled(N.Registries(sources), made_up_web, _NOW, W.Policy(retries=0))
    paged = events.groupBy("source").agg(F.count(F.when(F.col("title").startswith("Talk"), 1)).cast("int").alias("paged"))
    return health.join(paged, "source", "left").fillna(0, ["paged"]).select("source", "status", "events", "paged")


def odd_web(url: str, timeout: float) -> W.Answer:
    """One site whose paths each break or bend one rule."""
    rule, to = url.rpartition("/")[2], lambda u: W.Answer(302, headers={"location": u})
    plain = {"robots.txt": W.Answer(200, b"User-agent: *\nDisallow: /%64enied\nAllow: /denied*ok$\n"), "moved": to("/ok"), "down": to("http://o.org/ok"), "away": to("https://p.org/ok"), "loop": to("/loop"), "gone": W.Answer(404), "busy": W.Answer(503), "large": W.Answer(200, b"x" * 3000)}
    return plain.get(rule, W.Answer(200, b"<h1>x</h1>", {"content-type": "text/html"}))


@query("fetch_rules", """
SELECT n_nationkey, CASE n_nationkey % 9 WHEN 0 THEN 'https://o.org/ok' WHEN 1 THEN 'https://o.org/ok' WHEN 8 THEN 'https://o.org/deniedok' END AS final_url,
  CASE n_nationkey % 9 WHEN 2 THEN 'redirect' WHEN 3 THEN 'redirect' WHEN 4 THEN 'redirect' WHEN 5 THEN 'http_status' WHEN 6 THEN 'http_status' WHEN 7 THEN 'too_large' END AS error FROM nation
UNION ALL SELECT n_nationkey + 100, NULL, 'robots_denied' FROM nation WHERE n_nationkey % 9 = 8
""")
def fetch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are moved, moved badly, gone, busy, too large or denied."""
    k = F.col("n_nationkey")
    rules = F.array(*map(F.lit, ["ok", "moved", "down", "away", "loop", "gone", "busy", "large", "deniedok"]))
    nation = table(spark, sf_dir, "nation")
    rows = nation.select(k.alias("n"), F.element_at(rules, (k % 9 + 1).cast("int")).alias("rule")).unionByName(nation.filter(k % 9 == 8).select((k + 100).alias("n"), F.lit("denied").alias("rule")))
    plans = rows.select(F.col("n").cast("string").alias("source"), F.concat(F.lit("https://o.org/"), "rule").alias("url"), F.array(F.lit("o.org")).alias("allowed_hosts"), F.lit(20).alias("request_budget"), F.lit(0).cast("long").alias("ord"))
    found = W.documents(plans, odd_web, _NOW, W.Policy(retries=0, body_bytes=2000))
    return found.select(F.col("source").cast("int").alias("n_nationkey"), "final_url", "error")


@query("page_markup", """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Head ' || s_name WHEN 1 THEN 'Title ' || s_name WHEN 2 THEN 'Shared ' || s_name END AS title,
  CASE s_suppkey % 3 WHEN 0 THEN 'About ' || s_name WHEN 1 THEN 'Shared about' ELSE 'A paragraph that is long enough' END AS description,
  CASE s_suppkey % 5 WHEN 0 THEN '2026-08-03' WHEN 1 THEN '4 August 2026' WHEN 2 THEN '5 August 2026' WHEN 3 THEN 'on 6 August' END AS date_text,
  CASE s_suppkey % 4 WHEN 0 THEN 'Hall A' WHEN 1 THEN 'Room B' WHEN 2 THEN 'Street 1' END AS location_text FROM supplier
""")
def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title, description, date and place stand in different markup."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    head = F.when(k % 4 == 0, F.concat(F.lit("<title>other</title><h1> Head  "), name, F.lit("</h1>"))).when(k % 4 == 1, F.concat(F.lit("<title>Title "), name, F.lit("</title>"))).when(k % 4 == 2, F.concat(F.lit('<meta property="og:title" content="Shared '), name, F.lit('">'))).otherwise("")
    about = F.when(k % 3 == 0, F.concat(F.lit('<meta name="description" content="About '), name, F.lit('"><p>Something else that is long</p>'))).when(k % 3 == 1, '<meta property="og:description" content="Shared about">').otherwise("<p>too short</p><p>A <b>paragraph</b> that is long enough</p>")
    when = F.when(k % 5 == 0, "<time datetime=' 2026-08-03 '>soon</time>").when(k % 5 == 1, "<time>4 August 2026</time>").when(k % 5 == 2, "<span class='event-date'>5 August 2026</span>").when(k % 5 == 3, "<span id='when'>on 6 August</span>").otherwise("")
    place = F.when(k % 4 == 0, "<i class='x location'></i><i class='venue'>Hall A</i>").when(k % 4 == 1, "<i id='place'>Room B</i>").when(k % 4 == 2, "<i class='address'>Street 1</i>").otherwise("")
    docs = _docs(table(spark, sf_dir, "supplier"), k, F.lit("https://m.org/"), F.concat(head, about, when, place))
    return P.rows_of(docs, P.page, P.PAGE, ["source"]).select(F.col("source").cast("int").alias("s_suppkey"), "title", "description", "date_text", "location_text")


@query("calendar_depth", "SELECT n_nationkey, n_nationkey % 12 + 1 > 8 AS refused, CASE WHEN n_nationkey % 12 + 1 BETWEEN 2 AND 8 THEN 1 ELSE 0 END AS events FROM nation")
def calendar_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendars nested one to twelve deep, with folded lines; the innermost part is an event."""
    k = (F.col("n_nationkey") % 12).cast("int")
    inner = F.when(k > 0, "BEGIN:VEVENT\nSUMMARY:Sem\n inar\nURL:https://c.org/1\nDTSTART:20260601\nEND:VEVENT\n").otherwise("")
    deep = F.greatest(k - 1, F.lit(0))
    body = F.concat(F.lit("BEGIN:VCALENDAR\n"), F.repeat(F.lit("BEGIN:X\n"), deep), inner, F.repeat(F.lit("END:X\n"), deep), F.lit("END:VCALENDAR\n"))
    stubs = A.calendar_stubs(_docs(table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.lit("https://c.org/"), body, "text/calendar"))
    found = stubs.groupBy(F.col("source").cast("int").alias("n_nationkey")).agg(F.max(F.col("error").isNotNull()).alias("refused"), F.count(F.when(F.col("title") == "Seminar", 1)).cast("int").alias("events"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(found, "n_nationkey", "left").select("n_nationkey", F.coalesce("refused", F.lit(False)).alias("refused"), F.coalesce("events", F.lit(0)).alias("events"))


@query("configured_details", """
SELECT 'n' || n_nationkey AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'Full ' || n_name ELSE 'Listed ' || n_name END AS title, CASE n_nationkey % 3 WHEN 0 THEN '2026-08-03' ELSE '2026-07-09' END AS start,
  CASE WHEN n_nationkey % 2 = 0 THEN 'Hall' END AS place, CASE WHEN n_nationkey % 2 = 0 THEN 'Ann,Bob' ELSE '' END AS speakers, CASE WHEN n_nationkey % 2 = 0 THEN 'open' ELSE 'unknown' END AS access FROM nation
""")
def configured_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured listings with detail pages that have all fields or only some."""
    keys = {"list": "li", "list_link": "a", "list_title": "b", "list_date": "i", "detail_title": "h1", "detail_date": "time", "detail_location": ".at", "detail_description": "p", "detail_speaker": ".who"}
    specs = _registry(spark, sf_dir, "html_config", selectors="{ " + ", ".join(f'{k} = "{v}"' for k, v in keys.items()) + " }")
    k, nation = F.col("n_nationkey"), table(spark, sf_dir, "nation")
    source = F.concat(F.lit("n"), k.cast("string"))
    site = F.concat(F.lit("https://"), source, F.lit(".org/"))
    listing = F.concat(F.lit("<ul><li><b>Listed "), F.col("n_name"), F.lit("</b><a href='/1'>more</a><i>9 July 2026</i></li><li><a href='/1'>again</a></li></ul>"))
    page = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("<h1>Full "), F.col("n_name"), F.lit("</h1><span class=at>Hall</span><b class=who>Ann</b><b class=who>Bob</b><p>Open access to all</p>"))).otherwise("<p></p>"),
        F.when(k % 3 == 0, "<time datetime='2026-08-03'>x</time>").otherwise("<time>unclear</time>"),
    )
    events, _ = N.collected(N.Registries(specs), _docs(nation, source, site, listing), _docs(nation, source, F.concat(site, F.lit("1")), page), _NOW)
    return events.select("source", "title", F.col("date.start").cast("string").alias("start"), F.col("location.name").alias("place"), F.array_join(F.transform("people", lambda p: p["canonical_name"]), ",").alias("speakers"), F.col("access.access").alias("access"))


@query("linked_details", """
WITH n AS (SELECT 'n' || n_nationkey AS source, n_name, n_nationkey AS k FROM nation)
SELECT source, 'Known ' || n_name AS title, 'Room 1' AS place, 'P,Q' AS speakers, 'P,Q' AS talks, 'registration_required' AS access, 'paged' AS kind FROM n
UNION ALL SELECT source, 'Alone', CASE WHEN k % 2 = 0 THEN 'Room 2' END, 'R', 'Part one', 'open', 'listed' FROM n
UNION ALL SELECT source, 'Twice', NULL, '', '', 'open', 'listed' FROM n UNION ALL SELECT source, 'Twice', NULL, '', '', 'open', 'listed' FROM n
""")
def linked_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD listings that mix events with a page of their own and events without: those are read from the listing, stub by stub."""
    k, nation = F.col("n_nationkey"), table(spark, sf_dir, "nation")
    source = F.concat(F.lit("n"), k.cast("string"))
    site = F.concat(F.lit("https://"), source, F.lit(".org/"))
    known = F.concat(F.lit('{"@type":"Event","name":"Known '), F.col("n_name"), F.lit('","url":"'), site, F.lit('1"'))
    alone = F.concat(F.lit('{"@type":["Thing","TheaterEvent"],"name":"Alone","startDate":"2026-08-03","subEvent":[{"name":"Part one","performer":{"name":"R"}}]'), F.when(k % 2 == 0, ',"location":{"name":"Room 2"}').otherwise(""), F.lit("}"))
    twice = '{"@type":"Event","name":"Twice","location":"a","performer":"X"},{"@type":"Event","name":"Twice","location":"b"}'
    script = lambda *parts: F.concat(F.lit('<script type="application/ld+json">{"@graph":['), *parts, F.lit("]}</script>"))
    listing = F.concat(script(known, F.lit("},"), alone, F.lit("," + twice)), F.lit("<script type='application/ld+json'>{broken</script><p>Open access</p>"))
    page = F.concat(script(known, F.lit(',"location":"Room 1","performer":["P",{"name":"Q"}]}')), F.lit("<p>Registration required</p>"))
    events, _ = N.collected(N.Registries(_registry(spark, sf_dir, "json_ld")), _docs(nation, source, site, listing), _docs(nation, source, F.concat(site, F.lit("1")), page), _NOW)
    names = F.array_join(F.transform("people", lambda p: p["canonical_name"]), ",")
    told = F.array_join(F.transform("talks", lambda t: F.when(t["title"] == F.col("title"), F.array_join(F.transform(t["speaker"], lambda p: p["canonical_name"]), ",")).otherwise(t["title"])), ";")
    return events.select("source", "title", F.col("location.name").alias("place"), names.alias("speakers"), told.alias("talks"), F.col("access.access").alias("access"), F.when(F.col("url").contains("event-node="), "listed").otherwise("paged").alias("kind"))


@query("feed_details", """
SELECT 'n' || n_nationkey AS source, 'Workshop ' || n_name AS title, 'workshop' AS event_type, CASE WHEN n_nationkey % 2 = 0 THEN '2026-09-01' ELSE '2026-08-03' END AS start, CASE WHEN n_nationkey % 2 = 0 THEN 'A page about a conference' END AS description,
  CASE WHEN n_nationkey % 2 = 0 THEN 'slides' END AS media FROM nation
""")
def feed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds whose pages give date, description and media; title and type stay the feed's."""
    k, nation = F.col("n_nationkey"), table(spark, sf_dir, "nation")
    source = F.concat(F.lit("n"), k.cast("string"))
    site = F.concat(F.lit("https://"), source, F.lit(".org/"))
    feed = F.concat(F.lit("<rss><channel><item><title>Workshop "), F.col("n_name"), F.lit("</title><link>"), site, F.lit("1</link><pubDate>Mon, 03 Aug 2026 10:00:00 GMT</pubDate></item></channel></rss>"))
    pages = _docs(nation, source, F.concat(site, F.lit("1")), F.lit("<h1>Conference of the page</h1><p>A page about a conference</p><time>1 September 2026</time><a href='s.pdf'>slides</a>"))
    pages = pages.withColumn("content_type", F.when(F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2 == 0, "text/html; charset=utf-8").otherwise("application/pdf"))
    events, _ = N.collected(N.Registries(_registry(spark, sf_dir, "rss")), _docs(nation, source, site, feed, "text/xml"), pages, _NOW)
    return events.select("source", "title", "event_type", F.col("date.start").cast("string").alias("start"), "description", F.get(F.col("media"), F.lit(0))["media_type"].alias("media"))


@query("channel_events", """
SELECT 'n' || n_nationkey AS source, 'Talk ' || n_name AS title, 'youtube' AS platform, 'open' AS access, 'recording_available' AS online, true AS undated FROM nation
""")
def channel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of videos: each entry is an open recording, and no page is asked."""
    nation, source = table(spark, sf_dir, "nation"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    feed = F.concat(F.lit("<feed><entry><title>Talk "), F.col("n_name"), F.lit("</title><link href='https://www.youtube.com/watch?v=abcdefghijk'/><published>2026-08-03T00:00:00Z</published></entry></feed>"))
    listings = _docs(nation, source, F.concat(F.lit("https://"), source, F.lit(".org/")), feed, "text/xml")
    events, _ = N.collected(N.Registries(_registry(spark, sf_dir, "rss", media_strategy='"youtube_channel"')), listings, listings.limit(0), _NOW)
    m = F.get(F.col("media"), F.lit(0))
    return events.select("source", "title", m["platform"].alias("platform"), m["public_access"].alias("access"), F.col("access.online").alias("online"), m["published_at"].isNull().alias("undated"))


# Output


@query("sink_files", "SELECT 'r' || r_regionkey AS id, r_name AS title, least(length(r_name), 3) AS characters FROM region")
def sink_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON files, and read again."""
    path = shared(spark)
    rows = event_rows(table(spark, sf_dir, "region"), id=F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), title=F.col("r_name"), description=F.left("r_name", F.lit(3)))
    O.write_files(rows, path)
    return spark.read.schema(schema(EVENT)).json(path).select("id", "title", F.length("description").cast("long").alias("characters"))


@query("sink_lines", "SELECT 'event' AS kind, 'r' || r_regionkey AS id, CAST(length(r_name) AS BIGINT) AS size FROM region UNION ALL SELECT 'scan', '1.0', 5")
def sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope's line and a line for each event."""
    rows = event_rows(table(spark, sf_dir, "region"), id=F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), title=F.col("r_name"))
    health = table(spark, sf_dir, "region").select(F.col("r_name").alias("source"))
    out = io.StringIO()
    O.write_lines(rows, O.envelope({}, health, health.limit(0), "2026-06-01T00:00:00Z"), out)
    found = [json.loads(x) for x in out.getvalue().splitlines()]
    told = [(x["kind"], x["id"] if x["kind"] == "event" else x["schema_version"], len(x["title"]) if x["kind"] == "event" else len(x["sources"])) for x in found]
    return spark.createDataFrame(told, "kind string, id string, size long")


@query("sink_schema", """
SELECT * FROM (VALUES ('id', 'string'), ('title', 'string'), ('url', 'string'), ('event_type', 'string'), ('status', 'string'), ('date', 'object'), ('location', 'object'), ('description', 'string'), ('topics', 'array'), ('people', 'array'), ('talks', 'array'),
  ('media', 'array'), ('access', 'object'), ('sources', 'array'), ('score', 'number'), ('score_components', 'object'), ('rank_reasons', 'array'), ('first_seen_at', 'string'), ('last_seen_at', 'string')) t(field, kind)
""")
def sink_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON Schema of events: its fields and their types."""
    made = O.json_schema(schema(EVENT), "Event")
    plain = lambda t: next(x for x in t if x != "null") if isinstance(t, list) else t
    return spark.createDataFrame([(n, plain(p["type"])) for n, p in made["properties"].items()], "field string, kind string")
