"""Documents of all kinds of sources, robots rules, and whole scans."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import urls as U
from ..operators import enrich as E
from ..operators import limits as L
from ..plans import scan as N
from ..plans.tables import written
from ..sources import adapters as A
from ..sources import registry as R
from ..sources import web as W
from . import query, table



def _at() -> Column:
    return F.lit(datetime.datetime(2026, 6, 1, tzinfo=datetime.UTC)).cast("timestamp")


def _docs(rows: DataFrame, source, url, body, kind: str = "text/html", *more: Column) -> DataFrame:
    return rows.select(
        source.cast("string").alias("source"), url.alias("url"), url.alias("final_url"), F.lit(200).alias("status"), F.lit(kind).alias("content_type"),
        body.cast("binary").alias("body"), _at().alias("fetched_at"), F.lit(None).cast("string").alias("error"), *more,
    )


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("rss_parse", """
SELECT s_suppkey AS source, 'Title & ' || s_name AS title, 'https://h.org/' || s_suppkey AS url, '2026-08-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS day, 'id' || s_suppkey AS native_id FROM supplier
""")
def rss_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as feeds of one entry and one without a link."""
    k = F.col("s_suppkey").cast("string")
    day = F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0")
    body = F.concat(F.lit("<rss version='2.0'><channel><item><title>Title &amp; "), F.col("s_name"), F.lit("</title><link>https://h.org/"), k, F.lit("</link><guid>id"), k, F.lit("</guid><pubDate>"), day, F.lit(" Aug 2026 10:00:00 GMT</pubDate></item><item><title>none</title></item></channel></rss>"))
    stubs = A.feed_stubs(_docs(table(spark, sf_dir, "supplier"), k, F.lit("https://h.org/feed"), body, "application/rss+xml"))
    return stubs.select(F.col("source").cast("long").alias("source"), "title", "url", F.col("date_hint")["start"].cast("string").alias("day"), "native_id")


@query("atom_parse", "SELECT n_nationkey AS source, n_name AS title, 'https://h.org/a' || n_nationkey AS url, '2026-01-02' AS day FROM nation")
def atom_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>x</id><title>"), F.col("n_name"), F.lit("</title><link rel='self' href='https://h.org/s'/><link rel='alternate' href='https://h.org/a"), k, F.lit("'/><updated>2026-01-01T23:30:00-02:00</updated></entry></feed>"))
    stubs = A.feed_stubs(_docs(table(spark, sf_dir, "nation"), k, F.lit("https://h.org/feed"), body))
    return stubs.select(F.col("source").cast("int").alias("source"), "title", "url", F.col("date_hint")["start"].cast("string").alias("day"))


@query("json_feed_parse", "SELECT n_nationkey AS source, n_name AS title, 'https://h.org/j' || n_nationkey AS url, '2026-03-04' AS day FROM nation")
def json_feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit('{"items":[{"id":"1","title":"'), F.col("n_name"), F.lit('","url":"https://h.org/j'), k, F.lit('","date_published":"2026-03-04T05:06:07Z"},{"title":"no link"}]}'))
    stubs = A.feed_stubs(_docs(table(spark, sf_dir, "nation"), k, F.lit("https://h.org/feed"), body))
    return stubs.select(F.col("source").cast("int").alias("source"), "title", "url", F.col("date_hint")["start"].cast("string").alias("day"))


@query("ics_parse", """
SELECT o_custkey, o_orderkey, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS first, strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') AS last, 'u' || o_orderkey AS native_id FROM orders
""")
def ics_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar for each customer, with folded lines, an event for each order and one without an address."""
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey").cast("string")
    event = F.concat(F.lit("BEGIN:VEVENT\r\nSUMMARY:Ord\r\n er "), k, F.lit("\r\nUID:u"), k, F.lit("\r\nURL:https://c.org/"), k, F.lit("\r\nDTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd"), F.lit("\r\nDTEND;VALUE=DATE:"), F.date_format(F.date_add(day, 3), "yyyyMMdd"), F.lit("\r\nEND:VEVENT\r\n"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws("", F.sort_array(F.collect_list(event))).alias("events"))
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.col("events"), F.lit("BEGIN:VEVENT\r\nSUMMARY:none\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    stubs = A.calendar_stubs(_docs(rows, F.col("o_custkey"), F.lit("https://c.org/all.ics"), body, "text/calendar"))
    date = F.col("date_hint")
    return stubs.select(F.col("source").cast("long").alias("o_custkey"), F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("o_orderkey"), "title", date["start"].cast("string").alias("first"), date["end"].cast("string").alias("last"), "native_id")


@query("jsonld_parse", """
SELECT p_partkey, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'https://p.org/' || p_partkey WHEN 1 THEN 'https://id.org/' || p_partkey ELSE 'https://p.org/list?event-node=0' END AS url, '2026-05-06' AS day FROM part
""")
def jsonld_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with one event node: with an address, an id, or neither."""
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 3
    where = F.when(kind == 0, F.concat(F.lit(',"url":"https://p.org/'), k, F.lit('"'))).when(kind == 1, F.concat(F.lit(',"@id":"https://id.org/'), k, F.lit('"'))).otherwise("")
    node = F.concat(F.lit('{"@type":["Thing","EducationEvent"],"name":"'), F.col("p_name"), F.lit('","startDate":"2026-05-06T10:00"'), where, F.lit("}"))
    body = F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph":['), node, F.lit(',{"@type":"Person"}]}</script></html>'))
    stubs = A.linked_stubs(_docs(table(spark, sf_dir, "part"), k, F.lit("https://p.org/list"), body))
    return stubs.select(F.col("source").cast("long").alias("p_partkey"), "title", "url", F.col("date_hint")["start"].cast("string").alias("day"))


_SELECTORS = {"list": "ul.events > li", "list_link": "a[href]", "detail_title": "h1.t", "detail_date": "time", "list_date": "span.d:nth-child(2)", "detail_location": None, "detail_description": None, "detail_speaker": "p.who b", "list_title": None}


@query("html_config_parse", """
SELECT c_nationkey AS source, c_name || ' talk' AS title, 'https://n.org/e/' || c_custkey AS url, '2026-07-09' AS day FROM customer
""")
def html_config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list page for each nation with an item for each customer; items repeat, and dates have no year."""
    k = F.col("c_custkey").cast("string")
    item = F.concat(F.lit("<li><a href='/e/"), k, F.lit("'> "), F.col("c_name"), F.lit("<i> talk</i></a><span class='d x'>July 9</span>"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat_ws("", F.sort_array(F.collect_list(item))).alias("items"))
    body = F.concat(F.lit("<body><ul class='events big'>"), F.col("items"), F.col("items"), F.lit("</ul><ul><li><a href='/no'>no</a></ul>"))
    docs = _docs(rows, F.col("c_nationkey"), F.lit("https://n.org/list"), body)
    selectors = F.struct(*[F.lit(_SELECTORS[n]).cast("string").alias(n) for n in R.SELECTORS])
    stubs = A.configured_stubs(docs.withColumn("selectors", selectors))
    return stubs.select(F.col("source").cast("int").alias("source"), "title", "url", F.col("date_hint")["start"].cast("string").alias("day"))


@query("generic_links", """
SELECT s_suppkey, 'Conference on ' || s_name AS title, 'https://g.org/e/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'Notes of 2026', 'https://g.org/n' FROM supplier
UNION ALL SELECT s_suppkey, 'Talks in March', 'https://other.org/m?a=1' FROM supplier WHERE s_suppkey % 3 = 0
""")
def generic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages: links to events by word, year and month, and links that are none: navigation, anchors, mail, no event."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    body = F.concat(
        F.lit("<nav><a href='/'>Conference home</a><a href='#top'>Workshop</a><a href='mailto:a@b.org'>Lecture 2026</a><a href='/x'> Home </a></nav>"),
        F.when(n % 2 == 0, F.concat(F.lit("<a href='/e/"), k, F.lit("'>Conference on "), F.col("s_name"), F.lit("</a>"))).otherwise("<a href='/p'>Photos of staff</a>"),
        F.lit("<a href='n'>Notes of 2026</a><a>no link 2026</a>"), F.when(n % 3 == 0, "<a href='https://other.org/m?a=1'>Talks in March</a>").otherwise("<a href='ftp://x.org/'>Seminar</a>"),
    )
    stubs = A.generic_stubs(_docs(table(spark, sf_dir, "supplier"), k, F.lit("https://g.org/list"), body))
    return stubs.select(F.col("source").cast("int").alias("s_suppkey"), "title", "url")


@query("media_links", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'video' WHEN 1 THEN 'slides' WHEN 2 THEN 'program_pdf' WHEN 3 THEN 'audio' WHEN 4 THEN 'video' ELSE 'abstract_pdf' END AS kind,
  CASE p_partkey % 6 WHEN 0 THEN 'youtube' WHEN 4 THEN 'vimeo' END AS platform, CAST(1 AS INT) AS n FROM part
""")
def media_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a medium of one kind, twice, and a plain link."""
    k = F.col("p_partkey") % 6
    one = (
        F.when(k == 0, '<a href="https://youtu.be/abcdefghijk">w</a><iframe src="https://www.youtube.com/embed/abcdefghijk"></iframe>')
        .when(k == 1, '<a href="/f.PDF">The Slides</a><a href="/f.PDF">again</a>')
        .when(k == 2, '<a href="/x.pdf" title="Programme">x</a>')
        .when(k == 3, '<audio src="/s.mp3"><source src="/s.mp3"></audio>')
        .when(k == 4, '<iframe src="//player.vimeo.com/video/1"></iframe>')
        .otherwise('<a href="/abstracts/1.pdf">x</a>')
    )
    docs = _docs(table(spark, sf_dir, "part"), F.col("p_partkey"), F.lit("https://m.org/p"), F.concat(F.lit("<p>"), one, F.lit('<a href="/plain">plain</a>')))
    fields = A._pages(docs, A.P.page, A.P.PAGE)
    rows = fields.select(F.col("source").cast("long").alias("p_partkey"), A.media_of(F.col("links")).alias("m"))
    return rows.select("p_partkey", F.col("m")[0]["media_type"].alias("kind"), F.col("m")[0]["platform"].alias("platform"), F.size("m").alias("n"))


@query("video_platforms", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'youtube' WHEN 2 THEN 'vimeo' WHEN 3 THEN 'bilibili' END AS platform,
  CASE WHEN o_orderkey % 5 = 0 THEN 'https://www.youtube.com/watch?v=' || lpad(CAST(o_orderkey AS VARCHAR), 11, '0') ELSE (['https://www.youtube.com/about', 'https://player.vimeo.com/1', 'https://www.bilibili.com/video/BV1', 'https://example.org/video/1'])[o_orderkey % 5] END AS canonical FROM orders
""")
def video_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    code = F.lpad(F.col("o_orderkey").cast("string"), 11, "0")
    url = F.when(k == 0, F.concat(F.when(F.col("o_orderkey") % 2 == 0, "https://m.youtube.com/shorts/").otherwise("https://music.youtube.com/shorts/"), code, F.lit("?x=1"))).when(k == 1, "https://www.youtube.com/about").when(k == 2, "https://player.vimeo.com/1").when(k == 3, "https://www.bilibili.com/video/BV1").otherwise("https://example.org/video/1")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.video_platform(url).alias("platform"), C.canonical_media_url(url).alias("canonical"))


_RULES = [("/fr/", False), ("/fr/8*", True), ("/*page=", False), ("/es/*3$", False), ("/en/1", False), ("/en/12", True), ("", False)]


@query("robots_decision", r"""
WITH t AS (SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) END AS p FROM pages),
r(size, allow, re) AS (VALUES (4, false, '^/fr/'), (6, true, '^/fr/8.*'), (7, false, '^/.*page='), (7, false, '^/es/.*3$'), (5, false, '^/en/1'), (6, true, '^/en/12')),
m AS (SELECT page_id, max(size * 2 + CAST(allow AS INT)) AS best FROM t JOIN r ON regexp_matches(p, re) GROUP BY 1)
SELECT t.page_id, coalesce(best % 2 = 1, true) AS allowed FROM t LEFT JOIN m ON t.page_id = m.page_id
""")
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under one set of rules that holds for every origin."""
    target = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    requests = table(spark, sf_dir, "pages").select(F.lit("all").alias("origin"), F.col("page_id").cast("string").alias("url"), F.when(target == "", "/").otherwise(target).alias("target"))
    rules = spark.createDataFrame([("all", p, a) for p, a in _RULES], "origin string, pattern string, allow boolean")
    return W.robots_decisions(requests, rules).select(F.col("url").cast("long").alias("page_id"), "allowed")


@query("host_allowed", r"SELECT page_id, page_id % 3 < 2 OR regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) LIKE 'blog.%' AS allowed FROM pages")
def host_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under a list of their own: empty, with their host, or with it only if it is a blog."""
    host, kind = U.host(F.col("url")), F.col("page_id") % 3
    hosts = F.when(kind == 0, F.array().cast("array<string>")).when((kind == 1) | host.startswith("blog."), F.array(F.lit("x.org"), host)).otherwise(F.array(F.lit("x.org")))
    return table(spark, sf_dir, "pages").select("page_id", W.host_allowed(F.col("url"), hosts).alias("allowed"))


@query("request_budget", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 2 <= 8")
def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("ord"), F.lit(8).alias("request_budget"))
    return W.within_budget(rows).select(F.col("source").alias("o_custkey"), F.col("ord").alias("o_orderkey"))


_TOPICS = [{"id": "articles", "name": "the", "aliases": ["le", "der"]}, {"id": "links", "name": "and", "aliases": ["und", "que"]}, {"id": "places", "name": "of", "aliases": ["de", "von"]}]


def _page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as events of their own hosts."""
    pages = table(spark, sf_dir, "pages")
    docs = _docs(pages, U.host(F.col("url")), F.col("url"), F.col("html"))
    stubs = pages.select(U.host(F.col("url")).alias("source"), F.lit("").alias("title"), "url", F.lit(None).cast("string").alias("native_id"), F.lit(None).cast(A.D.TYPE).alias("date_hint"), F.col("url").alias("source_url"), F.lit(None).cast("string").alias("evidence"), F.col("page_id").alias("stub_ord"))
    return A.enrich_pages(stubs, docs, _at())


@query("scan_ranked_pages")
def scan_ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages to events, matched, scored, without duplicates, scored again, in order."""
    columns = [f.name for f in N.schema(N.EVENT).fields]
    rows = E.with_topics(_page_events(spark, sf_dir).select(columns), _TOPICS)
    tiers: dict[str, str] = {}
    rows = written(E.with_scores(rows, tiers))
    done = E.with_scores(N.dedup.dedup(rows), tiers)
    return L.ranked(done.select("id", "title", "url", "event_type", F.col("score").cast("int").alias("score"), F.transform("topics", lambda t: t["topic_id"]).alias("topics"), F.array_join("rank_reasons", "; ").alias("reasons"), F.size("sources").alias("sources")))


_HEADS, _ABOUT = ["The number of groups", "Groups que meet", "Ring le field", "Theory"], ["a note", "words of the house, with the rest", "und so weiter, de facto"]


@query("page_topic_scores", """
WITH p AS (SELECT s_suppkey, ['The number of groups', 'Groups que meet', 'Ring le field', 'Theory'][s_suppkey % 4 + 1] AS t, ['a note', 'words of the house, with the rest', 'und so weiter, de facto'][s_suppkey % 3 + 1] AS d FROM supplier),
w AS (SELECT s_suppkey, list_transform(string_split(lower(t), ' '), lambda x: x) AS t, string_split(replace(lower(d), ',', ''), ' ') AS d FROM p),
k(topic, word, tenths) AS (VALUES ('articles', 'the', 10), ('articles', 'le', 8), ('articles', 'der', 8), ('links', 'and', 10), ('links', 'und', 8), ('links', 'que', 8), ('places', 'of', 10), ('places', 'de', 8), ('places', 'von', 8)),
f AS (SELECT s_suppkey, topic, max(tenths) AS tenths FROM w JOIN k ON list_contains(t, word) OR list_contains(d, word) GROUP BY ALL)
SELECT w.s_suppkey, coalesce(string_agg(topic || ':' || tenths, ',' ORDER BY topic), '') AS topics, CAST(least(30, 15 * count(topic)) AS INTEGER) AS points FROM w LEFT JOIN f ON w.s_suppkey = f.s_suppkey GROUP BY w.s_suppkey
""")
def page_topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' pages as events: topics of headings and descriptions with their confidence, and what they count."""
    k = F.col("s_suppkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))
    body = F.concat(F.lit('<meta name="description" content="'), pick(_ABOUT, 3), F.lit('"><h1>'), pick(_HEADS, 4), F.lit("</h1>"))
    docs = _docs(table(spark, sf_dir, "supplier"), k, F.concat(F.lit("https://t.org/"), k.cast("string")), body)
    none = F.lit(None).cast("string")
    stubs = docs.select("source", F.lit("").alias("title"), "url", none.alias("native_id"), F.lit(None).cast(A.D.TYPE).alias("date_hint"), F.col("url").alias("source_url"), none.alias("evidence"), F.col("source").cast("long").alias("stub_ord"))
    rows = A.enrich_pages(stubs, docs, _at())
    events = E.with_topics(rows.select(*[f.name for f in N.schema(N.EVENT).fields]), _TOPICS)
    scored = E.with_scores(events, {})
    told = F.array_sort(F.transform("topics", lambda t: F.concat_ws(":", t["topic_id"], F.round(t["confidence"] * 10).cast("int").cast("string"))))
    return scored.select(F.regexp_extract("url", r"(\d+)$", 1).cast("int").alias("s_suppkey"), F.array_join(told, ",").alias("topics"), F.col("score_components.topic").cast("int").alias("points"))


#: Entries of one document of a made-up listing: about 3 MB, as a transport takes 4 MB at most.
_ENTRIES = 20_000


def _listing(rows: DataFrame, entry: Column, name: str, head: str, tail: str, kind: str, most: int = _ENTRIES) -> DataFrame:
    """A listing of all rows' entries in their order, in documents of about ``most`` entries; the first has the source's address."""
    rows = rows.select(entry.alias("entry"))
    parts = max(1, -(-rows.count() // most))
    body = F.concat(F.lit(head), F.concat_ws("", F.sort_array(F.collect_list("entry"))), F.lit(tail)).alias("b")
    if parts == 1:
        made = rows.agg(F.lit(0).alias("part"), body)
    else:
        made = rows.repartitionByRange(parts, "entry").withColumn("part", F.spark_partition_id()).groupBy("part").agg(body)
    part = F.col("part").cast("long")
    url = F.concat(F.lit(f"https://{name}.org/"), F.when(part > 0, F.concat(F.lit("?page="), part.cast("string"))).otherwise(""))
    # Written, as ranges are drawn anew each time that they are computed.
    return written(_docs(made, F.lit(name), url, F.col("b"), kind, part.alias("part")))


@query("scan_registry_sources")
def scan_registry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole scan: two feeds, a calendar and generic listings made from the tables, with their detail pages."""
    toml = "".join(f'[[sources]]\nid = "{i}"\nname = "{i}"\ntier = "{t}"\nadapter = "{a}"\nentrypoint = "https://{i}.org/"\n' for i, t, a in (("feed", "s", "rss"), ("cal", "a", "ics"), ("web", "b", "html_generic")))
    specs = R.sources(spark, toml)
    part, orders, supplier = (table(spark, sf_dir, n) for n in ("part", "orders", "supplier"))
    entry = F.concat(F.lit("<item><title>Workshop "), F.col("p_name"), F.lit("</title><link>https://feed.org/"), F.col("p_partkey").cast("string"), F.lit("</link><pubDate>Mon, 03 Aug 2026 10:00:00 GMT</pubDate></item>"))
    day = F.date_format(F.date_add(F.lit(datetime.date(2026, 5, 1)), (F.col("o_orderkey") % 200).cast("int")), "yyyyMMdd")
    event = F.concat(F.lit("BEGIN:VEVENT\nSUMMARY:Seminar "), F.col("o_custkey").cast("string"), F.lit("\nURL:https://cal.org/"), F.col("o_orderkey").cast("string"), F.lit("\nDTSTART:"), day, F.lit("\nEND:VEVENT\n"))
    link = F.concat(F.lit("<a href='/"), F.col("s_suppkey").cast("string"), F.lit("'>Conference 2026 "), F.col("s_name"), F.lit("</a>"))
    listings = (
        _listing(part, entry, "feed", "<rss><channel>", "</channel></rss>", "application/rss+xml")
        .unionByName(_listing(orders, event, "cal", "BEGIN:VCALENDAR\n", "END:VCALENDAR\n", "text/calendar"))
        .unionByName(_listing(supplier, link, "web", "", "", "text/html"))
    )
    page = F.concat(F.lit("<h1>Conference "), F.col("s_name"), F.lit("</h1><time datetime='2026-08-0"), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit("'></time><p>Open access for all of us, the public</p>"))
    pages = _docs(supplier, F.lit("web"), F.concat(F.lit("https://web.org/"), F.col("s_suppkey").cast("string")), page)
    found = N.run(N.Registries(specs, _TOPICS), listings, pages, N.Query(datetime.date(2026, 6, 15), mode="upcoming", max_events=1000), datetime.datetime(2026, 6, 15, tzinfo=datetime.UTC))
    return found.events.select("id", "title", "event_type", F.col("date")["start"].cast("string").alias("start"), F.col("score").cast("int").alias("score"), F.col("access")["access"].alias("access"), F.size("sources").alias("sources"))
