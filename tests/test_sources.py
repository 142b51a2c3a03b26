"""Parsers, adapters, registries and fetching rules."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from convoke.sources import adapters as A
from convoke.sources import dom
from convoke.sources import parse as P
from convoke.sources import registry as R
from convoke.sources import web as W

NOW = datetime.datetime(2026, 6, 1, tzinfo=datetime.UTC)


def test_tree_and_selectors():
    root = dom.tree('<ul id=m><li class="a b">1<li>2 <b>x</b></ul><p>p<p>q<div>r</div><table><tr><td>c<td>d</table><br>t&amp;u<img alt="<">')
    assert [n.text() for n in root.select("li")] == ["1", "2 x"]
    assert [n.text() for n in root.select("#m > li.a.b, td:last-child")] == ["1", "d"]
    assert [n.text() for n in root.select('ul [class*="a"], li + li b, tr td:nth-child(2n+1)')] == ["1", "x", "c"]
    assert root.first("p").own_text() == "p" and dom.stripped("a <b>b</b>  c") == "a b c"
    for bad in ("", "a,,b", "a:hover", "[x"):
        with pytest.raises(ValueError):
            dom.parsed(bad)
    assert dom.decoded(b"a\xff\xfeb") == "a��b" and dom.decoded(None) == ""


def test_page_fields():
    root = dom.tree('<title>T</title><meta name=description content="D"><h1> H <i>1</i></h1><time datetime="2026-01-02">x</time><div class="venue">Room 1</div>')
    found = P.page_fields(root)
    assert (found["title"], found["description"], found["date_text"], found["location_text"]) == ("H 1", "D", "2026-01-02", "Room 1")
    empty = P.page_fields(dom.tree(""))
    assert empty["title"] is None and empty["date_text"] is None


def test_feeds():
    assert P.feed({"body": b'{"items":[]}'}) == []
    for body in (b"<!DOCTYPE x [<!ENTITY a 'b'>]><rss/>", b"<rss><channel>", b"<html></html>", b'{"a":1}', b"{"):
        with pytest.raises(P.ParseError):
            P.feed({"body": body})


def test_calendars():
    nested = "BEGIN:VCALENDAR\n" + "BEGIN:X\n" * 8 + "END:X\n" * 8 + "END:VCALENDAR"
    with pytest.raises(P.ParseError):
        P.calendar({"body": nested.encode()})
    with pytest.raises(P.ParseError):
        P.calendar({"body": b"hello"})


def test_calendar_columns(spark):
    rows = spark.createDataFrame([("20260803", "20260808", None), ("20260803", "20260803", None), ("20260803T100000Z", "20260804T100000Z", None), ("20260803", None, "P3D"), ("20260803", "20260801", "-P1D"), ("x", None, None), ("20260803", None, "PT3H")], "s string, e string, p string")
    got = rows.select(A.calendar_range(F.col("s"), F.col("e"), F.col("p")).alias("d")).collect()
    assert [(str(r.d.start), str(r.d.end)) if r.d else None for r in got] == [("2026-08-03", "2026-08-07"), ("2026-08-03", "2026-08-03"), ("2026-08-03", "2026-08-04"), ("2026-08-03", "2026-08-05"), ("2026-08-03", "None"), None, ("2026-08-03", "None")]
    assert [r[0] for r in spark.createDataFrame([("P1W2D",), ("+P1D",), ("-P1D",), ("PT5H",), ("P",), ("1D",)], "v string").select(A.duration_days(F.col("v"))).collect()] == [9, 1, None, 0, None, None]


def docs(spark, rows):
    shape = "source string, url string, final_url string, status int, content_type string, body binary, fetched_at timestamp, error string"
    return spark.createDataFrame([(s, u, u, 200, k, b, NOW, None) for s, u, k, b in rows], shape)


def test_linked_pages(spark):
    body = b"""<script type="application/ld+json">[{"@type":"Event","name":"A","url":"https://e.org/a","startDate":"2026-08-08","performer":["P"],"location":"Hall","description":"<b>x</b> y"},
      {"@type":"Event","name":"B","startDate":"2026-08-09","subEvent":[{"name":"S","performer":{"name":"Q"}}]}]</script>"""
    listing = docs(spark, [("s", "https://e.org/", "text/html", body)])
    stubs = A.linked_stubs(listing)
    assert [(r.title, r.url) for r in stubs.orderBy("stub_ord").collect()] == [("A", "https://e.org/a"), ("B", "https://e.org/?event-node=1")]
    pages = docs(spark, [("s", "https://e.org/a", "text/html", body), ("s", "https://e.org/", "text/html", body)])
    events = {r.title: r for r in A.enrich_linked(stubs, pages, F.lit(NOW)).collect()}
    assert events["A"].location.name == "Hall" and events["A"].description == "x y" and [p.canonical_name for p in events["A"].people] == ["P"]
    assert [t.title for t in events["B"].talks] == ["S"] and str(events["B"].date.start) == "2026-08-09"


def test_feed_pages_and_channels(spark):
    toml = '[[sources]]\nid="f"\nname="F"\nadapter="rss"\nentrypoint="https://f.org/"\n[[sources]]\nid="v"\nname="V"\nadapter="rss"\nentrypoint="https://v.org/"\nmedia_strategy="youtube_channel"\n'
    specs = R.validated(R.sources(spark, toml))
    entry = lambda u: f"<rss><channel><item><title>Talk</title><link>{u}</link><pubDate>Mon, 03 Aug 2026 10:00:00 GMT</pubDate></item></channel></rss>".encode()
    listing = docs(spark, [("f", "https://f.org/", "text/xml", entry("https://f.org/1")), ("v", "https://v.org/", "text/xml", entry("https://youtu.be/abcdefghijk"))])
    stubs = A.discover(listing, specs, ["rss"])
    pages = docs(spark, [("f", "https://f.org/1", "text/html; charset=utf-8", b'<h1>Better title</h1><time>soon</time><a href="s.pdf">slides</a>')])
    got = {r.source: r for r in A.enrich(stubs, pages, specs, ["rss"], F.lit(NOW)).collect()}
    # The feed's own title is the event's; a page's date text that is no date loses the feed's date: kept so on purpose.
    assert got["f"].title == "Talk" and got["f"].date.precision == "unknown" and got["f"].media[0].media_type == "slides"
    assert got["v"].media[0].public_access == "open" and got["v"].access.online == "recording_available" and str(got["v"].date.start) == "2026-08-03"
    assert got["v"].media[0].platform == "youtube" and got["v"].media[0].published_at is None
    assert [(r.source, r.title, bool(r.error)) for r in A.ADAPTERS["indico"].discover(listing).orderBy("source").collect()] == [("f", None, True), ("v", None, True)]


def test_one_bad_body_is_one_error(spark):
    good = b"<rss><channel><item><title>T</title><link>https://e.org/1</link></item></channel></rss>"
    deep = b'<script type="application/ld+json">' + b"[" * 100_000 + b"</script>"
    bodies = {
        "good": good, "cut": good[:-20], "typed": b'{"items":[{"title":"x","url":{"a":1}}]}', "number": b'{"items":[{"title":7,"url":"https://e.org/2"}]}', "date": b'{"items":[{"title":"x","url":"https://e.org/3","date_published":20260801}]}',
        "list": b"[1]", "entity": b"<!DOCTYPE x><rss/>", "nothing": b"",
    }
    rows = A.feed_stubs(docs(spark, [(k, f"https://{k}.org/", "text/xml", b) for k, b in bodies.items()])).collect()
    assert {r.source: r.error is None for r in rows} == {k: k == "good" for k in bodies}
    found = A.linked_stubs(docs(spark, [("deep", "https://d.org/", "text/html", deep), ("fine", "https://f.org/", "text/html", b'<script type="application/ld+json">{"@type":"Event","name":"A"}</script>')])).collect()
    assert [(r.source, r.title) for r in found if r.error is None] == [("fine", "A")]

    def odd(row):
        if row["source"] == "raises":
            raise RecursionError("deep")
        return [{"title": 5 if row["source"] == "wrong" else "x"}]

    three = docs(spark, [(k, "u", "t", b"") for k in ("raises", "wrong", "right")]).coalesce(1)
    assert {r.source: (r.title, r.error is None) for r in P.rows_of(three, odd, "title string", ["source"]).collect()} == {"raises": (None, False), "wrong": (None, False), "right": ("x", True)}


def test_adapters_can_be_added(spark):
    def lines(listings):
        rows = P.rows_of(listings, lambda r: [{"title": t} for t in r["body"].decode().split("\n") if t], "title string", ["source", "final_url"])
        none = F.lit(None).cast("string")
        return rows.select("source", "title", F.concat("final_url", "title").alias("url"), none.alias("native_id"), F.lit(None).cast(A.D.TYPE).alias("date_hint"), F.col("final_url").alias("source_url"), none.alias("evidence"), F.col("ord").alias("stub_ord"), "error")

    A.register("lines", A.Adapter(lines, lambda stubs, pages, specs, now: A.enrich_calendar(stubs, pages, now)))
    try:
        specs = R.validated(R.sources(spark, '[[sources]]\nid="x"\nname="X"\nadapter="lines"\nentrypoint="https://x.org/"\n'))
        listing = docs(spark, [("x", "https://x.org/", "text/plain", b"one\ntwo\n")])
        stubs = A.discover(listing, specs, ["lines"])
        assert sorted((r.title, r.status) for r in A.enrich(stubs, listing.limit(0), specs, ["lines"], F.lit(NOW)).collect()) == [("one", "announced"), ("two", "announced")]
        with pytest.raises(ValueError, match="there is an adapter"):
            A.register("lines", A.ADAPTERS["rss"])
    finally:
        del A.ADAPTERS["lines"]
    with pytest.raises(R.RegistryError):
        R.sources(spark, '[[sources]]\nid="x"\nname="X"\nadapter="lines"\n')


def test_configured_pages(spark):
    toml = """[[sources]]
id = "c"
name = "C"
adapter = "html_config"
entrypoint = "https://c.org/"
[sources.selectors]
list = "li"
list_link = "a"
list_date = "i"
detail_title = "h1"
detail_date = "time"
detail_speaker = "b.who"
"""
    specs = R.sources(spark, toml)
    listing = docs(spark, [("c", "https://c.org/", "text/html", b"<li><a href=/1>One</a><i>July 9</i><li><a href=/2>Two</a><li><a>no link</a>")])
    stubs = A.discover(listing, specs, ["html_config"])
    pages = docs(spark, [("c", "https://c.org/1", "text/html", b"<h1>First</h1><time>unclear</time><b class=who>Ann</b><b class=who>Bob</b>")])
    got = {r.url[-1]: r for r in A.enrich(stubs, pages, specs, ["html_config"], F.lit(NOW)).collect()}
    assert got["1"].title == "First" and str(got["1"].date.start) == "2026-07-09" and [t.speaker[0].canonical_name for t in got["1"].talks] == ["Ann", "Bob"]
    assert got["2"].title == "Two" and got["2"].date.precision == "unknown" and got["2"].access.access == "unknown"


def test_registry(spark):
    with pytest.raises(R.RegistryError):
        R.sources(spark, '[[sources]]\nid="a"\nname="A"\ncolour="red"\n')
    with pytest.raises(R.RegistryError):
        R.sources(spark, '[[sources]]\nid="a"\nname="A"\ntier="z"\n')
    bad = R.sources(spark, '[[sources]]\nid="a"\nname=" "\nenabled=false\n[[sources]]\nid="a"\nname="B"\n')
    assert [(r.ord, r.rule) for r in R.violations(bad).orderBy("ord", "rule_ord").collect()] == [(0, "empty name"), (1, "duplicate id"), (1, "missing entrypoint")]
    with pytest.raises(R.RegistryError, match="a: empty name"):
        R.validated(bad)
    assert R.sources(spark, "").count() == 0
    assert R.interests("[interests]\nx = 0.5") == {"x": 0.5}


def test_robots():
    text = "# c\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: Convoke\nUser-agent: x\nDisallow: /p*q$\nDisallow:\nDisallow: /%7eu\n"
    own = W.parse_robots(text)
    assert own.allows("https://e.org/a") and not own.allows("https://e.org/pxq") and own.allows("https://e.org/pxqz") and not own.allows("https://e.org/~u/1")
    rest = W.parse_robots(text, "nobody")
    assert not rest.allows("https://e.org/a") and rest.allows("https://e.org/a/b") and rest.allows("https://e.org/")
    assert W.parse_robots("Disallow: /").allows("https://e.org/") and not W.NOTHING.allows("https://e.org/x?y")
    assert W.Robots((("/x", False), ("/x", True))).allows("https://e.org/x")
    assert not W.glob("/a*b$", "/abxb") and W.glob("/a*b$", "/axxb") and W.glob("/*", "/")


class Web:
    """A transport from a table of addresses."""

    def __init__(self, pages):
        self.pages, self.sent = pages, []

    def __call__(self, url, timeout):
        self.sent.append(url)
        got = self.pages.get(url, W.Answer(404))
        return got.pop(0) if isinstance(got, list) else got


def fetch(web, url, hosts=("e.org",), budget=20):
    client = W.Client(web, sleep=lambda s: None)
    return client.fetch(url, list(hosts), W.Budget(budget), client.clock() + 30)


def test_requests():
    to = lambda u: W.Answer(302, headers={"location": u})
    web = Web({"https://e.org/a": to("/b"), "https://e.org/b": W.Answer(200, b"x")})
    assert fetch(web, "https://e.org/a")[0] == "https://e.org/b" and web.sent.count("https://e.org/robots.txt") == 1
    for pages, kind in (
        ({"https://e.org/a": to("http://e.org/b")}, "redirect"),
        ({"https://e.org/a": to("https://f.org/b")}, "redirect"),
        ({"https://e.org/a": to("/a")}, "redirect"),
        ({"https://e.org/a": W.Answer(404)}, "http_status"),
        ({"https://e.org/a": [W.Answer(503), W.Answer(503)]}, "http_status"),
        ({"https://e.org/robots.txt": W.Answer(500)}, "robots_denied"),
        ({"https://e.org/robots.txt": W.Answer(200, b"User-agent: *\nDisallow: /a")}, "robots_denied"),
        ({"https://e.org/a": W.Answer(200, b"x" * (5 << 20))}, "too_large"),
    ):
        with pytest.raises(W.FetchError) as e:
            fetch(Web(pages), "https://e.org/a")
        assert e.value.kind == kind
    assert fetch(Web({"https://e.org/a": [W.Answer(429, headers={"retry-after": "1"}), W.Answer(200, b"y")]}), "https://e.org/a")[1].body == b"y"
    with pytest.raises(W.FetchError) as e:
        fetch(Web({"https://e.org/a": W.Answer(200)}), "https://e.org/a", budget=1)
    assert e.value.kind == "budget_exhausted"
    assert W.retry_after("120", NOW) == 120 and W.retry_after("Mon, 01 Jun 2026 00:01:00 GMT", NOW) == 60 and W.retry_after("Tue, 01 Jun 2026 00:01:00 GMT", NOW) is None


def test_fetched_documents(spark):
    def answer(url, timeout):
        return W.Answer(404) if url.endswith("robots.txt") else W.Answer(200, url.encode(), {"content-type": "text/html"}) if "ok" in url else W.Answer(500)

    plans = spark.createDataFrame([("s", "https://e.org/ok", ["e.org"], 3, 1), ("s", "https://e.org/bad", ["e.org"], 3, 2), ("t", "https://f.org/ok", [], 9, 1)], "source string, url string, allowed_hosts array<string>, request_budget int, ord int")
    rows = W.documents(plans, answer, NOW, W.Policy(retries=0))
    assert {r.source: (max(x.requests for x in rows.collect() if x.source == r.source), r.rules) for r in rows.collect() if "ok" in r.url} == {"s": (3, '[["https://e.org", ["e.org"], []]]'), "t": (2, '[["https://f.org", [], []]]')}
    got = {(r.source, r.url): (r.status, r.error) for r in rows.collect()}
    # Robots rules that are known aren't asked again, and what is spent counts.
    again = plans.withColumns({"spent": F.lit(1), "rules": F.lit('[["https://e.org", ["e.org"], [["/bad", false]]]]')})
    told = {(r.source, r.url[-3:]): (r.error, r.requests) for r in W.documents(again, answer, NOW, W.Policy(retries=0)).collect()}
    assert told[("s", "/ok")] == (None, 2) and told[("s", "bad")] == ("robots_denied", 2) and told[("t", "/ok")] == (None, 3)

    def broken(url, timeout):
        assert 0 < timeout.connect <= 5 and timeout <= 15
        if "bad" in url:
            raise KeyError(url)
        return answer(url, timeout)

    assert {r.url[-3:]: r.error for r in W.documents(plans.filter("source = 's'"), broken, NOW).collect()} == {"/ok": None, "bad": "network"}
    assert got == {("s", "https://e.org/ok"): (200, None), ("s", "https://e.org/bad"): (None, "http_status"), ("t", "https://f.org/ok"): (200, None)}
