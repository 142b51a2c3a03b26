"""Stored state over several scans, whole scans, output and streams."""

from __future__ import annotations

import datetime
import io
import json

import pytest
from pyspark.sql import functions as F

from convoke.__main__ import main
from convoke.plans import output as O
from convoke.plans import scan as N
from convoke.plans import state as S
from convoke.schemas import EVENT, HEALTH, schema
from convoke.sources import files
from convoke.sources import registry as R
from convoke.sources import web as W
from convoke.streaming import scans as Z

from .test_operators import event, frame, source

UTC = datetime.UTC


def at(day):
    return datetime.datetime(2026, 1, 1, tzinfo=UTC) + datetime.timedelta(days=day)


def health(spark, *status):
    return spark.createDataFrame([(f"s{k}", s, 1, 1, 1, None, None) for k, s in enumerate(status)], schema(HEALTH))


def kinds(changes):
    return sorted((r.event_id, r.kind) for r in changes.collect())


def test_scans_in_a_row(spark, tmp_path):
    store = S.ScanStore(spark, f"file://{tmp_path}/state")
    put = lambda ids, day, *status: store.store_scan(frame(spark, [event(i) for i in ids]), health(spark, *status), at(day))
    _, changes = put("ab", 0, "ok")
    assert kinds(changes) == [("a", "event_added"), ("b", "event_added")]
    stored, changes = put("ac", 1, "ok", "ok")
    assert kinds(changes) == [("b", "event_cancelled"), ("c", "event_added")] and store.table("tombstones").count() == 1
    first = {r.id: r.first_seen_at for r in stored.collect()}
    assert first["a"] == at(0).replace(tzinfo=None) and first["c"] == at(1).replace(tzinfo=None)
    _, changes = put("a", 2, "ok", "timeout")
    assert kinds(changes) == [] and {r.id for r in store.list_events().collect()} == {"a", "c"}
    stored, _ = put("abc", 30, "ok")
    assert {r.id: r.first_seen_at.day for r in stored.collect()}["b"] == 1 and store.table("tombstones").count() == 0
    put("a", 31, "ok")
    stored, changes = put("ab", 31 + 91, "ok")
    assert stored.filter("id = 'b'").first().first_seen_at == at(122).replace(tzinfo=None) and store.table("tombstones").count() == 0
    assert {r.detected_at for r in store.table("changes").collect()} == {at(122).replace(tzinfo=None)}
    assert [r.recorded_at for r in store.list_health("s0").collect()] == [at(122).replace(tzinfo=None)]
    assert store.get_event("a").count() == 1 and store.list_changes(at(122)).count() == store.table("changes").count()
    store.vacuum()
    assert store.list_events().count() == 2 and store.schema_version() == 3


def test_state_guards(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    with pytest.raises(S.StateError):
        S.ScanStore(spark, path, read_only=True)
    store = S.ScanStore(spark, path)
    reader = S.ScanStore(spark, path, read_only=True)
    with pytest.raises(S.StateError):
        reader.store_scan(frame(spark, [event("a")]), health(spark, "ok"), at(0))
    seen = store.pointer()
    store.store_event(frame(spark, [event("a")]), at(0))
    with pytest.raises(S.StateError):
        store._commit({n: store.table(n) for n in S.TABLES}, seen)
    assert reader.list_events().count() == 1
    store.store_event(frame(spark, [event("a", title="new")]), at(3))
    row = store.get_event("a").first()
    assert row.title == "new" and row.first_seen_at == at(0).replace(tzinfo=None) and row.last_seen_at == at(3).replace(tzinfo=None)
    (tmp_path / "state" / "CURRENT.9").write_text(json.dumps({"schema": 9, "version": 9, "folder": None}))
    with pytest.raises(S.StateError):
        S.ScanStore(spark, path)


def test_a_commit_is_whole_or_not(spark, tmp_path, monkeypatch):
    """A crash after any step leaves the old version, and of two writers one fails."""
    path = f"file://{tmp_path}/state"
    store = S.ScanStore(spark, path)
    put = lambda s, ids, day: s.store_scan(frame(spark, [event(i) for i in ids]), health(spark, "ok"), at(day))
    put(store, "a", 0)
    kept = lambda: [(r.id for r in s.list_events().collect()) and [r.id for r in s.list_events().collect()] for s in [S.ScanStore(spark, path)]][0]

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    monkeypatch.setattr(S, "put_once", crash)
    with pytest.raises(Crash):
        put(store, "b", 1)
    monkeypatch.undo()
    assert kept() == ["a"] and store.table("changes").count() == 1
    # The pointer's file was written, but never got its name.
    (tmp_path / "state" / "_new-left").write_text("half")
    assert kept() == ["a"]
    one, other = S.ScanStore(spark, path), S.ScanStore(spark, path)
    seen = other.pointer()
    put(one, "b", 2)
    monkeypatch.setattr(other, "pointer", lambda: seen)
    with pytest.raises(S.StateError):
        put(other, "c", 2)
    monkeypatch.undo()
    assert kept() == ["b"] and sorted(r.kind for r in store.table("changes").collect()) == ["event_added", "event_added", "event_cancelled"]
    put(S.ScanStore(spark, path), "c", 3)
    assert kept() == ["c"]


def test_logs_grow_by_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "LOGS", 3)
    store = S.ScanStore(spark, f"file://{tmp_path}/state")
    for day in range(5):
        store.store_scan(frame(spark, [event(str(day))]), health(spark, "ok", "ok"), at(day))
        assert len(store.pointer()["logs"]["health"]) <= 3
    store.store_scan(frame(spark, [event("4")]), health(spark, "timeout"), at(4))
    assert store.table("health").count() == 10 and [r.status for r in store.list_health("s0").collect()][-2:] == ["ok", "timeout"]
    assert store.table("changes").filter("kind = 'event_added'").count() == 5
    store.store_event(frame(spark, [event("x")]), at(5))
    store.vacuum(1)
    assert store.table("health").count() == 10 and {r.id for r in store.list_events().collect()} == {"4", "x"}
    fresh = S.ScanStore(spark, f"file://{tmp_path}/other")
    fresh.store_event(frame(spark, [event("y")]), at(0))
    assert fresh.table("health").count() == 0 and fresh.table("changes").count() == 0 and fresh.list_events().count() == 1


def test_migration(spark, tmp_path):
    path = f"file://{tmp_path}/old"
    spark.createDataFrame([("a", "t")], "id string, title string").write.parquet(f"{path}/v000000001/events")
    (tmp_path / "old" / "CURRENT").write_text(json.dumps({"schema": 1, "version": 1, "folder": "v000000001"}))
    store = S.ScanStore(spark, path)
    assert store.schema_version() == 3 and store.list_events().first().title == "t" and store.table("tombstones").count() == 0
    bad = f"file://{tmp_path}/bad"
    spark.createDataFrame([(None, "t")], "id string, title string").write.parquet(f"{bad}/v000000001/events")
    (tmp_path / "bad" / "CURRENT").write_text(json.dumps({"schema": 2, "version": 1, "folder": "v000000001"}))
    with pytest.raises(S.StateError):
        S.ScanStore(spark, bad)


def scanned(spark, store, day, titles, query=None):
    toml = '[[sources]]\nid = "web"\nname = "W"\ntier = "s"\nadapter = "html_generic"\nentrypoint = "https://web.org/"\n[[sources]]\nid = "gone"\nname = "G"\nadapter = "rss"\nentrypoint = "https://gone.org/"\nenabled = false\n'
    registries = N.Registries(R.sources(spark, toml), [{"id": "x", "name": "Number Theory", "aliases": []}], [], {"x": 0.0})
    shape = "source string, url string, final_url string, status int, content_type string, body binary, fetched_at timestamp, error string"
    row = lambda u, b: ("web", u, u, 200, "text/html", b.encode(), at(day), None)
    links = "".join(f"<a href='/{k}'>Conference {t}</a>" for k, t in enumerate(titles)) + "<a href='/0'>Conference again</a><a href='/about'>About</a>"
    listing = spark.createDataFrame([row("https://web.org/", links)], shape)
    pages = spark.createDataFrame([row(f"https://web.org/{k}", f"<h1>Conference {t}</h1><time>2 August 2026</time><p>open access</p>") for k, t in enumerate(titles)], shape)
    return N.run(registries, listing, pages, query or N.Query(datetime.date(2026, 6, 1)), at(day), store)


def test_whole_scan(spark, tmp_path):
    store = S.ScanStore(spark, f"file://{tmp_path}/state")
    one = scanned(spark, store, 0, ["of Number Theory", "B"])
    events = one.events.collect()
    # Two links to one page are one event; the topic counts 8 at weight 0, the tier 10.
    assert [(e.title, e.score, len(e.sources)) for e in events] == [("Conference of Number Theory", 18.0, 1), ("Conference B", 10.0, 1)]
    assert events[0].rank_reasons == ["matched_topic: x", "major_research_institute"] and events[0].access.access == "open" and events[0].event_type == "conference"
    assert [(h.source, h.status, h.events) for h in one.health.collect()] == [("web", "ok", 3)]
    two = scanned(spark, store, 1, ["of Number Theory"])
    assert [(c.kind) for c in two.changes.collect()] == ["event_cancelled"]
    hidden = scanned(spark, None, 1, ["of Number Theory"], N.Query(datetime.date(2027, 6, 1)))
    assert hidden.events.count() == 0 and hidden.changes.count() == 0
    with pytest.raises(N.ScanError):
        N.Query(datetime.date(2026, 1, 1), mode="never")


def test_listing_stands_in_for_pages(spark):
    toml = '[[sources]]\nid = "ld"\nname = "L"\nadapter = "json_ld"\nentrypoint = "https://ld.org/"\n'
    body = b'<script type="application/ld+json">[{"@type":"Event","name":"A","startDate":"2026-06-20","description":"long"},{"@type":"Event","name":"B","startDate":"2026-06-21"}]</script>'
    listing = files.documents(spark.createDataFrame([("ld", "https://ld.org/", body, at(0))], "source string, url string, body binary, fetched_at timestamp"))
    found = N.run(N.Registries(R.sources(spark, toml)), listing, listing.limit(0), N.Query(datetime.date(2026, 6, 1)), at(0))
    assert [(e.title, str(e.date.start), e.description) for e in found.events.orderBy("title").collect()] == [("A", "2026-06-20", "long"), ("B", "2026-06-21", None)]


def test_commands(spark, tmp_path):
    (tmp_path / "s.toml").write_text('[[sources]]\nid = "cal"\nname = "Cal"\ntier = "s"\nadapter = "ics"\nentrypoint = "https://cal.org/"\n')
    (tmp_path / "t.toml").write_text('[[topics]]\nid = "x"\nname = "Topology"\n')
    ics = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:Topology seminar\nURL:https://cal.org/1\nDTSTART;VALUE=DATE:20260610\nEND:VEVENT\nEND:VCALENDAR"
    spark.createDataFrame([("cal", "https://cal.org/", ics)], "source string, url string, body string").write.json(f"{tmp_path}/l.json")
    spark.createDataFrame([], "source string, url string, body binary").write.parquet(f"{tmp_path}/p")
    use = ["scan", "--listings", f"{tmp_path}/l.json", "--pages", f"{tmp_path}/p", "--sources", f"{tmp_path}/s.toml", "--topics", f"{tmp_path}/t.toml", "--today", "2026-06-01", "--state", f"{tmp_path}/state"]
    out = io.StringIO()
    assert main(use, out, at(0)) == 0
    found = json.loads(out.getvalue())
    assert [(e["title"], e["score"], e["status"]) for e in found["events"]] == [("Topology seminar", 25.0, "announced")] and [c["kind"] for c in found["changes"]] == ["event_added"]
    for args, text in ((["doctor", "--state", f"{tmp_path}/state"], '"events": 1'), (["sources", "--sources", f"{tmp_path}/s.toml"], "cal "), (["schema"], "rank_reasons")):
        out = io.StringIO()
        assert main(args, out) == 0 and text in out.getvalue()
    (tmp_path / "bad.toml").write_text('[[sources]]\nid = "a"\nname = ""\nentrypoint = "https://a.org/"\n')
    assert main([*use[:5], "--sources", f"{tmp_path}/bad.toml"], io.StringIO()) == 3
    assert main(["doctor", "--state", f"{tmp_path}/none"], io.StringIO()) == 5
    (tmp_path / "off.toml").write_text('[[sources]]\nid = "a"\nname = "A"\nenabled = false\n')
    assert main([*use[:5], "--sources", f"{tmp_path}/off.toml"], io.StringIO()) == 4


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<h1>x</h1>")
    index = spark.createDataFrame([("a.html", "s", "https://e.org/a", "text/html"), ("b.html", "s", "https://e.org/b", "text/html")], "file string, source string, url string, content_type string")
    rows = files.read_folder(spark, f"file://{tmp_path}", index).collect()
    assert [(r.url, r.final_url, bytes(r.body), r.error) for r in rows] == [("https://e.org/a", "https://e.org/a", b"<h1>x</h1>", None)]


def test_output(spark):
    events = frame(spark, [event("a", description="x" * 2000, sources=[source()]), event("b", title="é")])
    around = O.envelope({"mode": "both"}, health(spark, "ok"), spark.createDataFrame([], "event_id string"), "2026-01-01T00:00:00Z")
    for write in (O.write_json, O.write_lines):
        out = io.StringIO()
        write(O.detailed(events), around, out)
        text = out.getvalue()
        if write is O.write_json:
            found = json.loads(text)
            assert [len(e.get("description", "")) for e in found["events"]] == [1200, 0] and found["sources"][0]["status"] == "ok"
        else:
            lines = [json.loads(x) for x in text.splitlines()]
            assert [x["kind"] for x in lines] == ["scan", "event", "event"]
    out = io.StringIO()
    O.write_json(events.limit(0), around, out)
    assert json.loads(out.getvalue())["events"] == []


def test_json_schema():
    now = O.json_schema(schema(EVENT), "Event")
    assert now["properties"]["date"]["properties"]["start"]["format"] == "date" and now["properties"]["talks"]["items"]["properties"]["speaker"]["type"] == "array"
    assert O.breaks(now, now) == []
    less = json.loads(json.dumps(now))
    del less["properties"]["talks"]["items"]["properties"]["title"]
    less["required"] = ["id"]
    assert O.breaks(now, less) == ["/talks[]/title: removed", "/id: required"]
    assert O.breaks(less | {"required": []}, now) == []


def test_stream_of_scans(spark, tmp_path):
    """Scans of several files, the second one split over two batches."""
    store = S.ScanStore(spark, f"file://{tmp_path}/state")
    parts = [("0", 0, "a", False), ("0", 0, "b", True), ("1", 1, "b", False), ("1", 1, "c", False), ("1", 1, "", True), ("2", 2, "d", False)]
    for k, (scan, day, ids, last) in enumerate(parts):
        rows = [event(i) for i in ids] + ([event(None)] if last else [])
        frame(spark, rows).withColumns({"scan_id": F.lit(scan), "scanned_at": F.lit(at(day))}).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/0").schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = spark.createDataFrame([("0", "s", "ok"), ("1", "s", "timeout")], "scan_id string, source string, status string")
    for c, t in (("duration_ms", "long"), ("requests", "int"), ("events", "int"), ("message", "string"), ("recorded_at", "timestamp")):
        found = found.withColumn(c, F.lit(None).cast(t))
    for k in range(2):
        Z.store_scans(stream, found, store, f"file://{tmp_path}/check{k}").awaitTermination()
        # A scan that hasn't ended isn't stored; one whose source was unhealthy cancels nothing.
        assert {r.id for r in store.list_events().collect()} == {"a", "b", "c"} and kinds(store.table("changes")) == [("a", "event_added"), ("b", "event_added"), ("c", "event_added")]
    assert store.pointer()["version"] == 2 and sorted(store.pointer()["scans"]) == ["0", "1"]


def test_state_of_sightings_goes(spark, tmp_path):
    """After the retention nothing is kept of an id that was not seen again."""
    rows = spark.createDataFrame([("a", at(0)), ("b", at(0))], "id string, seen_at timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    seen = []

    def run():
        query = Z.first_seen(stream, 1).writeStream.outputMode("update").foreachBatch(lambda f, n: seen.append(sorted((r.id, r.sightings) for r in f.collect()))).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert run() == 2
    spark.createDataFrame([("c", at(10))], rows.schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 1 and seen[0] == [("a", 1), ("b", 1)] and [("c", 1)] in seen


def test_talks_of_many_events(spark):
    rows = frame(spark, [event(f"{k:03d}", score=float(k // 10), talks=[]) for k in range(50)])
    talk = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema["talks"].dataType.elementType.fields])
    rows = rows.withColumn("talks", F.array_repeat(talk, F.col("id").cast("int") % 4))
    for most in (1, 3, 7, 20, 74, 75, 500):
        want, left = [], most
        for r in sorted(rows.collect(), key=lambda r: (-r.score, r.id)):
            if left > 0:
                want.append((r.id, min(len(r.talks), left)))
                left -= len(r.talks)
        assert sorted((r.id, len(r.talks)) for r in N.limits.talk_budget(rows, most).collect()) == sorted(want)


def test_crawl(spark, tmp_path):
    """Pages come through a transport; the second crawl finds one gone, and a broken listing cancels nothing."""
    toml = '[[sources]]\nid = "w"\nname = "W"\nadapter = "html_generic"\nentrypoint = "https://w.org/"\n[[sources]]\nid = "v"\nname = "V"\nadapter = "rss"\nentrypoint = "https://w.org/feed"\n'
    entry = lambda k: f"<item><title>Seminar {k}</title><link>https://w.org/s{k}</link><pubDate>Mon, 03 Aug 2026 10:00:00 GMT</pubDate></item>"

    def web(links, feed):
        def answer(url, timeout):
            path = url.removeprefix("https://w.org")
            if path == "/robots.txt":
                return W.Answer(404)
            if path == "/":
                return W.Answer(200, "".join(f"<a href='/{k}'>Conference 2026 {k}</a>" for k in links).encode(), {"content-type": "text/html"})
            if path == "/feed":
                return W.Answer(200, feed.encode(), {"content-type": "text/xml"})
            return W.Answer(200, f"<h1>Event {path}</h1><time>2 August 2026</time>".encode(), {"content-type": "text/html"})

        return answer

    store, query = S.ScanStore(spark, f"file://{tmp_path}/state"), N.Query(datetime.date(2026, 6, 1))
    go = lambda links, feed, day: N.crawl(N.Registries(R.sources(spark, toml)), web(links, feed), query, at(day), store)
    rss = f"<rss><channel>{entry(1)}</channel></rss>"
    one = go("ab", rss, 0)
    assert sorted(r.title for r in one.events.collect()) == ["Event /a", "Event /b", "Seminar 1"] and [(r.source, r.status, r.events) for r in one.health.collect()] == [("v", "ok", 1), ("w", "ok", 2)]
    two = go("a", rss[:-30], 1)
    assert [(r.source, r.status, r.events) for r in two.health.collect()] == [("v", "parse_error", 0), ("w", "ok", 1)] and two.changes.count() == 0 and store.list_events().count() == 3
    three = go("a", rss, 2)
    assert [(r.kind) for r in three.changes.collect()] == ["event_cancelled"] and store.list_events().count() == 2
