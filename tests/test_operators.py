"""Matching, duplicates, changes, caps, health and checks."""

from __future__ import annotations

import datetime
import random
import time

from pyspark.sql import functions as F

from convoke.operators import changes as G
from convoke.operators import checks as Q
from convoke.operators import components
from convoke.operators import dedup as K
from convoke.operators import enrich as E
from convoke.operators import health as H
from convoke.operators import limits as L
from convoke.schemas import EVENT, schema

NOW = datetime.datetime(2026, 6, 1)


def event(id, **given):
    base = {f.name: ([] if f.dataType.typeName() == "array" else None) for f in schema(EVENT).fields}
    base |= {"id": id, "title": "t", "score": 0.0, "access": {"access": "unknown", "online": "unknown"}, "date": date(None)}
    return base | given


def date(day):
    return {"start": datetime.date.fromisoformat(day) if day else None, "end": None, "timezone": None, "original_text": "", "precision": "day" if day else "unknown"}


def source(source="s", url="https://h.org/", native=None):
    return {"source_id": source, "source_url": url, "evidence": None, "captured_at": None, "native_id": native}


def person(name, role="speaker", tags=()):
    return {"canonical_name": name, "matched_text": name, "role": role, "evidence": None, "confidence": 1.0, "scholar_tags": list(tags)}


def frame(spark, events):
    return spark.createDataFrame([tuple(e[f.name] for f in schema(EVENT).fields) for e in events], schema(EVENT))


TOPICS = [{"id": "a", "name": "Analysis", "aliases": ["PDE", "harmonic  analysis"]}, {"id": "l", "name": "Lie Theory", "aliases": ["lie"]}, {"id": "a", "name": "zz", "aliases": []}]
SCHOLARS = [{"id": "t", "canonical_name": "Terence Tao", "aliases": ["Tao", "T. Tao"], "tags": ["fields"]}, {"id": "z", "canonical_name": "Don Zagier", "aliases": ["Zagier", "Don B. Zagier"], "tags": ["wolf"]}]


def test_topics(spark):
    rows = frame(spark, [event("1", title="PDE and harmonic analysis", description="Lie theories"), event("2", title="psychoanalysis", description=None, topics=[{"topic_id": "l", "canonical_name": "L", "matched_text": "x", "confidence": 0.9}]), event("3", title="lie", description="On Lie Theory")])
    got = {r.id: [(t.topic_id, t.matched_text, round(t.confidence, 1)) for t in r.topics] for r in E.with_topics(rows, TOPICS).collect()}
    assert got == {"1": [("a", "Analysis", 1.0), ("l", "lie", 0.8)], "2": [("l", "x", 0.9)], "3": [("l", "Lie Theory", 1.0)]}
    assert E.with_topics(rows, []) is rows


def test_scholars(spark):
    rows = frame(spark, [event("1", title="The Gross-Zagier formula", people=[person("zagier"), person("Ann", tags=["x"])]), event("2", title="Tao of maths"), event("3", title="none")])
    got = {r.id: [(p.canonical_name, p.role, p.scholar_tags) for p in r.people] for r in E.with_scholars(rows, SCHOLARS).collect()}
    assert got["1"] == [("Don Zagier", "speaker", ["wolf"]), ("Ann", "speaker", ["x"])] and got["2"] == [("Terence Tao", "title_mention", ["fields"])] and got["3"] == []
    texts = spark.createDataFrame([(0, "tao gave it"), (1, "terence tao and tao"), (2, "don b. zagier or zagier"), (3, "tao, terence")], "k int, t string")
    words = F.split(F.regexp_replace("t", r"[^\p{L}\p{N}]+", " "), " ")
    got = [[(p.canonical_name, p.matched_text) for p in r.m] for r in texts.select("k", E.scholar_matches(F.col("t"), SCHOLARS, "body", words=words).alias("m")).orderBy("k").collect()]
    assert got == [[], [("Terence Tao", "Terence Tao")], [("Don Zagier", "Don B. Zagier")], [("Terence Tao", "Tao")]]
    field = texts.select(E.scholar_matches(F.col("t"), SCHOLARS, "field", "organizer").alias("m")).first().m[0]
    assert (field.role, field.confidence) == ("organizer", 1.0)


def naive_fold(events):
    """A scan over all clusters for every event."""
    clusters = []
    for e in sorted(events, key=lambda e: e["id"]):
        for at, own in enumerate(clusters):
            if K.matches(own["k"], e["k"]):
                clusters[at] = K.merge(own, e)
                break
        else:
            clusters.append(e)
    return clusters


def test_fold_against_a_plain_scan(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice([*x, None])
    events = [
        event(
            f"{k:03d}", title=rng.choice("abcd"), url=pick("https://e.org/1", "https://e.org/2?utm_id=3", "https://www.e.org/2"), score=float(rng.randint(0, 3)), date=date(pick("2026-01-01", "2026-01-02")),
            location=pick({"name": None, "city": "Rome", "country": None, "venue": None}, {"name": "Bonn", "city": None, "country": None, "venue": None}),
            sources=[source(rng.choice("xy"), rng.choice(["https://a.org/", "https://b.c.org/"]), pick("1", "2"))], people=[person(rng.choice("mn"), "organizer")] if rng.random() < 0.3 else [],
        )
        for k in range(120)
    ]
    rows = frame(spark, events)
    keyed = {r.id: r.k.asDict(recursive=True) for r in K.keyed(rows).select("id", "k").collect()}
    plain = [e | {"k": keyed[e["id"]], "date": e["date"] | {"start": str(e["date"]["start"]) if e["date"]["start"] else None}} for e in events]
    want = naive_fold(plain)
    assert [x["id"] for x in K.fold(plain)] == [x["id"] for x in want] and [x["sources"] for x in K.fold(plain)] == [x["sources"] for x in want]
    got = {r.id: (r.title, r.url, r.score, len(r.sources), sorted(s.native_id or "" for s in r.sources)) for r in K.dedup(rows).collect()}
    assert got == {x["id"]: (x["title"], x["url"], x["score"], len(x["sources"]), sorted(s["native_id"] or "" for s in x["sources"])) for x in want}
    shuffled = K.dedup(frame(spark, rng.sample(events, len(events))).repartition(5))
    assert {r.id for r in shuffled.select("id").collect()} == set(got)


def test_large_blocks_fold_in_linear_time():
    """One title and day with many organizers, and one cluster that many join."""
    key = lambda **x: {"url": None, "ids": [], "title": "t", "start": "2026-01-01", "organizer": None, "domain": None, "place": None} | x
    base = event("")
    many = [base | {"id": f"{k:06d}", "k": key(organizer=str(k)), "date": {"start": "2026-01-01"}} for k in range(100_000)]
    began = time.perf_counter()
    assert len(K.fold(many)) == 100_000
    one = [base | {"id": f"{k:06d}", "score": float(k), "k": key(url="u", ids=[str(k)]), "sources": [source("s", f"https://e.org/{k}")]} for k in range(20_000)]
    made = K.fold(one)
    assert len(made) == 1 and len(made[0]["sources"]) == 20_000 and made[0]["sources"][0]["source_url"].endswith("/19999") and made[0]["id"] == "019999"
    assert time.perf_counter() - began < 30


def test_undated_titles_meet_days_of_their_cluster(spark):
    """The representative takes its title from an undated event and its day from another."""
    day = date("2026-01-01")
    rows = frame(spark, [
        event("1", title="A", url="https://e.org/1", score=5.0, sources=[source("s", "https://a.org/")]), event("2", title="B", url="https://e.org/1", date=day, sources=[source("s", "https://a.org/2")]),
        event("3", title="A", url="https://e.org/3", date=day, sources=[source("s", "https://a.org/3")]), event("4", title="A", url="https://e.org/4", date=date("2026-01-02"), sources=[source("s", "https://a.org/4")]),
    ])
    blocks = {r.id: r.block for r in K.blocks(rows).collect()}
    assert blocks["1"] == blocks["2"] == blocks["3"]
    assert sorted((r.id, len(r.sources)) for r in K.dedup(rows).collect()) == [("1", 3), ("4", 1)]


def test_names_are_composed(spark):
    """Decomposed accents are the same name: of places, organizers and people."""
    day, plain, apart = date("2026-01-01"), "Andr\u00e9", "Andre\u0301"
    place = lambda n: {"name": n, "city": None, "country": None, "venue": None}
    rows = frame(spark, [
        event("1", title="X", url="https://e.org/1", date=day, location=place(f"{plain} Hall"), sources=[source("s", "https://a.org/")]), event("2", title="X", url="https://e.org/2", date=day, location=place(f"{apart} hall"), sources=[source("t", "https://b.org/")]),
        event("3", title="Y", url="https://e.org/3", date=day, people=[person(plain, "organizer")], sources=[source("u", "https://c.org/")]), event("4", title="Y", url="https://e.org/4", date=day, people=[person(apart, "organizer")], sources=[source("v", "https://d.org/")]),
    ])
    assert {(r.a, r.b): r.signal for r in K.signal_links(rows).collect()} == {("1", "2"): "title_date_location", ("3", "4"): "title_date_organizer"}
    people = frame(spark, [event("5", title="none", people=[person(apart)]), event("6", title=f"On {apart}", people=[person(apart, tags=["x"])])])
    got = {r.id: [(p.canonical_name, p.scholar_tags) for p in r.people] for r in E.with_scholars(people, [{"id": "a", "canonical_name": plain, "aliases": [], "tags": ["prize"]}]).collect()}
    assert got == {"5": [(plain, ["prize"])], "6": [(apart, ["x"])]}


def test_merges():
    key = lambda **x: {"url": None, "ids": [], "title": "t", "start": None, "organizer": None, "domain": None, "place": None} | x
    talk = {"id": "1", "speaker": [person("A")], "media": [], "topics": [], "date_time": None, "abstract_text": None}
    a = event("1", url="u", score=1.0, talks=[talk], first_seen_at="2026-02", k=key(url="u"))
    b = event("2", score=2.0, talks=[talk | {"speaker": [person("B")], "abstract_text": "x"}], description="d", location={"name": "P"}, first_seen_at="2026-01", k=key(place="p"))
    m = K.merge(a, b)
    assert m["id"] == "2" and m["description"] == "d" and m["first_seen_at"] == "2026-01" and [p["canonical_name"] for p in m["talks"][0]["speaker"]] == ["B", "A"] and m["k"]["url"] == "u" and m["k"]["place"] == "p"
    assert K.merge(a, b | {"score": 1.0})["id"] == "1"


def test_signals(spark):
    day = date("2026-01-01")
    rows = frame(spark, [
        event("1", title="X", url="https://e.org/a", sources=[source("s", "https://a.org/", "n")]), event("2", title="Y", url="https://www.e.org/a/?utm_id=1", sources=[source("q", "https://b.org/")]),
        event("3", title="Z", sources=[source("s", "https://c.org/", "n")]), event("4", title=" W", date=day, sources=[source("v", "https://x.org/")]), event("5", title="w", date=day, sources=[source("w", "https://y.x.org/")]),
        event("6", title="W", sources=[source("w", "https://y.x.org/")]),
    ])
    got = {(r.a, r.b): r.signal for r in K.signal_links(rows).collect()}
    assert got == {("1", "2"): "canonical_url", ("1", "3"): "source_canonical_id", ("4", "5"): "title_date_organizer"}
    assert K.dedup(rows).count() == 3 and K.dedup(rows.limit(0)).count() == 0


def test_changes(spark):
    talk = lambda i, *names: {"id": i, "title": "x", "speaker": [person(n) for n in names], "abstract_text": None, "date_time": None, "media": [], "topics": []}
    medium = lambda u, kind="video": {"url": u, "media_type": kind, "title": None, "platform": None, "public_access": "open", "published_at": None}
    old = frame(spark, [event("a", talks=[talk("1", "P")], media=[medium("m1")]), event("b"), event("d", date=date("2026-01-01") | {"original_text": "x"}), event("e", people=[person("A"), person("B")])])
    new = frame(spark, [event("a", talks=[talk("1", "P"), talk("2", "Q")], media=[medium("m2"), medium("m3", "livestream")]), event("c"), event("d", date=date("2026-01-01")), event("e", people=[person("B"), person("A")])])
    got = [(r.event_id, r.kind, r.detail) for r in G.in_order(G.detect_changes(old, new, NOW)).collect()]
    assert got == [("a", "event_updated", None), ("a", "schedule_added", "2"), ("a", "speaker_added", "Q"), ("a", "livestream_added", "m3"), ("a", "media_added", "m2"), ("a", "media_removed", "m1"), ("b", "event_cancelled", None), ("c", "event_added", None)]


def test_budget_of_talks(spark):
    rows = spark.createDataFrame([("a", 3.0, [1, 2]), ("b", 2.0, [1, 2, 3]), ("c", 2.0, []), ("d", 1.0, [1]), ("e", 0.0, None)], "id string, score double, talks array<int>")
    cut = lambda n: [(r.id, None if r.talks is None else len(r.talks)) for r in L.ranked(L.talk_budget(rows, n)).collect()]
    assert cut(4) == [("a", 2), ("b", 2)] and cut(5) == [("a", 2), ("b", 3)] and cut(6) == [("a", 2), ("b", 3), ("c", 0), ("d", 1)] and cut(0) == [("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", None)]


def test_health(spark):
    rows = spark.createDataFrame([("a", "timeout", 1, 5000), ("b", "redirect", 3, 700)], "s string, e string, n int, left int")
    got = rows.select(H.error_status(F.col("e")), H.backoff_ms(F.col("n"), F.col("left").cast("long"))).collect()
    assert [tuple(r) for r in got] == [("timeout", 500), ("http_error", 700)]
    assert not H.usable(spark.createDataFrame([("timeout",)], "status string")) and H.usable(spark.createDataFrame([("timeout",), ("partial",)], "status string"))


def test_checks(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tname\tn\n1\ta\t5\n\n\t \t\n2\t\tx\n2\tb\t-1\n")
    rows = Q.read_tsv(spark, str(tmp_path / "t.tsv"))
    assert rows.count() == 3 and Q.missing_columns(rows, ["id", "zz"]) == ["zz"]
    assert [tuple(r) for r in Q.empty_cells(rows, "id", ["name"]).collect()] == [("2", "name")]
    assert Q.repeated_keys(rows, "id", "name").count() == 1
    assert sorted(r.value for r in Q.not_typed(rows, "id", {"n": "unsigned"}).collect()) == ["-1", "x"]
    assert Q.states_root('{"title": "Scan"}', "Scan") and not Q.states_root(" ", "Scan") and not Q.states_root(None, "Scan")


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, 500 + k) for k in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
