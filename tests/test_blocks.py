"""Blocks of events that can match: few edges for many events, and the same blocks as by all keys of all events."""

from __future__ import annotations

import random

from convoke.operators import components as C
from convoke.operators import dedup as K

from .test_operators import date, event, frame, source


def plain_blocks(keys):
    """The events of each block, each linked to all events with a common key."""
    same = lambda k: [("u", k["url"])] * (k["url"] is not None) + [("i", i) for i in k["ids"]]
    held = {}
    for n, k in enumerate(keys):
        for key in same(k):
            held.setdefault(key, set()).add(n)
    loose = {k["title"] for k in keys if k["start"] is None and any(len(held[key]) > 1 for key in same(k))}
    for n, k in enumerate(keys):
        own = [("t", k["title"])] * (k["title"] in loose) + [("d", k["title"], k["start"])] * (k["start"] is not None)
        for key in own:
            held.setdefault(key, set()).add(n)
    above = list(range(len(keys)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for members in held.values():
        for n in members:
            above[root(n)] = root(min(members))
    found = {}
    for n in range(len(keys)):
        found.setdefault(root(n), set()).add(f"{n:04}")
    return {frozenset(x) for x in found.values()}


def some(rng, n, titles, urls):
    return [
        event(
            f"{k:04}", title=f"t{rng.randrange(titles)}", url=f"https://e.org/{rng.randrange(urls)}" if rng.random() < 0.8 else None, date=date(rng.choice([None, "2026-01-01", "2026-01-02"])),
            sources=[source("s", "https://a.org/", rng.choice([None, None, str(rng.randrange(urls))]))],
        )
        for k in range(n)
    ]


def test_blocks_are_those_by_all_keys(spark):
    for seed, titles, urls in ((1, 60, 300), (2, 200, 400), (3, 10, 2000)):
        events = some(random.Random(seed), 150, titles, urls)
        rows = frame(spark, events)
        keys = {r.id: r.k.asDict() for r in K.keyed(rows).select("id", "k").collect()}
        found = {}
        for r in K.blocks(rows).collect():
            found.setdefault(r.block, set()).add(r.id)
        assert {frozenset(x) for x in found.values()} == plain_blocks([keys[f"{n:04}"] for n in range(len(events))])


def test_edges_are_as_many_as_titles_and_not_as_events(spark, monkeypatch):
    """A table whose events all hang together was given to the components with an edge for each event and key."""
    seen, whole = [], K.components
    monkeypatch.setattr(K, "components", lambda edges, **more: (seen.append(edges.filter("a <> b").distinct().count()), whole(edges, **more))[1])
    rows = frame(spark, some(random.Random(5), 600, 5, 200))
    assert len({r.block for r in K.blocks(rows).collect()}) == 1 and seen[0] <= 10


def test_few_edges_are_settled_as_many_are(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(140)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)], "a long, b long")
    many, few = ({r.node: r.root for r in C.components(edges, few=n).collect()} for n in (0, 1000))
    assert many == few and few
    assert C.components(edges.filter("a > 1000"), few=1000).count() == 0


def test_events_of_one_id_and_address_meet_others_of_their_title(spark):
    """Two events of one id share an address: the merged one has the undated one's title with the other's day."""
    day = date("2026-01-01")
    rows = frame(spark, [
        event("1", title="A", url="https://e.org/1", score=5.0, sources=[source("s", "https://a.org/")]), event("1", title="B", url="https://e.org/1", date=day, sources=[source("s", "https://a.org/2")]),
        event("3", title="A", url="https://e.org/3", date=day, sources=[source("s", "https://a.org/3")]),
    ])
    assert [len(r.sources) for r in K.dedup(rows).collect()] == [3]
    assert len({r.block for r in K.blocks(rows).collect()}) == 1
