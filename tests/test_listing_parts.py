"""Listings in several documents."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from convoke.plans import scan as N
from convoke.queries.sourced import _listing
from convoke.sources import registry as R


def test_a_listing_in_parts_gives_the_events_of_a_whole_one(spark):
    """Entries keep their order over documents, so the cap of a source takes the same ones."""
    rows = spark.range(9000)
    entry = F.concat(F.lit("BEGIN:VEVENT\nSUMMARY:Seminar "), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("\nURL:https://cal.org/"), F.col("id").cast("string"), F.lit("\nDTSTART:20260601\nEND:VEVENT\n"))
    specs = R.sources(spark, '[[sources]]\nid = "cal"\nname = "cal"\nadapter = "ics"\nentrypoint = "https://cal.org/"\n')
    found = []
    for most in (9000, 1000):
        listing = _listing(rows, entry, "cal", "BEGIN:VCALENDAR\n", "END:VCALENDAR\n", "text/calendar", most)
        assert listing.count() == 9000 // most
        assert listing.filter("length(body) > 150 * 1000").count() == (most == 9000)
        assert listing.select("url").distinct().count() == listing.count()
        events, health = N.collected(N.Registries(specs), listing, listing.drop("part").limit(0), datetime.datetime(2026, 6, 1, tzinfo=datetime.UTC))
        found.append(([r.title for r in events.orderBy("stub_ord").collect()], [(r.status, r.events) for r in health.collect()]))
    assert found[0] == found[1]
    assert found[0][0][0] == "Seminar 00000" and len(found[0][0]) == 2000
