"""Column expressions against cases written out by hand."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from convoke.functions import classify as C
from convoke.functions import dates as D
from convoke.functions import score as S
from convoke.functions import text as X
from convoke.functions import urls as U


def one(spark, values, column, ddl="v string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {ddl}")
    return [r[1] for r in rows.select("k", column.alias("r")).orderBy("k").collect()]


DATES = [
    ("3–7 August 2026", "2026-08-03", "2026-08-07", "range"),
    ("3rd - 7th Aug 2026", "2026-08-03", "2026-08-07", "range"),
    ("31 August – 4 September 2026", "2026-08-31", "2026-09-04", "range"),
    ("August 3-7, 2026", "2026-08-03", "2026-08-07", "range"),
    ("August 3, 2026", "2026-08-03", None, "day"),
    ("Sept 1st 2026", "2026-09-01", None, "day"),
    ("8 August 2026", "2026-08-08", None, "day"),
    ("2026-08-08", "2026-08-08", None, "day"),
    ("2026-08-08T10:00:00Z", "2026-08-08", None, "day"),
    ("2026-08-08 10:00 - 2026-08-09 10:00", None, None, "unknown"),
    ("2026-08-08/2026-08-10", "2026-08-08", "2026-08-10", "range"),
    ("2026-08-08 2026-08-10", "2026-08-08", "2026-08-10", "range"),
    ("August 2, 2026 - August 7, 2026", "2026-08-02", "2026-08-07", "range"),
    ("31 December 2026 to 2 January 2027", "2026-12-31", "2027-01-02", "range"),
    ("  3 August 2026 ", "2026-08-03", None, "day"),
    ("7–3 August 2026", None, None, "unknown"),
    ("", None, None, "unknown"),
    ("2026", None, None, "unknown"),
    ("August 2026", None, None, "unknown"),
    ("TBD", None, None, "unknown"),
    ("30 February 2026", None, None, "unknown"),
    ("33 August 2026", None, None, "unknown"),
    ("3–7 August", None, None, "unknown"),
    ("13–14", None, None, "unknown"),
]


def test_dates(spark):
    got = one(spark, [d[0] for d in DATES], D.parse_date(F.col("v")))
    assert [(str(r.start) if r.start else None, str(r.end) if r.end else None, r.precision) for r in got] == [d[1:] for d in DATES]
    assert [r.original_text for r in got] == [d[0] for d in DATES]
    assert one(spark, [None], D.parse_date(F.col("v"))) == [None]


def test_dates_without_a_year(spark):
    cases = {"Dec 30 – Jan 2": ("2026-12-30", "2027-01-02"), "3-7 August": ("2026-08-03", "2026-08-07"), "30 Nov - 2 Dec": ("2026-11-30", "2026-12-02"), "July 9": ("2026-07-09", None), "9 July": ("2026-07-09", None), "July 9-11": ("2026-07-09", "2026-07-11"), "Feb 30": (None, None)}
    got = one(spark, list(cases), D.parse_date(F.col("v"), F.lit(2026)))
    assert [(str(r.start) if r.start else None, str(r.end) if r.end else None) for r in got] == list(cases.values())
    rolled = one(spark, ["Jan 5", "Dec 5", "January 5, 2020"], D.parse_date_with_reference(F.col("v"), F.lit(datetime.date(2026, 6, 1))))
    assert [str(r.start) for r in rolled] == ["2027-01-05", "2026-12-05", "2020-01-05"]


def test_windows():
    day = datetime.date
    assert D.window_bounds(day(2026, 1, 31), 30, 1) == (day(2026, 1, 1), day(2026, 2, 1))
    assert D.window_bounds(day(2026, 1, 1), 10**7, 10**7) == (day.min, day.max)
    assert D.today_in("Pacific/Auckland", datetime.datetime(2026, 1, 1, 13, tzinfo=datetime.UTC)) == day(2026, 1, 2)
    with pytest.raises(ValueError):
        D.selected(None, None, None, "never")


def test_text(spark):
    assert one(spark, ["  A  B\tc ", None], X.normalize_text(F.col("v"))) == ["a b c", None]
    assert one(spark, ["Café"], X.normalize_name(F.col("v"))) == ["café"]
    assert one(spark, ["psychoanalysis", "analysis, PDE", "reanalysis analysis"], X.contains_phrase(F.col("v"), "analysis")) == [False, True, True]
    assert one(spark, ["xlie theoryx", "lie  theory"], X.contains_phrase(F.col("v"), "lie theory")) == [True, False]
    assert one(spark, ["a"], X.contains_phrase(F.col("v"), "")) == [False]
    assert one(spark, ["analysis", "lie theory", "", "é"], X.contains_phrase_column(F.lit("reanalysis of lie theoryé"), F.col("v"))) == [False, True, False, True]
    assert one(spark, ["www.maths.ox.ac.uk", "a.b.org", "localhost", "ac.uk", None], X.domain_key(F.col("v"))) == ["ox.ac.uk", "b.org", "localhost", "ac.uk", None]
    assert one(spark, ["a\x00b"], X.without_nul(F.col("v"))) == ["ab"]


URLS = {
    "HTTPS://www.Example.org:443/a//?utm_source=x&b=2&a=1#f": "https://example.org/a?a=1&b=2",
    "http://example.org": "http://example.org/",
    "http://user:pw@example.org:8080/": "http://example.org:8080/",
    "https://example.org/?ref=1&FBCLID=2": "https://example.org/?ref=1",
    "https://example.org/a b?q=é": "https://example.org/a%20b?q=%C3%A9",
    "https://example.org/?a=1&a=0&b": "https://example.org/?a=0&a=1&b=",
    "mailto:x@y.z": None,
    "not an address": None,
}


def test_urls(spark):
    assert one(spark, list(URLS), U.canonical_url(F.col("v"))) == list(URLS.values())
    for url, want in URLS.items():
        assert U.canonical(url) == want
    assert U.percent_decoded("/%7Ea%2fb%zz") == "/~a%2Fb%zz"


def test_classes(spark):
    texts = ["Subscription required", "Freedom of choice", "No registration required", "Please register", "open access", "no registration required, sign in", ""]
    assert one(spark, texts, C.access_class(F.col("v"))) == ["paywalled", "unknown", "open", "registration_required", "open", "institution_login", "unknown"]
    types = ["Award Lecture of the Workshop", "A Summer  School", "panel of a seminar", "Symposium", None, "tea"]
    assert one(spark, types, C.event_type(F.col("v"))) == ["award_lecture", "summer_school", "panel", "conference", "unknown", "unknown"]
    links = ["https://youtu.be/abcdefghijk", "https://e.org/x.mp4", "https://e.org/Slides.pdf", "https://e.org/", "https://vimeo.com/1"]
    assert one(spark, links, C.link_media_type(F.col("v"), F.lit(""), F.lit(None).cast("string"))) == ["video", "video", "slides", None, "video"]


def test_scores(spark):
    assert one(spark, [0.0, 0.5, 1.0, None, float("nan"), 7.0, -1.0], S.topic_points(F.col("v")), "v double") == [8, 11, 15, 15, 15, 15, 8]
    person = "array<struct<canonical_name:string,role:string,scholar_tags:array<string>>>"
    people = [[("a", "participant", ["fields"]), ("b", "speaker", ["WOLF"]), ("c", "lecturer", ["abel"])], [("a", "title_mention", ["fields"])], [], [("o", "organizer", ["abel"]), ("s", "speaker", ["wolfram"])]]
    got = one(spark, people, S.best_person(F.col("v")), f"v {person}")
    assert [(r.points, r.name) if r else None for r in got] == [(10, "b"), (0, "a"), None, (5, "o")]
