"""Dates and date ranges from free text, and windows over them.

All forms are regular expressions over the trimmed text with checked calendar
dates; the first that fits gives the result.  Nothing reads a clock.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Month names that dates are written with.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_DAY, _MONTH, _YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", "([A-Za-z]+)", r"(\d{4})"
_DASH, _TO = r"\s*[–-]\s*", r"\s*(?:[–-]|to)\s*"
_ISO = r"(\d{4}-\d{2}-\d{2})"
TYPE = "struct<start:date,end:date,timezone:string,original_text:string,precision:string>"


def month_number(name: Column) -> Column:
    """1 to 12 for a full or three-letter month name, or sept; null for others."""
    low = F.lower(name)
    found = F.when(low == "sept", 9)
    for k, m in enumerate(MONTHS, 1):
        found = found.when(low.isin(m, m[:3]), k)
    return found


def checked_date(year: Column, month: Column, day: Column) -> Column:
    """The calendar date, or null if there is none."""
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))
    return text.try_cast("date")


def _span(start: Column, end: Column) -> Column:
    """A range whose start is not after its end, or null."""
    ends = F.struct(start.alias("start"), end.alias("end"), F.lit("range").alias("precision"))
    return let(ends, lambda r: F.when(r["start"] <= r["end"], r))


def _single(day: Column) -> Column:
    one = F.struct(day.alias("start"), F.lit(None).cast("date").alias("end"), F.lit("day").alias("precision"))
    return let(one, lambda r: F.when(r["start"].isNotNull(), r))


def _form(text: Column, pattern: str, n: int, make: Callable[..., Column]) -> Column:
    """make of the groups of a whole match; null without one."""
    whole = f"^{pattern}$"
    groups = F.array(*[F.regexp_extract(text, whole, k) for k in range(1, n + 1)])
    return F.when(text.rlike(whole), let(groups, lambda g: make(*[F.get(g, F.lit(k)) for k in range(n)])))


def unknown(text: Column) -> Column:
    """A date that a text doesn't tell."""
    none = F.lit(None).cast("date")
    return F.struct(none.alias("start"), none.alias("end"), F.lit(None).cast("string").alias("timezone"), text.alias("original_text"), F.lit("unknown").alias("precision")).cast(TYPE)


def parse_date(text: Column, year_hint: Column | None = None) -> Column:
    """start, end, timezone, original_text and precision (day, range or unknown); null text gives null.

    Forms without a year count only with a hint; a range over them whose end
    month comes before its start month ends in the next year.
    """
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    whole = lambda found: F.struct(found["start"].alias("start"), found["end"].alias("end"), F.lit(None).cast("string").alias("timezone"), text.alias("original_text"), F.coalesce(found["precision"], F.lit("unknown")).alias("precision")).cast(TYPE)
    hint = None if year_hint is None else year_hint.cast("int")
    return F.when(text.isNotNull(), let(let(trimmed, lambda t: _first_form(t, hint)), whole))


def _first_form(t: Column, hint: Column | None) -> Column:
    """start, end and precision by the first form that fits; null if none does."""
    iso = lambda a, b: _span(a.try_cast("date"), b.try_cast("date"))
    head = F.regexp_extract(t, r"^([^T ]*)", 1)
    rest = F.regexp_extract(t, r"^[^T ]*(.*)$", 1)
    plain = F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), head.try_cast("date"))
    unclear = F.struct(F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit("unknown").alias("precision"))
    month = month_number
    tries = [
        _form(t, rf"{_ISO}\s*[/–-]\s*{_ISO}", 2, iso),
        _form(t, rf"{_ISO}\s+{_ISO}", 2, iso),
        let(plain, lambda d: F.when(d.isNotNull() & rest.rlike(" - | – | to | / "), unclear).otherwise(_single(d))),
        _form(t, rf"{_MONTH}\s+{_DAY},?\s+{_YEAR}{_TO}{_MONTH}\s+{_DAY},?\s+{_YEAR}", 6, lambda m1, d1, y1, m2, d2, y2: _span(checked_date(y1, month(m1), d1), checked_date(y2, month(m2), d2))),
        _form(t, rf"{_DAY}\s+{_MONTH}\s+{_YEAR}{_TO}{_DAY}\s+{_MONTH}\s+{_YEAR}", 6, lambda d1, m1, y1, d2, m2, y2: _span(checked_date(y1, month(m1), d1), checked_date(y2, month(m2), d2))),
        _form(t, rf"{_DAY}{_DASH}{_DAY}\s+{_MONTH}\s+{_YEAR}", 4, lambda d1, d2, m, y: _span(checked_date(y, month(m), d1), checked_date(y, month(m), d2))),
        _form(t, rf"{_DAY}\s+{_MONTH}{_DASH}{_DAY}\s+{_MONTH}\s+{_YEAR}", 5, lambda d1, m1, d2, m2, y: _span(checked_date(y, month(m1), d1), checked_date(y, month(m2), d2))),
        _form(t, rf"{_MONTH}\s+{_DAY}{_DASH}{_DAY},?\s+{_YEAR}", 4, lambda m, d1, d2, y: _span(checked_date(y, month(m), d1), checked_date(y, month(m), d2))),
        _form(t, rf"{_MONTH}\s+{_DAY},?\s+{_YEAR}", 3, lambda m, d, y: _single(checked_date(y, month(m), d))),
        _form(t, rf"{_DAY}\s+{_MONTH}\s+{_YEAR}", 3, lambda d, m, y: _single(checked_date(y, month(m), d))),
    ]
    if hint is not None:

        def across(m1: Column, d1: Column, m2: Column, d2: Column) -> Column:
            months = F.struct(month(m1).alias("a"), month(m2).alias("b"))
            return let(months, lambda m: _span(checked_date(hint, m["a"], d1), checked_date(hint + F.when(m["b"] < m["a"], 1).otherwise(0), m["b"], d2)))

        tries += [
            _form(t, rf"{_DAY}{_DASH}{_DAY}\s+{_MONTH}", 3, lambda d1, d2, m: across(m, d1, m, d2)),
            _form(t, rf"{_DAY}\s+{_MONTH}{_DASH}{_DAY}\s+{_MONTH}", 4, lambda d1, m1, d2, m2: across(m1, d1, m2, d2)),
            _form(t, rf"{_MONTH}\s+{_DAY}{_DASH}{_MONTH}\s+{_DAY}", 4, across),
            _form(t, rf"{_MONTH}\s+{_DAY}{_DASH}{_DAY}", 3, lambda m, d1, d2: across(m, d1, m, d2)),
            _form(t, rf"{_MONTH}\s+{_DAY}", 2, lambda m, d: _single(checked_date(hint, month(m), d))),
            _form(t, rf"{_DAY}\s+{_MONTH}", 2, lambda d, m: _single(checked_date(hint, month(m), d))),
        ]
    return F.coalesce(*tries)


def parse_date_with_reference(text: Column, today: Column) -> Column:
    """parse_date with today's year as the hint; a date without a year that is over moves to the next year."""
    years = F.array(F.year(today), F.year(today) + 1)
    both = F.transform(years, lambda year: parse_date(text, year))

    def choice(d: Column) -> Column:
        first, rolled = F.get(d, F.lit(0)), F.get(d, F.lit(1))
        over = (first["precision"] != "unknown") & (F.coalesce(first["end"], first["start"]) < today) & (rolled["precision"] != "unknown")
        return F.when(F.coalesce(over, F.lit(False)), rolled).otherwise(first)

    return let(both, choice)


def interval_overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether [start, end] meets [low, high]; a null start is open, a null end is the start."""
    last = F.coalesce(end, start)
    return (start.isNull() | (start <= high)) & (last.isNull() | (last >= low))


def window_bounds(today: datetime.date, before: int, after: int) -> tuple[datetime.date, datetime.date]:
    """today - before and today + after days, held at the calendar's ends."""

    def moved(days: int) -> datetime.date:
        try:
            return today + datetime.timedelta(days=days)
        except OverflowError:
            return datetime.date.min if days < 0 else datetime.date.max

    return moved(-before), moved(after)


def today_in(timezone: str, now: datetime.datetime) -> datetime.date:
    """The date of an instant in a named zone."""
    return now.astimezone(ZoneInfo(timezone)).date()


def selected(has_date: Column, has_media: Column, in_window: Column, mode: str) -> Column:
    """Which events a mode shows: upcoming, recordings or both."""
    if mode == "upcoming":
        return has_date & in_window
    if mode == "recordings":
        return has_media & (~has_date | in_window)
    if mode == "both":
        return (has_date & in_window) | (has_media & ~has_date)
    raise ValueError(f"no such mode: {mode}")
