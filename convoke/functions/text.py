"""Names, phrases, ids and domains as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Neighbours that make a phrase part of a longer word.
_PART = r"[\p{IsAlphabetic}\p{N}]"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space (any of Unicode's) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case, squeezed."""
    return squeeze(F.lower(text))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_name(name: Column) -> Column:
    """NFC, lower case, squeezed.  Composition has no built-in function: one Arrow batch call, a no-op on ASCII."""
    return normalize_text(_composed(name))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: None if ts is None else [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in ts])


def normalize_names(names: Column) -> Column:
    """normalize_name of each name of a list."""
    return F.transform(_all_composed(names), normalize_text)


def word_list(text: Column) -> Column:
    """The words of a text, case kept: runs of letters, marks and digits, with inner apostrophes and dots."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"), 0)


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether a literal phrase occurs.

    A phrase with white space or beyond ASCII matches anywhere; a single ASCII
    word only between characters that are no letters or digits; an empty one never.
    """
    if not phrase:
        return F.lit(False)
    if not phrase.isascii() or any(c.isspace() for c in phrase):
        return text.contains(phrase)
    quoted = "\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return text.contains(phrase) & text.rlike(f"(?<!{_PART}){quoted}(?!{_PART})")


def contains_phrase_column(text: Column, phrase: Column) -> Column:
    """contains_phrase for a phrase in a column."""
    loose = phrase.rlike(r"(?U)\s|[^\x00-\x7F]")
    pattern = F.concat(F.lit(rf"(?<!{_PART})\Q"), phrase, F.lit(rf"\E(?!{_PART})"))
    return F.when(phrase == "", False).when(~text.contains(phrase), False).when(loose, True).otherwise(F.regexp(text, pattern))


def any_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether one of some literal phrases occurs."""
    found = F.lit(False)
    for p in phrases:
        found = found | contains_phrase(text, p)
    return found


def deterministic_id(*parts: Column) -> Column:
    """An id from parts; ``sha256:`` and the hash of the parts joined by the unit separator."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def event_id(title: Column, canonical_url: Column) -> Column:
    """The id of an event by its normalized title and canonical address."""
    return deterministic_id(normalize_text(title), canonical_url)


#: Suffixes under which names are registered one level deeper.
SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "org.uk", "me.uk", "edu.au", "com.au", "org.au", "net.au", "gov.au",
    "ac.jp", "co.jp", "go.jp", "or.jp", "ne.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "edu.cn", "ac.cn", "gov.cn", "com.cn", "org.cn",
    "edu.tw", "ac.tw", "gov.tw", "ac.nz", "co.nz", "govt.nz", "edu.sg", "com.sg", "org.sg", "gov.sg", "ac.il", "co.il",
    "com.br", "org.br", "edu.br", "gov.br", "com.hk", "org.hk", "edu.hk", "gov.hk", "com.mx", "org.mx", "edu.mx",
]


def domain_key(host: Column) -> Column:
    """The registered name of a host: its last two labels, or three under a known suffix."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(F.coalesce(host, F.lit("")) == "", None).when((n >= 3) & last(2).isin(SUFFIXES), last(3)).otherwise(last(2))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("")) == ""


def location_key(location: Column) -> Column:
    """The first of city, venue and name that isn't blank, normalized."""
    choice = F.coalesce(*[F.when(~_blank(location[k]), location[k]) for k in ("city", "venue", "name")])
    return normalize_name(choice)


def organizer_key(people: Column, first_source_host: Column) -> Column:
    """The first organizer's name, normalized, or else the domain of the first source."""
    own = F.filter(people, lambda p: p["role"] == "organizer")
    return F.coalesce(normalize_name(F.get(own, F.lit(0))["canonical_name"]), domain_key(first_source_host))


def truncated(text: Column, most: int) -> Column:
    """The first characters of a text."""
    return F.left(text, F.lit(most))


def without_nul(text: Column) -> Column:
    """A text without U+0000."""
    return F.translate(text, "\x00", "")
