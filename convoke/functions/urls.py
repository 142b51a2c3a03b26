"""Addresses: parts, canonical form and joining.

Everyday addresses are taken apart by built-in functions.  What those can't read
(blanks, odd escapes, other alphabets) goes through one Arrow batch function
with the same rules.
"""

from __future__ import annotations

from urllib.parse import parse_qsl, quote_plus, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that tell where a reader came from, not what the page is.
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_referrer",
    "fbclid", "gclid", "mc_cid", "mc_eid", "_ga", "_gl", "igshid", "fb_ref", "ref_src", "ref_url", "_hsenc", "_hsmi", "hsctatracking",
]
_PORTS = {"http": 80, "https": 443}
_PLAIN = r"^[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~!$&'()*,;=:@/-]*)?(?:\?(?:[A-Za-z0-9._~*-]+(?:=[A-Za-z0-9._~*-]*)?(?:&[A-Za-z0-9._~*-]+(?:=[A-Za-z0-9._~*-]*)?)*)?)?(?:#.*)?$"


def canonical(url: str | None) -> str | None:
    """One address in canonical form; None if it isn't an absolute http(s) address."""
    if url is None:
        return None
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in _PORTS or not parts.hostname:
        return None
    host = parts.hostname.lower().removeprefix("www.")
    path = parts.path.rstrip("/") or "/"
    path = "".join(c if c.isascii() and c not in ' "<>`{}' else "".join(f"%{b:02X}" for b in c.encode()) for c in path)
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING_KEYS)
    query = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in pairs)
    return f"{scheme}://{host}{f':{port}' if port and port != _PORTS[scheme] else ''}{path}{'?' + query if query else ''}"


@F.pandas_udf(T.StringType())
def _canonical(url: pd.Series) -> pd.Series:
    return url.map(canonical)


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href read on the page base; null where that gives no address."""

    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h.strip())
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def host(url: Column) -> Column:
    """The host in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    """The path, / if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def is_http(url: Column) -> Column:
    """Whether the scheme is http or https."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]"), F.lit(False))


def canonical_url(url: Column, fallback: bool = True) -> Column:
    """The address with a lower-case host without one leading www., no default port, fragment, user or trailing
    slashes, without tracking keys, and with its other pairs sorted.

    With ``fallback`` off, addresses beyond the everyday form give null and no Python runs.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    name = F.regexp_replace(host(url), r"^www\.", "")
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    port = F.regexp_replace(port, "^0+(?=[0-9])", "")
    usual = F.when(scheme == "https", "443").otherwise("80")
    shown = F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port))
    trimmed = F.regexp_replace(path(url), "/+$", "")
    trimmed = F.when(trimmed == "", "/").otherwise(trimmed)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.regexp_extract(p, "=(.*)$", 1)).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_KEYS)))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    plain = F.concat(scheme, F.lit("://"), name, shown, trimmed, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    simple = url.rlike(_PLAIN)
    return F.when(simple, plain).otherwise(_canonical(url)) if fallback else F.when(simple, plain)


def percent_decoded(target: str) -> str:
    """Only unreserved characters decoded; other escapes with capital digits."""
    out, k = [], 0
    while k < len(target):
        code = target[k + 1 : k + 3]
        if target[k] == "%" and len(code) == 2 and all(c in "0123456789abcdefABCDEF" for c in code):
            c = chr(int(code, 16))
            out.append(c if c.isascii() and (c.isalnum() or c in "-._~") else "%" + code.upper())
            k += 3
        else:
            out.append(target[k])
            k += 1
    return "".join(out)


def unescaped(text: str) -> str:
    """All escapes decoded."""
    return unquote(text)
