"""Bodies of collected documents as rows: the parts that need a parser.

Each function takes one body and gives plain records; ``rows_of`` runs it over a
DataFrame in Arrow batches.  All rules about what the records mean are column
expressions elsewhere.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from typing import Any
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..schemas import schema
from . import dom

DEEPEST = 8
#: Documents read from a batch, and records of several documents held, at a time.
TOGETHER, HELD = 16, 10_000


class ParseError(ValueError):
    """A body that is not what its source says."""


def _told(e: Exception) -> str:
    return str(e) if isinstance(e, ParseError) else f"{type(e).__name__}: {e}"[:500]


def _records(row: dict[str, Any], fn: Callable[[dict[str, Any]], list[dict[str, Any]]], keep: list[str]) -> list[dict[str, Any]]:
    """The records of one document, or the row that tells what it failed at."""
    kept = {c: row[c] for c in keep}
    try:
        return [kept | r | {"error": None, "ord": k} for k, r in enumerate(fn(row))]
    except Exception as e:  # noqa: BLE001 - a body of any kind may not end the scan of the others
        return [kept | {"error": _told(e), "ord": 0}]


def rows_of(docs: DataFrame, fn: Callable[[dict[str, Any]], list[dict[str, Any]]], ddl: str, keep: list[str]) -> DataFrame:
    """The records of every document with ``keep`` of its columns; ``error`` tells what a body failed at.

    A document that fails, at whatever, gives one row with nulls and its error; others aren't touched by it.
    """
    own = schema(ddl)
    fields = [*(docs.schema[c] for c in keep), *own.fields]
    types = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields] + [pa.field("error", pa.string()), pa.field("ord", pa.int64())])

    def made(documents: list[list[dict[str, Any]]]) -> Iterator[pa.RecordBatch]:
        try:
            yield pa.RecordBatch.from_pylist([r for d in documents for r in d], schema=types)
        except (pa.ArrowException, TypeError, ValueError, OverflowError):
            for records in documents:
                try:
                    yield pa.RecordBatch.from_pylist(records, schema=types)
                except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
                    yield pa.RecordBatch.from_pylist([{c: records[0][c] for c in keep} | {"error": _told(e), "ord": 0}], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count = [], 0
            for at in range(0, batch.num_rows, TOGETHER):
                for row in batch.slice(at, TOGETHER).to_pylist():
                    records = _records(row, fn, keep)
                    if count + len(records) > HELD and held:
                        yield from made(held)
                        held, count = [], 0
                    held.append(records)
                    count += len(records)
            if held:
                yield from made(held)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", error string, ord long"
    return docs.mapInArrow(run, shape)


# Pages


PAGE = "title string, description string, date_text string, location_text string, words string, links array<struct<tag:string,url:string,text:string,title:string>>"


def _first_text(root: dom.Node, selector: str) -> str | None:
    node = root.first(selector)
    return (node.text() or None) if node else None


def _meta(root: dom.Node, key: str, value: str) -> str | None:
    node = root.first(f'meta[{key}="{value}"]')
    return (dom.clean(node.attrs.get("content", "")) or None) if node else None


def _marked(root: dom.Node, marks: tuple[str, ...]) -> str | None:
    for node in root.elements():
        if any(m in node.attrs.get(a, "") for a in ("class", "id") for m in marks):
            text = node.text()
            if text:
                return text
    return None


def page_fields(root: dom.Node) -> dict[str, Any]:
    """Title, description, date and place texts, and all words of a page."""
    title = _first_text(root, "h1") or _first_text(root, "title") or _meta(root, "property", "og:title")
    description = _meta(root, "name", "description") or _meta(root, "property", "og:description")
    if description is None:
        description = next((t for t in (p.text() for p in root.select("p")) if len(t) > 20), None)
    time = root.first("time")
    date = (dom.clean(time.attrs.get("datetime", "")) or time.text() or None) if time else None
    metas = " ".join(m.attrs["content"] for m in root.select("meta") if "content" in m.attrs)
    return {
        "title": title, "description": description,
        "date_text": date or _marked(root, ("date", "time", "when")),
        "location_text": _marked(root, ("location", "venue", "place", "address")),
        "words": "".join(root.texts()) + metas,
    }


def joined(base: str | None, href: str | None) -> str | None:
    """href read on a base; None where that is no address."""
    if href is None:
        return None
    try:
        return urljoin(base or "", href.strip())
    except ValueError:
        return None


def media_links(root: dom.Node, base: str | None) -> list[dict[str, Any]]:
    """Links, frames, and video and audio files, in the order in which media are looked for."""
    found = [("a", n.attrs.get("href"), n) for n in root.select("a")] + [("iframe", n.attrs.get("src"), n) for n in root.select("iframe")]
    for tag in ("video", "audio"):
        for n in root.select(tag):
            found.append((tag, n.attrs.get("src"), n))
            found += [(tag, c.attrs.get("src"), c) for c in n.select("source")]
    urls = [(tag, joined(base, href), n) for tag, href, n in found if href is not None]
    return [{"tag": tag, "url": url, "text": n.text(), "title": n.attrs.get("title")} for tag, url, n in urls if url]


def page(row: dict[str, Any]) -> list[dict[str, Any]]:
    root = dom.tree(dom.decoded(row["body"]))
    return [page_fields(root) | {"links": media_links(root, row.get("final_url"))}]


ANCHOR = "href string, text string, url string"


def anchors(row: dict[str, Any]) -> list[dict[str, Any]]:
    """Links with a target and a text."""
    root = dom.tree(dom.decoded(row["body"]))
    found = [(n.attrs.get("href"), n.text()) for n in root.select("a")]
    return [{"href": h, "text": t, "url": joined(row.get("final_url"), h)} for h, t in found if h is not None and t]


LISTED = "title string, url string, date_texts array<string>"
DETAIL = "title string, date_texts array<string>, location string, description string, speakers array<string>, words string, links array<struct<tag:string,url:string,text:string,title:string>>"


def _shown(node: dom.Node | None) -> str | None:
    return (node.own_text() or node.text() or None) if node else None


def _date_texts(node: dom.Node | None) -> list[str]:
    return [t for t in (node.attrs.get("datetime"), node.own_text(), node.text()) if t] if node else []


def _selectors(row: dict[str, Any]) -> dict[str, str]:
    own = row.get("selectors")
    if not own:
        raise ParseError("configured HTML needs selectors")
    own = {k: v for k, v in dict(own).items() if v}
    for k, v in own.items():
        try:
            dom.parsed(v)
        except ValueError as e:
            raise ParseError(f"{k}: {e}") from e
    return own


def listed(row: dict[str, Any]) -> list[dict[str, Any]]:
    """Events of a list page, one for each different address."""
    s = _selectors(row)
    root, seen, out = dom.tree(dom.decoded(row["body"])), set(), []
    for box in root.select(s["list"]):
        for link in box.select(s["list_link"]):
            url = joined(row.get("final_url"), link.attrs.get("href"))
            if url is None or not url.lower().startswith(("http://", "https://")) or url in seen:
                continue
            seen.add(url)
            title = _shown(box.first(s["list_title"])) if "list_title" in s else link.text()
            if title:
                out.append({"title": title, "url": url, "date_texts": _date_texts(box.first(s["list_date"])) if "list_date" in s else []})
    return out


def detail(row: dict[str, Any]) -> list[dict[str, Any]]:
    """The fields of a detail page."""
    s = _selectors(row)
    root = dom.tree(dom.decoded(row["body"]))
    pick = lambda k: _shown(root.first(s[k])) if k in s else None
    speakers = [t for t in (_shown(n) for n in root.select(s["detail_speaker"])) if t] if "detail_speaker" in s else []
    return [{
        "title": pick("detail_title"), "date_texts": _date_texts(root.first(s["detail_date"])) if "detail_date" in s else [],
        "location": pick("detail_location"), "description": pick("detail_description"), "speakers": speakers,
        "words": page_fields(root)["words"], "links": media_links(root, row.get("final_url")),
    }]


# Feeds


ENTRY = "title string, url string, date string, native_id string, summary string"


def _day(text: str | None) -> str | None:
    """The UTC date of a feed's time."""
    if not text:
        return None
    text = text.strip()
    try:
        when = datetime.datetime.fromisoformat(text)
    except ValueError:
        try:
            when = parsedate_to_datetime(text)
        except (ValueError, TypeError, IndexError):
            return None
    if when.tzinfo is not None:
        when = when.astimezone(datetime.UTC)
    return when.date().isoformat()


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _xml(text: str) -> ElementTree.Element:
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", text, re.I):
        raise ParseError("a feed may not declare entities")
    try:
        return ElementTree.fromstring(text.encode())
    except ElementTree.ParseError as e:
        raise ParseError(f"feed: {e}") from e


def feed(row: dict[str, Any]) -> list[dict[str, Any]]:
    """Entries of an RSS, Atom or JSON feed that have a title and an http(s) link."""
    text = dom.decoded(row["body"]).lstrip("﻿ \t\r\n")
    found = _json_feed(text) if text.startswith("{") else _xml_feed(text)
    return [e for e in found if e["title"] and e["url"] and e["url"].lower().startswith(("http://", "https://"))]


def _json_feed(text: str) -> list[dict[str, Any]]:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ParseError(f"feed: {e}") from e
    items = data.get("items")
    if not isinstance(items, list):
        raise ParseError("feed without items")
    fields = ("title", "url", "external_url", "date_published", "date_modified", "summary", "content_text")
    for i in items:
        odd = [f for f in fields if isinstance(i, dict) and not isinstance(i.get(f), str | None)]
        if odd:
            raise ParseError(f"feed: {odd[0]} is no text")
    return [{"title": i.get("title"), "url": i.get("url") or i.get("external_url"), "date": _day(i.get("date_published") or i.get("date_modified")), "native_id": str(i["id"]) if i.get("id") else None, "summary": i.get("summary") or i.get("content_text")} for i in items if isinstance(i, dict)]


def _xml_feed(text: str) -> list[dict[str, Any]]:
    root = _xml(text)
    out = []
    for e in root.iter():
        if _local(e.tag) not in ("item", "entry"):
            continue
        first: dict[str, str] = {}
        links: list[tuple[str | None, str]] = []
        for c in e:
            name, value = _local(c.tag), "".join(c.itertext()).strip()
            if name == "link":
                href = c.get("href") or value
                if href:
                    links.append((c.get("rel"), href))
            elif value:
                first.setdefault(name, value)
        link = next((h for rel, h in links if rel in (None, "alternate")), links[0][1] if links else None)
        date = next((d for d in (_day(first.get(k)) for k in ("pubdate", "published", "date", "updated")) if d), None)
        out.append({"title": first.get("title"), "url": link, "date": date, "native_id": first.get("guid") or first.get("id"), "summary": first.get("description") or first.get("summary") or first.get("content")})
    if not out and _local(root.tag) not in ("rss", "feed", "rdf"):
        raise ParseError("not a feed")
    return out


# Calendars


CALENDAR = "title string, url string, native_id string, dtstart string, dtend string, duration string"


def depth(text: str) -> int:
    """How deep BEGIN and END nest in unfolded text."""
    now = most = 0
    for line in text.splitlines():
        word = line.strip().upper()
        if word.startswith("BEGIN:"):
            now += 1
            most = max(most, now)
        elif word.startswith("END:"):
            now = max(0, now - 1)
    return most


def _unescaped(value: str) -> str:
    return re.sub(r"\\([\;,nN])", lambda m: "\n" if m[1] in "nN" else m[1], value)


def calendar(row: dict[str, Any]) -> list[dict[str, Any]]:
    """VEVENTs with a title and an http(s) address."""
    text = re.sub(r"\r?\n[ \t]", "", dom.decoded(row["body"]))
    if depth(text) > DEEPEST:
        raise ParseError(f"calendar nests deeper than {DEEPEST}")
    if "BEGIN:VCALENDAR" not in text.upper():
        raise ParseError("not a calendar")
    out, stack, now = [], [], None
    for line in text.splitlines():
        head, colon, value = line.partition(":")
        if not colon:
            continue
        name = head.partition(";")[0].strip().upper()
        if name == "BEGIN":
            stack.append(value.strip().upper())
            if stack[-1] == "VEVENT":
                now = {}
        elif name == "END":
            if stack and stack.pop() == "VEVENT" and now is not None:
                out.append(now)
                now = None
        elif now is not None and stack and stack[-1] == "VEVENT":
            now.setdefault(name, value)
    rows = [{"title": _unescaped(e["SUMMARY"]), "url": e["URL"].strip(), "native_id": e.get("UID"), "dtstart": e.get("DTSTART"), "dtend": e.get("DTEND"), "duration": e.get("DURATION")} for e in out if "SUMMARY" in e and "URL" in e]
    return [r for r in rows if r["title"].strip() and r["url"].lower().startswith(("http://", "https://"))]


# JSON-LD


NODE = "name string, url string, id string, start string, description string, location string, talks array<struct<title:string,evidence:string,names:array<string>>>, no_address boolean"


def json_blocks(html: str) -> list[Any]:
    """The JSON of all ld+json scripts; broken ones are left out."""
    out = []
    for s in dom.tree(html).select("script"):
        if s.attrs.get("type", "").strip().lower() == "application/ld+json":
            try:
                out.append(json.loads("".join(s.texts())))
            except (ValueError, RecursionError):
                continue
    return out


def is_event(node: Any) -> bool:
    kinds = node.get("@type") if isinstance(node, dict) else None
    return any(isinstance(k, str) and k.endswith("Event") for k in (kinds if isinstance(kinds, list) else [kinds]))


def event_nodes(block: Any) -> list[dict[str, Any]]:
    """Events of a block: itself, its elements, or those in its graphs."""
    if isinstance(block, list):
        return [x for x in block if is_event(x)]
    if is_event(block):
        return [block]
    if isinstance(block, dict) and "@graph" in block:
        graph = block["@graph"]
        return [e for x in (graph if isinstance(graph, list) else [graph]) for e in event_nodes(x)]
    return []


def names_of(value: Any) -> list[str]:
    """Names of a person, of several, or a plain name."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [n for x in value for n in names_of(x)]
    return [value["name"]] if isinstance(value, dict) and isinstance(value.get("name"), str) else []


LINKED = f"words string, nodes array<struct<{','.join(f.strip().replace(' ', ':', 1) for f in ['ord int', 'name string', 'url string', 'id string', 'description string', 'location string', 'talks array<struct<title:string,evidence:string,names:array<string>>>', 'no_address boolean'])}>>"


def linked_page(row: dict[str, Any]) -> list[dict[str, Any]]:
    """All words of a page, and its event nodes by their place."""
    words = page_fields(dom.tree(dom.decoded(row["body"])))["words"]
    return [{"words": words, "nodes": [{"ord": k} | {f: v for f, v in n.items() if f != "start"} for k, n in enumerate(linked(row))]}]


def linked(row: dict[str, Any]) -> list[dict[str, Any]]:
    """Event nodes of a page with their talks."""
    text = lambda v: v if isinstance(v, str) else None
    address = lambda v: v if isinstance(v, str) and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v) else None
    out = []
    for block in json_blocks(dom.decoded(row["body"])):
        for e in event_nodes(block):
            talks = [{"title": None, "evidence": "performer", "names": names_of(e["performer"])}] if "performer" in e else []
            below = e.get("subEvent")
            for s in below if isinstance(below, list) else [below] if is_event(below) else []:
                if isinstance(s, dict) and "performer" in s:
                    talks.append({"title": text(s.get("name")), "evidence": "sub_event", "names": names_of(s["performer"])})
            place = e.get("location")
            out.append({
                "name": text(e.get("name")), "url": address(e.get("url")), "id": address(e.get("@id")), "start": text(e.get("startDate")),
                "description": dom.stripped(e["description"]) if isinstance(e.get("description"), str) else None,
                "location": text(place) or (text(place.get("name")) if isinstance(place, dict) else None),
                "talks": [t for t in talks if t["names"]], "no_address": address(e.get("url")) is None and address(e.get("@id")) is None,
            })
    return out
