"""Fetching: policy, robots rules, retries, budgets, and a reader of documents by request plans.

The rules are plain functions and column expressions.  ``fetch`` does what one
request needs, over a transport that is passed in, so that every rule can be
tested without a network; ``documents`` runs it as a partitioned reader, one
partition for each host, which keeps to the limits for one host.
"""

from __future__ import annotations

import datetime
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from typing import Any
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.urls import percent_decoded

AGENT = "convoke"


@dataclass(frozen=True)
class Policy:
    """Limits; times in seconds.

    ``global_jobs`` sources are asked at once, and a host by one of them at a time.
    Transports get ``connect_timeout`` and ``request_timeout``, within what is left
    until the deadline.
    """

    global_jobs: int = 8
    connect_timeout: float = 5.0
    request_timeout: float = 15.0
    deadline: float = 30.0
    redirects: int = 5
    retries: int = 1
    body_bytes: int = 4 << 20


# Robots


@dataclass(frozen=True)
class Robots:
    """(pattern, allow) rules of one agent."""

    rules: tuple[tuple[str, bool], ...] = ()

    def allows(self, url: str) -> bool:
        """The longest pattern that fits decides; allow wins a tie; none allows."""
        parts = urlsplit(url)
        target = percent_decoded((parts.path or "/") + ("?" + parts.query if parts.query else ""))
        fits = [(len(p), allow) for p, allow in self.rules if p and glob(p, target)]
        return max(fits, default=(0, True))[1]


ALL, NOTHING = Robots(), Robots((("/", False),))


def glob(pattern: str, target: str) -> bool:
    """Whether a robots pattern fits: * is any text, a last $ the end, else a prefix.

    With $, the first place where the pattern is used up decides, as in a scan
    that never goes back once it has got through.
    """
    anchored = pattern.endswith("$")
    parts = (pattern[:-1] if anchored else pattern).split("*")
    if not target.startswith(parts[0]):
        return False
    at = len(parts[0])
    for p in parts[1:]:
        found = target.find(p, at)
        if found < 0:
            return False
        at = found + len(p)
    return not anchored or parts[-1] == "" and len(parts) > 1 or at == len(target)


def glob_regex(pattern: Column) -> Column:
    """A regular expression for a robots pattern without the scan's early stop."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_decisions(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """url and allowed of requests (origin, url, target) under rules (origin, pattern, allow), by origin.

    Rules of an origin are one small array, so a request meets them without a row for each pair.
    """
    own = rules.filter("pattern <> ''").groupBy("origin").agg(F.collect_list(F.struct(F.length("pattern").alias("size"), "allow", glob_regex(F.col("pattern")).alias("regex"))).alias("rules"))
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.regexp(F.col("target"), r["regex"])), lambda r: F.struct(r["size"], r["allow"])))
    return requests.join(own, "origin", "left").select("url", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def parse_robots(text: str, agent: str = AGENT) -> Robots:
    """The rules for an agent: all groups with its name, else those for *, else none."""
    groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
    naming = False
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not name:
            continue
        if name == "user-agent":
            if not naming:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            naming = True
            continue
        naming = False
        if name in ("allow", "disallow") and groups:
            groups[-1][1].append((percent_decoded(value), name == "allow"))
    for wanted in (agent.lower(), "*"):
        own = [g for g in groups if wanted in g[0]]
        if own:
            return Robots(tuple(r for _, rules in own for r in rules))
    return ALL


# Requests


def allowed_hosts(explicit: list[str], entrypoint: str | None) -> list[str]:
    """The hosts that may be asked: those listed, else the entrypoint's; none means all."""
    own = [h.lower() for h in explicit] or ([urlsplit(entrypoint).hostname or ""] if entrypoint else [])
    return [h for h in own if h]


def host_allowed(url: Column, hosts: Column) -> Column:
    """Whether a host is on the list; an empty list allows all."""
    return (F.size(hosts) <= 0) | F.array_contains(hosts, U.host(url))


def retry_after(value: str, now: datetime.datetime) -> float | None:
    """Seconds to wait by a Retry-After header: a number, or a date whose weekday is right; the past is 0."""
    value = value.strip()
    if re.fullmatch(r"\d+", value):
        return float(value)
    if not re.fullmatch(r"[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT", value):
        return None
    try:
        when = parsedate_to_datetime(value)
    except ValueError:
        return None
    return max(0.0, (when - now).total_seconds()) if when.strftime("%a") == value[:3] else None


class FetchError(Exception):
    """A failed request; ``kind`` maps to a source status."""

    def __init__(self, kind: str, message: str = "") -> None:
        super().__init__(message or kind)
        self.kind = kind


@dataclass
class Answer:
    """What a transport gives."""

    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


class Timeout(float):
    """Seconds that an answer may take; ``connect`` of them for the connection."""

    connect: float

    def __new__(cls, whole: float, connect: float) -> Timeout:
        own = super().__new__(cls, whole)
        own.connect = min(whole, connect)
        return own


Transport = Callable[[str, Timeout], Answer]


@dataclass
class Budget:
    """Requests left to a source; every send takes one."""

    left: int

    def take(self) -> None:
        if self.left <= 0:
            raise FetchError("budget_exhausted")
        self.left -= 1


class Client:
    """Requests under a policy; robots files are asked once for each origin and list of hosts."""

    def __init__(self, transport: Transport, policy: Policy | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.transport, self.policy, self.clock, self.sleep = transport, policy or Policy(), clock, sleep
        self.robots: dict[tuple[str, tuple[str, ...]], Robots] = {}

    def know(self, rules: str | None) -> None:
        """Takes in robots rules that another client knew."""
        for origin, hosts, own in json.loads(rules or "[]"):
            self.robots.setdefault((origin, tuple(hosts)), Robots(tuple((p, allow) for p, allow in own)))

    def known(self, url: str) -> str:
        """The robots rules of an address's origin, as ``know`` takes them."""
        parts = urlsplit(url)
        origin = f"{parts.scheme}://{parts.netloc}"
        return json.dumps([[o, hosts, own.rules] for (o, hosts), own in self.robots.items() if o == origin])

    def _send(self, url: str, budget: Budget, until: float) -> Answer:
        left = until - self.clock()
        if left <= 0:
            raise FetchError("timeout", "deadline")
        budget.take()
        answer = self.transport(url, Timeout(min(self.policy.request_timeout, left), self.policy.connect_timeout))
        if len(answer.body) > self.policy.body_bytes:
            raise FetchError("too_large")
        return answer

    def _next(self, url: str, answer: Answer, hosts: list[str]) -> str:
        to = urljoin(url, answer.headers.get("location", ""))
        parts = urlsplit(to)
        if parts.scheme not in ("http", "https") or urlsplit(url).scheme == "https" and parts.scheme == "http":
            raise FetchError("redirect", "scheme")
        if hosts and parts.hostname not in hosts:
            raise FetchError("redirect", "host")
        return to

    def rules(self, url: str, hosts: list[str], budget: Budget, until: float) -> Robots:
        """The robots rules of an address's origin; 4xx allows all, trouble nothing."""
        parts = urlsplit(url)
        key = (f"{parts.scheme}://{parts.netloc}", tuple(sorted(hosts)))
        if key not in self.robots:
            at = key[0] + "/robots.txt"
            found = NOTHING
            try:
                for _ in range(self.policy.redirects + 1):
                    answer = self._send(at, budget, until)
                    if 300 <= answer.status < 400:
                        at = self._next(at, answer, hosts)
                        continue
                    if answer.status < 300:
                        found = parse_robots(answer.body.decode("utf-8", "replace"))
                    elif answer.status < 500:
                        found = ALL
                    break
            except FetchError as e:
                if e.kind in ("budget_exhausted", "timeout"):
                    raise
            self.robots[key] = found
        return self.robots[key]

    def fetch(self, url: str, hosts: list[str], budget: Budget, until: float) -> tuple[str, Answer]:
        """The final address and answer of a request."""
        tries = hops = 0
        while True:
            if hosts and urlsplit(url).hostname not in hosts:
                raise FetchError("redirect", "host")
            if not self.rules(url, hosts, budget, until).allows(url):
                raise FetchError("robots_denied")
            try:
                answer = self._send(url, budget, until)
            except ConnectionError as e:
                if tries >= self.policy.retries:
                    raise FetchError("network", str(e)) from e
                answer = Answer(503)
            if 300 <= answer.status < 400 and "location" in answer.headers:
                hops += 1
                if hops > self.policy.redirects:
                    raise FetchError("redirect", "too many")
                url = self._next(url, answer, hosts)
                continue
            if answer.status in (408, 429) or answer.status >= 500:
                if tries >= self.policy.retries:
                    raise FetchError("http_status", str(answer.status))
                tries += 1
                told = retry_after(answer.headers.get("retry-after", ""), datetime.datetime.now(datetime.UTC))
                pause = 0.5 * 2 ** (tries - 1) if told is None else told
                self.sleep(max(0.0, min(pause, until - self.clock())))
                continue
            if answer.status >= 400:
                raise FetchError("http_status", str(answer.status))
            return url, answer


FETCHED = "source string, url string, final_url string, status int, content_type string, body binary, fetched_at timestamp, error string, requests int, rules string"


def within_budget(plans: DataFrame, used: int = 2) -> DataFrame:
    """Plans of each source (source, request_budget, ord) that its budget covers, after the requests already used."""
    own = Window.partitionBy("source").orderBy("ord")
    return plans.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") + used <= F.col("request_budget")).drop("_n")


def documents(plans: DataFrame, transport: Transport, now: datetime.datetime, policy: Policy | None = None) -> DataFrame:
    """Fetched documents of plans (source, url, allowed_hosts, request_budget, ord); errors are rows.

    Plans may have what the source's earlier documents told: ``spent``, the requests made, and ``rules``,
    the robots rules known by then, which are not asked for again.

    A source's plans are in one partition and in order, bounded by its budget.  Partitions are as many as
    ``global_jobs``, so no more sources are asked at once; all sources whose first page is on a host are in
    one of them, so that host sees one request at a time, and its robots file is asked once.
    ``requests`` and ``rules`` tell the same of the source by then.
    """
    limits = policy or Policy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, budgets, until, spent = Client(transport, limits), {}, {}, {}
        for batch in batches:
            out: list[dict[str, Any]] = []
            for r in batch.to_pylist():
                already = r["spent"] or 0
                client.know(r["rules"])
                budget = budgets.setdefault(r["source"], Budget(r["request_budget"] - already))
                end = until.setdefault(r["source"], client.clock() + limits.deadline)
                row = {"source": r["source"], "url": r["url"], "final_url": None, "status": None, "content_type": None, "body": None, "fetched_at": now, "error": None}
                try:
                    row["final_url"], answer = client.fetch(r["url"], [h.lower() for h in r["allowed_hosts"] or []], budget, end)
                    row |= {"status": answer.status, "content_type": answer.headers.get("content-type"), "body": answer.body}
                except FetchError as e:
                    row["error"] = e.kind
                except Exception:  # noqa: BLE001 - a transport's trouble with one address may not end the others' scan
                    row["error"] = "network"
                spent[r["source"]] = r["request_budget"] - max(budget.left, 0)
                out.append(row | {"requests": spent[r["source"]], "rules": client.known(r["url"])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("source", pa.string()), ("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()), ("fetched_at", pa.timestamp("us", "UTC")), ("error", pa.string()), ("requests", pa.int32()), ("rules", pa.string())]))

    told = {"spent": F.lit(0), "rules": F.lit(None).cast("string")}
    own = plans.select("source", "url", "allowed_hosts", "request_budget", "ord", *[F.col(c) if c in plans.columns else v.alias(c) for c, v in told.items()])
    host = F.min(F.struct("ord", U.host(F.col("url")).alias("host"))).over(Window.partitionBy("source"))
    dealt = own.withColumn("_host", host["host"]).repartition(limits.global_jobs, "_host").sortWithinPartitions("source", "ord")
    return dealt.drop("ord", "_host").mapInArrow(run, FETCHED)


def is_listed(url: Column, source_url: Column) -> Column:
    """Whether a stub's address is its listing's, but for a node's number."""
    return F.coalesce(F.regexp_replace(url, r"[?&]event-node=[0-9]+$", "") == source_url, F.lit(False))


def detail_plans(stubs: DataFrame, max_depth: int | Column = 2) -> DataFrame:
    """A plan for each stub's page at depth 1, if the source goes that deep; the listing itself isn't asked again."""
    depth = max_depth if isinstance(max_depth, Column) else F.lit(max_depth)
    rows = stubs.filter((F.lit(1) <= depth) & ~is_listed(F.col("url"), F.col("source_url")))
    # Stubs with the same page ask for it once.
    return rows.groupBy("source", "url").agg(F.min("stub_ord").alias("ord"))
