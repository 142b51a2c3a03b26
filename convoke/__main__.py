"""Commands: scan, sources, schema, doctor.

Exit codes: 0 done, 2 wrong use, 3 wrong configuration, 4 no usable source, 5 state trouble.
"""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from .functions.dates import today_in
from .plans import output as O
from .plans import scan as N
from .plans.state import SCHEMA_VERSION, ScanStore, StateError
from .schemas import CHANGE, EVENT, HEALTH, schema
from .sources import files, registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="convoke")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan", help="rank the events of collected documents")
    s.add_argument("--listings", required=True, help="documents of entry points (Parquet or JSON lines)")
    s.add_argument("--pages", required=True, help="documents of detail pages")
    s.add_argument("--sources", required=True, help="registry of sources (TOML)")
    for name in ("topics", "scholars", "interests", "state"):
        s.add_argument(f"--{name}")
    s.add_argument("--no-state", action="store_true")
    s.add_argument("--mode", choices=["upcoming", "recordings", "both"], default="both")
    s.add_argument("--before", type=int, default=30)
    s.add_argument("--after", type=int, default=180)
    s.add_argument("--today")
    s.add_argument("--timezone", default="UTC")
    s.add_argument("--max-events", type=int)
    s.add_argument("--max-talks", type=int, default=300)
    s.add_argument("--format", choices=["json", "jsonl"], default="json")
    s.add_argument("--detail", choices=["compact", "full"], default="compact")
    commands.add_parser("sources", help="list a registry").add_argument("--sources", required=True)
    commands.add_parser("schema", help="JSON Schema of the output")
    commands.add_parser("doctor", help="what a state holds").add_argument("--state", required=True)
    return p


def output_schema() -> dict:
    """JSON Schema of a scan's output."""
    parts = {name: {"type": "array", "items": O.json_schema(schema(ddl))} for name, ddl in (("sources", HEALTH), ("changes", CHANGE), ("events", EVENT))}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "ScanOutput", "type": "object", "properties": {"schema_version": {"type": "string"}, "generated_at": {"type": "string"}, "query": {"type": "object"}, **parts}, "required": ["schema_version", "generated_at", "query", *parts]}


def scan(spark: SparkSession, args: argparse.Namespace, out: TextIO, now: datetime.datetime) -> int:
    try:
        today = datetime.date.fromisoformat(args.today) if args.today else today_in(args.timezone, now)
        text = lambda path: files.read_text(spark, path)
        registries = N.Registries(
            registry.sources(spark, text(args.sources)), registry.topics(text(args.topics)) if args.topics else [],
            registry.scholars(text(args.scholars)) if args.scholars else [], registry.interests(text(args.interests)) if args.interests else None,
        )
        query = N.Query(today, args.mode, args.before, args.after, args.max_events, args.max_talks, args.detail)
        registry.validated(registries.sources)
    except (ValueError, KeyError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 3
    try:
        store = ScanStore(spark, args.state) if args.state and not args.no_state else None
        found = N.run(registries, files.read_documents(spark, args.listings), files.read_documents(spark, args.pages), query, now, store)
    except StateError as e:
        print(f"state: {e}", file=sys.stderr)
        return 5
    asked = {"mode": args.mode, "today": str(today), "before": args.before, "after": args.after, "max_events": args.max_events, "max_talks": args.max_talks}
    around = O.envelope(asked, found.health, found.changes, now.isoformat())
    (O.write_json if args.format == "json" else O.write_lines)(found.events, around, out)
    return 0


def main(argv: list[str] | None = None, out: TextIO | None = None, now: datetime.datetime | None = None) -> int:
    args = parser().parse_args(argv)
    out, now = out or sys.stdout, now or datetime.datetime.now(datetime.UTC)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "scan":
            return scan(spark, args, out, now)
        if args.command == "sources":
            for (line,) in registry.listing(registry.sources(spark, files.read_text(spark, args.sources))).collect():
                out.write(line + "\n")
        elif args.command == "schema":
            out.write(json.dumps(output_schema(), indent=2) + "\n")
        else:
            store = ScanStore(spark, args.state, read_only=True)
            out.write(json.dumps({"state": args.state, "schema_version": store.schema_version(), "latest": SCHEMA_VERSION, "events": store.table("events").count()}) + "\n")
    except N.ScanError as e:
        print(str(e), file=sys.stderr)
        return e.code
    except registry.RegistryError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 3
    except StateError as e:
        print(f"state: {e}", file=sys.stderr)
        return 5
    return 0


if __name__ == "__main__":
    sys.exit(main())
