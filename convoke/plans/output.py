"""Results as JSON, JSON lines, JSON Schema and files."""

from __future__ import annotations

import json
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import truncated

MOST_CHARACTERS = {"compact": 1200, "full": 8000}


def detailed(events: DataFrame, level: str = "compact") -> DataFrame:
    """Descriptions and abstracts cut to the level's length."""
    most = MOST_CHARACTERS[level]
    talks = F.transform("talks", lambda t: t.withField("abstract_text", truncated(t["abstract_text"], most)))
    return events.withColumns({"description": truncated(F.col("description"), most), "talks": talks})


def envelope(query: dict[str, Any], health: DataFrame, changes: DataFrame, generated_at: str) -> dict[str, Any]:
    """What stands around the events; health and changes are small by their caps."""
    rows = lambda f: [json.loads(x) for (x,) in f.select(F.to_json(F.struct("*"))).toLocalIterator()]
    return {"schema_version": "1.0", "generated_at": generated_at, "query": query, "sources": rows(health), "changes": rows(changes)}


def write_json(events: DataFrame, around: dict[str, Any], out: TextIO) -> None:
    """One indented document; events are streamed, not gathered."""
    head = json.dumps(around, indent=2, ensure_ascii=False)
    out.write(head[: head.rindex("}")].rstrip() + ',\n  "events": [')
    first = True
    for (text,) in events.select(F.to_json(F.struct(*events.columns))).toLocalIterator():
        out.write(("" if first else ",") + "\n" + "\n".join("    " + line for line in json.dumps(json.loads(text), indent=2, ensure_ascii=False).splitlines()))
        first = False
    out.write("]\n}\n" if first else "\n  ]\n}\n")


def write_lines(events: DataFrame, around: dict[str, Any], out: TextIO) -> None:
    """The envelope on the first line, then a line for each event."""
    out.write(json.dumps({"kind": "scan", **around}, ensure_ascii=False) + "\n")
    for (text,) in events.select(F.to_json(F.struct(F.lit("event").alias("kind"), *events.columns))).toLocalIterator():
        out.write(text + "\n")


def write_files(events: DataFrame, path: str) -> None:
    """Events as JSON files, written by all executors."""
    events.write.mode("overwrite").json(path)


_JSON_TYPES = {T.StringType: "string", T.BooleanType: "boolean", T.FloatType: "number", T.DoubleType: "number", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer"}


def json_schema(kind: T.DataType, title: str | None = None) -> dict[str, Any]:
    """A JSON Schema of a Spark type; fields that may be null need not be there."""
    if isinstance(kind, T.StructType):
        out: dict[str, Any] = {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable]}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    elif isinstance(kind, T.DateType):
        out = {"type": "string", "format": "date"}
    elif isinstance(kind, T.TimestampType):
        out = {"type": "string", "format": "date-time"}
    elif isinstance(kind, T.BinaryType):
        out = {"type": "string", "contentEncoding": "base64"}
    else:
        out = {"type": next(v for k, v in _JSON_TYPES.items() if isinstance(kind, k))}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, **out} if title else out


def breaks(old: dict[str, Any], new: dict[str, Any], at: str = "") -> list[str]:
    """What a new schema takes away from an old one: fields, types and allowed values; added required fields too."""
    found = []
    if old.get("type") != new.get("type"):
        found.append(f"{at or '/'}: type")
    if set(old.get("enum", [])) - set(new.get("enum", old.get("enum", []))):
        found.append(f"{at or '/'}: values")
    for name, kind in old.get("properties", {}).items():
        if name not in new.get("properties", {}):
            found.append(f"{at}/{name}: removed")
        else:
            found += breaks(kind, new["properties"][name], f"{at}/{name}")
    found += [f"{at}/{n}: required" for n in sorted(set(new.get("required", [])) - set(old.get("required", [])))]
    if "items" in old and "items" in new:
        found += breaks(old["items"], new["items"], f"{at}[]")
    return found
