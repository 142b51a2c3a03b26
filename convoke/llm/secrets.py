"""Op 7: secrets in texts, by one automaton over all rules.

Base spans are the leftmost non-overlapping matches of each kind, of which those
that are too short are dropped:

- assign: a name, = or : and a value of 6 or more characters;
- access: AKIA and capitals or digits, 20 or more characters;
- hex: 24 or more lower-case hexadecimal digits.

The automaton (see ``automaton``) reads each byte once and tells which rules end
there; spans are read out of these ends alone.  For access and hex, a run of ends
is a span.  For assign there are rules for the names by their length, for a name
with its joint and for a name with joint and value: a run of joint ends follows
the last name end before it, the value begins after that run, and the run of
value ends there is the value.  Of these matches the leftmost non-overlapping
ones are base (short values keep their place but are dropped); all others with a
value that is long enough begin inside one of them and are added.  So a span
depends on its own line only, and work is linear.  No match holds a line break.

Offsets count code points; a null or empty text has no spans.  Texts of any
length are scanned whole.  Rows with the same doc_id are rows of their own; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as X
from .automaton import Automaton, compiled
from .rows import map_rows
from ..plans.tables import columns

KINDS = ("assign", "access", "hex")
NAMES = ("password", "passwd", "secret", "token", "api_?key")
VALUE, LEAST = "[A-Za-z0-9+/_.=-]", {"assign": 6, "access": 20, "hex": 24}
JOINT = r"""["']?\x20*[:=]\x20*["']?"""


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


NAME = "|".join(map(_either_case, NAMES))
#: Rules by bit: the kinds, then a name with its joint, then names by their length.
_JOINED, _NAMED = 3, {4: ("token",), 5: ("passwd", "secret", "apikey"), 6: ("api_key",), 7: ("password",)}


@cache
def automaton() -> Automaton:
    kinds = [f"({NAME}){JOINT}{VALUE}+", f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", f"[0-9a-f]{{{LEAST['hex']},}}"]
    return compiled([*kinds, f"({NAME}){JOINT}", *("|".join(map(_either_case, own)) for own in _NAMED.values())])


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive positions."""
    if not len(at):
        return at, at
    new = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], new + 1])], at[np.concatenate([new, [len(at) - 1]])]


def _assigned(at: np.ndarray, ending: np.ndarray) -> list[tuple[int, int, bool]]:
    """Spans (start, end, base) from the ends of all rules."""
    first, last = _runs(at[ending >> _JOINED & 1 == 1])
    values, stops = _runs(at[ending & 1 == 1])
    # The value's run that holds the position after the joint, if there is one.
    run = np.searchsorted(values, last + 1, "right") - 1
    ok = (run >= 0) & (stops[run] >= last + 1) if len(values) else np.zeros(len(last), bool)
    first, begin, end = first[ok], last[ok] + 1, stops[run[ok]] + 1 if len(values) else first[:0]
    named = ending >> 4 > 0
    names, kinds = at[named], ending[named]
    near = np.searchsorted(names, first) - 1
    length = np.zeros(len(first), np.int64)
    for bit, own in _NAMED.items():
        length[kinds[near] >> bit & 1 == 1] = len(own[0])
    found, done = [], 0
    for a, b, long in zip((names[near] - length + 1).tolist(), end.tolist(), (end - begin >= LEAST["assign"]).tolist(), strict=True):
        base = a >= done
        if base:
            done = b
        if long:
            found.append((a, b, base))
    return found


def spans(texts: list[bytes], rules: Automaton | None = None) -> list[list[tuple[int, int, int, bool]]]:
    """For each text its (start, end, kind, base) by start, then kind; in bytes."""
    raw = b"\n".join(texts)
    data = np.frombuffer(raw, np.uint8)
    at, ending = (rules or automaton()).hits(data)
    found: list[tuple[int, int, int, bool]] = []
    for k, kind in enumerate(KINDS):
        if kind == "assign":
            found += [(a, b, k, base) for a, b, base in _assigned(at, ending)]
        else:
            first, last = _runs(at[ending >> k & 1 == 1])
            found += [(a - LEAST[kind] + 1, b + 1, k, True) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    for a, b, k, base in sorted(found, key=lambda x: (x[0], x[2])):
        i = int(np.searchsorted(begins, a, "right")) - 1
        out[i].append((a - int(begins[i]), b - int(begins[i]), k, base))
    return out


def _points(text: bytes, own: list[tuple[int, int, int, bool]]) -> list[dict]:
    """The spans with offsets in code points."""
    if not own:
        return []
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"kind": KINDS[k], "start": int(lead[a]), "end": int(lead[b]), "base": base} for a, b, k, base in own]


_SPAN = "struct<kind:string,start:long,end:long,base:boolean>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row."""
    rules = automaton()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in X.slices(whole, "text"):
                data, offsets = X.buffers(part.column("text"))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                found = [_points(t, own) for t, own in zip(texts, spans(texts, rules), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "spans": pa.array(found, _SPANS)})

    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(read, f"doc_id long, spans array<{_SPAN}>")


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with each secret in ``text`` replaced by its kind in brackets; n_chars, if there, follows.

    Of secrets that overlap the first one's kind stands for all.  A null text stays null.
    """
    rules = automaton()

    def blot(text: bytes, own: list[tuple[int, int, int, bool]]) -> bytes:
        out, done = [], 0
        for a, b, k, _ in own:
            if a >= done:
                out += [text[done:a], f"[{KINDS[k].upper()}]".encode()]
            done = max(done, b)
        return b"".join([*out, text[done:]])

    def write(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batch, "text"):
            data, offsets = X.buffers(part.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = spans(texts, rules)
            if any(found):
                valid = part.column("text").is_valid().to_pylist()
                new = [None if not ok else blot(t, own).decode("utf-8", "replace") for ok, t, own in zip(valid, texts, found, strict=True)]
                part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(new, part.schema.field("text").type))
                if "n_chars" in part.schema.names:
                    k = part.schema.get_field_index("n_chars")
                    old = part.column("n_chars").to_pylist()
                    part = part.set_column(k, part.schema.field("n_chars"), pa.array([len(t) if own else n for t, own, n in zip(new, found, old, strict=True)], part.schema.field("n_chars").type))
            yield part

    return map_rows(docs, write)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets' rows."""
    joined = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))
