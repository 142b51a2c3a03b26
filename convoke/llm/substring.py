"""Op 10: removal of passages that occurred before, with a log-structured index.

A window is ``window`` consecutive words of a document.  Every word covered by a
window whose word sequence also starts earlier (in a smaller doc_id, or before
in the same document) is removed; windows are judged on the input.

Index.  A run is an immutable table of the hashes of windows seen, sorted within
buckets.  Each new batch of documents is merge-joined with the run, bucket by
bucket: windows that the run has, and windows that an earlier document of the
batch has, are repeated; the others are the batch's own run.  When there are more
than ``most_runs``, they are compacted into one.  The list of runs is a numbered
file that is made once, so a batch is in the index or isn't, and an index can be
opened again later: old texts are never read again.

Dealing.  A window's bucket is that of its anchor, the leftmost least hash among
its ``anchor``-word sequences.  Neighbouring windows mostly share one, so they
travel as one run of windows with one place, and rows are packed by bucket and
part of a batch: 10 bytes a window and little else.  Within a part only the first
of equal windows travels; a passage that a third of all documents hold is sent
once for each part.  Buckets are as many as keep one in a worker's memory.

Verification.  Windows are told apart by 80 bits: 64 decide where they are sorted,
and 16 of another rolled hash verify those that meet; both are made of the same
64-bit hashes of words.

Rows: a null or empty text has no words.  Rows that share a doc_id are documents of
their own and remove nothing from each other; rows with a null doc_id come after all
others of a batch, by a hash of their text.  Rows that are equal are removed from alike.
A document of fewer words than a window keeps all of them.  Texts of any length are read
whole; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as X
from .bits import bitmap, passes
from ..plans.tables import columns, drop, names, put_once, read_text, shared, written

WINDOW, ANCHOR = 20, 10
#: Bytes of text that are dealt together, windows of a bucket in a batch (about), and batches of one removal.
PART, ROOM, BATCHES = 3 << 19, 1 << 20, 2
#: Rows that Spark hands to a worker at once: batches of texts take memory on both sides.
_ROWS, _ROWS_CONF = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"
_CHECK = 0xC2B2AE3D27D4EB4F
#: How windows are dealt to buckets: runs that were dealt in another way can't be joined with.
_DEALT = "low bits"
_U = np.uint64


def slide(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of ``width`` neighbours from each position on, and where it is first."""
    best, at, have = h, np.arange(len(h)), 1
    if len(h) < width:
        return best[:0], at[:0]
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        less = best[step:] < best[:n]
        best, at = np.where(less, best[step:], best[:n]), np.where(less, at[step:], at[:n])
        have += step
    return best, at


def windows(hashes: np.ndarray, bounds: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside one text, their text, anchor hash and anchor position."""
    least, at = slide(X.rolled(hashes, anchor), window - anchor + 1)
    start = np.arange(len(least))
    text = np.searchsorted(bounds, start, "right") - 1
    ok = start + window <= bounds[text + 1] if len(start) else np.zeros(0, bool)
    return start[ok], text[ok], least[ok], at[ok]


def repeats(h: np.ndarray, c: np.ndarray, d: np.ndarray, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows (hash, check) also start earlier (at a smaller d, or before in the same d and t), and which others are like a former one in all."""
    again, same = np.zeros(len(h), bool), np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    equal = sorted_h[1:] == sorted_h[:-1]
    few = order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])] if len(h) else order
    few = few[np.lexsort((at[few], t[few], d[few], c[few], h[few]))]
    if len(few):
        key = [x[few] for x in (h, c, d, t)]
        new = [np.concatenate([[True], x[1:] != x[:-1]]) for x in key]
        window = np.flatnonzero(new[0] | new[1])
        document = np.flatnonzero(new[0] | new[1] | new[2] | new[3])
        place, number = np.arange(len(few)), np.arange(len(few))
        first = window[np.searchsorted(window, number, "right") - 1]
        own = document[np.searchsorted(document, number, "right") - 1]
        later = (key[2] > key[2][first]) | (at[few] > at[few][own])
        again[few] = later
        same[few] = ~later & (place > own)
    return again, same


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary for each stretch of the values."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of stretches that begin at ``first``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


#: kind 0: ranges to remove (d, t, at, len by range), dealt by document; kind 1: windows (h, c) that are new; kind 2: windows of a part with the ranges that they stand in and those ranges' documents.
_ROW = "bucket int, kind int, h binary, c binary, doc binary, at binary, len binary, d binary, t binary"
_TYPES = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("h", "c", "doc", "at", "len", "d", "t")]])
_OF = {"h": np.uint64, "c": np.uint16, "doc": np.uint32, "at": np.uint32, "len": np.uint32, "d": np.int64, "t": np.int32}


def _rows(bucket: np.ndarray, kind: int, **parts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Rows of one kind from values and their bounds by row."""
    n = len(bucket)
    own = {"bucket": pa.array(bucket.astype(np.int32)), "kind": pa.array(np.full(n, kind, np.int32))}
    for c, of in _OF.items():
        own[c] = _packed(parts[c][0].astype(of, copy=False), parts[c][1]) if c in parts else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_pydict(own, schema=_TYPES)


def _ranges(flags: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows with neighbouring starts in one text: their first window, and how many."""
    at = np.flatnonzero(flags)
    new = np.concatenate([[True], (np.diff(start[at]) != 1) | (np.diff(text[at]) != 0)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def _removed(d: np.ndarray, t: np.ndarray, at: np.ndarray, size: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of kind 0 of ranges."""
    group = (X.mix(d.view(_U) ^ t.astype(np.int64).view(_U)) % _U(buckets)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    one, first = np.unique(group[order], return_index=True)
    bounds = np.append(first, len(group))
    return _rows(one, 0, d=(d[order], bounds), t=(t[order], bounds), at=(at[order], bounds), len=(size[order], bounds))


def _dealt(part: pa.RecordBatch, window: int, anchor: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of a part by bucket, and the ranges that the part itself shows to be repeated."""
    data, offsets = X.buffers(part.column("text"))
    _, _, words, bounds = X.words(data, offsets)
    start, text, least, anchored = windows(words, bounds, window, anchor)
    if not len(start):
        return
    h, c = X.rolled(words, window)[start], (X.rolled(words, window, _CHECK)[start] >> _U(48)).astype(np.uint16)
    d, t, at = part.column("d").to_numpy()[text], part.column("t").to_numpy()[text], start - bounds[text]
    again, same = repeats(h, c, d, t, at)
    if again.any():
        first, size = _ranges(again, text, start)
        yield _removed(d[first], t[first], at[first], size, buckets)
    # Runs of windows that share text and anchor, dealt by the anchor's bucket.
    go = np.flatnonzero(~(again | same))
    new = np.concatenate([[True], (np.diff(start[go]) != 1) | (np.diff(text[go]) != 0) | (np.diff(anchored[go]) != 0)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(go)))
    # A least hash is low: its leading bits would give the first bucket eleven times its share.
    bucket = (least[go[first]] % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, size, bucket = first[order], size[order], bucket[order]
    one, row = np.unique(bucket, return_index=True)
    row = np.append(row, len(bucket))
    take, lead = go[_spread(first, size)], go[first]
    document = np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(text[lead]) != 0)])
    listed = np.flatnonzero(document)
    listed_row = np.searchsorted(listed, row)
    local = np.cumsum(document) - 1 - np.repeat(listed_row[:-1], np.diff(row))
    window_row = _bounds(size)[row]
    yield _rows(
        one, 2, h=(h[take], window_row), c=(c[take], window_row), doc=(local, row), at=(at[lead], row), len=(size, row),
        d=(d[lead[listed]], listed_row), t=(t[lead[listed]], listed_row),
    )


def _column(rows: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), _OF[name]) for x in rows.column(name).combine_chunks()]


def _joined(parts: list[np.ndarray], of: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, of)


def _known(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and checks of the rows of kind 1, sorted."""
    h, c = (_joined(_column(rows, n), _OF[n]) for n in ("h", "c"))
    if rows.num_rows == 1:
        return h, c
    order = np.lexsort((c, h))
    return h[order], c[order]


def _within(h: np.ndarray, c: np.ndarray, known_h: np.ndarray, known_c: np.ndarray) -> np.ndarray:
    """Which (h, c) are among the known, which are sorted."""
    out, at = np.zeros(len(h), bool), np.searchsorted(known_h, h)
    live = np.flatnonzero(at < len(known_h))
    while len(live):
        there = known_h[at[live]] == h[live]
        live = live[there]
        out[live] |= known_c[at[live]] == c[live]
        live = live[~out[live]]
        at[live] += 1
        live = live[at[live] < len(known_h)]
    return out


def _met(new: pa.Table, old: pa.Table, buckets: int, last: bool = False) -> pa.Table:
    """A bucket of a batch against the runs: ranges that are repeated (kind 0), and, unless it is the last batch, the windows that are new (kind 1)."""
    kind = new.column("kind").to_numpy()
    out = [new.filter(pa.array(kind == 0)).cast(_TYPES)]
    own = new.filter(pa.array(kind == 2))
    if own.num_rows:
        parts = {c: _column(own, c) for c in _OF}
        size = _joined(parts["len"], np.uint32).astype(np.int64)
        base = _bounds(np.array([len(x) for x in parts["d"]]))[:-1]
        doc = _joined([x.astype(np.int64) + b for x, b in zip(parts["doc"], base.tolist(), strict=True)], np.int64)
        h, c, d, t = (_joined(parts[n], _OF[n]) for n in ("h", "c", "d", "t"))
        which = np.repeat(np.arange(len(size)), size)
        at = _spread(_joined(parts["at"], np.uint32).astype(np.int64), size)
        again, _ = repeats(h, c, d[doc[which]], t[doc[which]], at)
        if old.num_rows:
            again |= _within(h, c, *_known(old))
        if again.any():
            first, many = _ranges(again, which, at)
            out.append(pa.Table.from_batches([_removed(d[doc[which[first]]], t[doc[which[first]]], at[first], many, buckets)]))
        if not last:
            fresh_h, fresh_c = h[~again], c[~again]
            order = np.lexsort((fresh_c, fresh_h))
            fresh_h, fresh_c = fresh_h[order], fresh_c[order]
            one = np.concatenate([[True], (fresh_h[1:] != fresh_h[:-1]) | (fresh_c[1:] != fresh_c[:-1])]) if len(order) else np.zeros(0, bool)
            out.append(pa.Table.from_batches([_run(own.column("bucket")[0].as_py(), fresh_h[one], fresh_c[one])]))
    X.trimmed()
    return pa.concat_tables(out)


def _run(bucket: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """A row of kind 1."""
    bounds = np.array([0, len(h)])
    return _rows(np.array([bucket]), 1, h=(h, bounds), c=(c, bounds))


def _merged(one: pa.Table, other: pa.Table) -> pa.Table:
    """A bucket of two runs as one."""
    h, c = _known(pa.concat_tables([one, other]))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
    bucket = (one if one.num_rows else other).column("bucket")[0].as_py()
    return pa.Table.from_batches([_run(bucket, h[new], c[new])])


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, d (the order of documents) and t (tells rows of one doc_id apart)."""
    hashed = F.xxhash64("text")
    late = F.shiftrightunsigned(hashed, 2) + F.lit(1 << 62)
    return columns(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), late).alias("d"), F.shiftright(hashed, 32).cast("int").alias("t"))


class FingerprintIndex:
    """Runs of the windows seen so far; ``ingest`` adds a batch, ``compact`` merges runs.

    ``path``: a folder that the whole cluster shares; what an index there holds is kept and used on.
    Without one the index is gone with ``close``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, anchor: int = ANCHOR, most_runs: int = 1, buckets: int | None = None) -> None:
        self.spark, self.kept, self.most_runs = spark, path is not None, most_runs
        self.path = (path or shared(spark)).rstrip("/")
        self.tables: dict[str, str] = {}
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        made = {"window": window, "anchor": min(anchor, window), "tasks": tasks, "buckets": 1 << max(4, (max(buckets or 1, 2 * tasks) - 1).bit_length()), "dealt": _DEALT, "runs": []}
        found = self._newest()
        if found is None and not put_once(spark, f"{self.path}/RUNS.0", json.dumps(made)):
            raise RuntimeError("another one is opening this index")
        self.version, self.list = found or (0, made)
        if found and (self.list["window"], self.list["anchor"]) != (made["window"], made["anchor"]):
            raise ValueError(f"this index has windows of {self.list['window']} words")
        if self.list.get("dealt") != _DEALT:
            raise ValueError("this index deals its windows to buckets in another way: make it anew")

    def _newest(self) -> tuple[int, dict] | None:
        numbers = sorted(int(n[5:]) for n in names(self.spark, self.path) if n.startswith("RUNS.") and n[5:].isdigit())
        return (numbers[-1], json.loads(read_text(self.spark, f"{self.path}/RUNS.{numbers[-1]}"))) if numbers else None

    def _listed(self, runs: list[str]) -> None:
        """Makes the runs the index's, if no other writer came first."""
        new = self.list | {"runs": runs}
        if not put_once(self.spark, f"{self.path}/RUNS.{self.version + 1}", json.dumps(new)):
            raise RuntimeError("another batch was faster")
        self.version, self.list = self.version + 1, new

    def _write(self, rows: DataFrame) -> str:
        """Rows as a table of its own, bucketed by bucket: joins with it don't shuffle it."""
        folder, name = f"run-{uuid.uuid4().hex}", f"convoke_{uuid.uuid4().hex}"
        before = self.spark.conf.get(_ROWS_CONF)
        self.spark.conf.set(_ROWS_CONF, str(_ROWS))
        try:
            rows.write.format("parquet").bucketBy(self.list["tasks"], "bucket").option("path", f"{self.path}/{folder}").saveAsTable(name)
        finally:
            self.spark.conf.set(_ROWS_CONF, before)
        self.tables[folder] = name
        return folder

    def _table(self, folder: str) -> DataFrame:
        if folder not in self.tables:
            name = f"convoke_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({_ROW}) USING parquet CLUSTERED BY (bucket) INTO {self.list['tasks']} BUCKETS LOCATION '{self.path}/{folder}'")
            self.tables[folder] = name
        return self.spark.table(self.tables[folder])

    def _forget(self, folder: str) -> None:
        if folder in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(folder)}")
        drop(self.spark, f"{self.path}/{folder}")

    def ingest(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Adds a batch (d, t, text); d, t, at and len of its repeated windows, as ranges of starts.

        What it returns is read from the batch's run, until the next ``compact`` or ``close``.
        Of the last batch of an index that goes with ``close`` the windows needn't be kept.
        """
        if last and self.kept:
            raise ValueError("an index with a path has no last batch")
        if len(self.list["runs"]) > self.most_runs:
            self.compact()
        window, anchor, buckets = self.list["window"], self.list["anchor"], self.list["buckets"]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _gathered(batches):
                yield from _dealt(part, window, anchor, buckets)
                X.trimmed()

        new = batch.select("d", "t", "text").mapInArrow(deal, _ROW)
        old = self.spark.createDataFrame([], _ROW)
        for k, folder in enumerate(self.list["runs"]):
            run = self._table(folder).filter("kind = 1")
            old = old.unionByName(run) if k else run
        made = self._write(new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(lambda a, b: _met(a, b, buckets, last), _ROW))
        self._listed([*self.list["runs"], made])
        return self._table(made).filter("kind = 0")

    def compact(self) -> None:
        """Merges all runs into one; the old ones go once it is listed."""
        old = self.list["runs"]
        while len(self.list["runs"]) > 1:
            first, second, *others = self.list["runs"]
            one, other = (self._table(x).filter("kind = 1") for x in (first, second))
            merged = self._write(one.groupBy("bucket").cogroup(other.groupBy("bucket")).applyInArrow(_merged, _ROW))
            self._listed([merged, *others])
            old = [*old, merged]
        for x in old:
            if x not in self.list["runs"]:
                self._forget(x)

    def close(self) -> None:
        """Drops this session's names of the runs, and the runs themselves if the index has no path."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}
        if not self.kept:
            drop(self.spark, self.path)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of about PART bytes of text, whatever the batches' sizes."""
    held, size = [], 0
    for whole in batches:
        for part in X.slices(whole, "text", PART):
            own = int(X.buffers(part.column("text"))[1][-1])
            if held and size + own > PART:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held, size = [*held, part], size + own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_document(rows: pa.Table) -> pa.Table:
    """d, t and the ranges (pairs of start and number) of each document of a group."""
    d, t, at, size = (_joined(_column(rows, n), _OF[n]) for n in ("d", "t", "at", "len"))
    order = np.lexsort((at, t, d))
    d, t = d[order], t[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
    pairs = np.stack([at[order], size[order]], 1).ravel().astype(np.uint32)
    return pa.table({"d": pa.array(d[new]), "t": pa.array(t[new]), "ranges": _packed(pairs, np.append(new, len(d)) * 2)})


def _clean(part: pa.RecordBatch, window: int) -> tuple[list[int], list[int], list[str]]:
    """Words, removed words and kept text of each row, given its ranges."""
    data, offsets = X.buffers(part.column("text"))
    starts, ends, _, bounds = X.words(data, offsets)
    raw, n, removed, kept = data.tobytes(), [], [], []
    for k, ranges in enumerate(part.column("ranges").to_pylist()):
        a, b = int(bounds[k]), int(bounds[k + 1])
        step = np.zeros(b - a + 1, np.int64)
        if ranges:
            at, size = np.frombuffer(ranges, np.uint32).reshape(-1, 2).T.astype(np.int64)
            np.add.at(step, at, 1)
            np.subtract.at(step, at + size - 1 + window, 1)
        keep = np.cumsum(step)[:-1] == 0
        n.append(b - a)
        removed.append(int((~keep).sum()))
        kept.append(b" ".join([raw[i:j] for i, j in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist(), strict=True)]).decode("utf-8", "replace"))
    return n, removed, kept


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, texts: bool = True, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if ``texts``, kept (the words left, joined by one space).

    With an index, docs are one batch: windows that it has already are repeated, and
    the batch's are added.  Without one, the documents go into a new one in
    ``batches`` ranges of doc_id.
    """
    spark = docs.sparkSession
    docs = _ordered(docs)
    if index is None:
        low, high, size = docs.agg(F.min("doc_id"), F.max("doc_id"), F.sum(F.octet_length("text"))).first()
        cuts = [] if low is None else [low + (high - low + 1) * k // batches for k in range(1, batches)]
        own = FingerprintIndex(spark, None, window, anchor, most_runs=batches, buckets=int((size or 0) / 6 / max(1, batches) / ROOM) + 1)
        found = []
        for k in range(len(cuts) + 1):
            within = F.lit(True) if not k else F.col("doc_id") >= cuts[k - 1]
            within = within & (F.col("doc_id") < cuts[k]) if k < len(cuts) else within | F.col("doc_id").isNull()
            found.append(own.ingest(docs.filter(within), last=k == len(cuts)))
    else:
        own, found, window = None, [index.ingest(docs)], index.list["window"]
    ranges = found[0]
    for x in found[1:]:
        ranges = ranges.unionByName(x)
    ranges = written(ranges.groupBy("bucket").applyInArrow(_by_document, "d long, t int, ranges binary"))
    if own is not None:
        own.close()
    owners = spark.sparkContext.broadcast(bitmap(ranges.select(F.xxhash64("d", "t").alias("o")), "o"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finishes what has nothing to remove; other rows keep their text."""
        own = owners.value
        for whole in batches:
            for part in X.slices(whole, "text", 2 << 20):
                data, offsets = X.buffers(part.column("text"))
                raw = data.tobytes()
                rest = passes(own, part.column("o").to_numpy().view(_U)).tolist()
                split = [None if x else raw[a:b].split() for x, a, b in zip(rest, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                kept = [None if ws is None else b" ".join(ws) for ws in split]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "d": part.column("d"), "t": part.column("t"),
                    "text": pa.array([t if x else None for x, t in zip(rest, part.column("text").to_pylist(), strict=True)], pa.string()),
                    "n_words": pa.array([None if ws is None else len(ws) for ws in split], pa.int64()),
                    "kept": pa.array([None if x is None or not texts else x.decode("utf-8", "replace") for x in kept], pa.string()),
                    "kept_sha256": pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                })

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in X.slices(whole, "text", 2 << 20):
                rest, done = part.filter(part.column("kept_sha256").is_null()), part.filter(part.column("kept_sha256").is_valid())
                n, removed, kept = _clean(rest, window)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.concat_arrays([done.column("doc_id"), rest.column("doc_id")]),
                    "n_words": pa.concat_arrays([done.column("n_words"), pa.array(n, pa.int64())]),
                    "n_removed": pa.array([0] * done.num_rows + removed, pa.int64()),
                    "kept_sha256": pa.concat_arrays([done.column("kept_sha256"), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string())]),
                    "kept": pa.concat_arrays([done.column("kept"), pa.array(kept if texts else [None] * len(kept), pa.string())]),
                })

    halves = docs.withColumn("o", F.xxhash64("d", "t")).mapInArrow(plain, "doc_id long, d long, t int, text string, n_words long, kept string, kept_sha256 string")
    out = halves.join(ranges, ["d", "t"], "left").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
l AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (
  SELECT w.doc_id, ws, CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]) END AS kept
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
