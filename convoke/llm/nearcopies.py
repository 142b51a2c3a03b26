"""Op 5 for near copies of texts: SimHash by Golay keys at five-word Jaccard of 0.8 or more, verified exactly.

Texts are lower-cased in A-Z and cut into words; a text is the set of its
five-word shingles (a text of fewer words is one shingle, a text without words,
null too, has none).  Equal sets are one class, so exact copies are never
compared.  Two classes are near copies if their sets share 4/5 of their union or
more; components over near copies keep one row.

Candidates.  Three bits' distance of one fingerprint holds few pairs at 0.8: they
differ in 15 bits of 100.  So a class has ``BANDS`` SimHash fingerprints of 64 bits,
and each gives two segments of 23 bits, the length of the (23, 12) Golay code.  A
segment is decoded to the codewords of it and of its neighbours at one bit (1 or 6
of them): segments that differ in two bits or less always share one, and those of
a pair at 0.8 do in 60 of 100 cases.  A key is a codeword of either segment; some
fingerprint of a pair gives an equal key in 93 of 100 cases at 0.8, 98 at 0.85 and
over 99 from 0.9 on (by simulation; measured recall is in the README).  Sizes and
the bits of all fingerprints let pass what can be at 0.8 (five standard
deviations).  Whatever passes is decided by the sets themselves, so no link is false.

A group of many near copies shares keys.  First each member is compared with one
other: the first that may be near it, in one order of all classes, among the first
ones of the keys of FEW of its fingerprints.  These links are trees, whose roots are found by jumps.  Then, where
a key still has several components, all members outside its largest one are compared
with all the others, within the join, which gives out pairs between components only;
the components over them are those of all.  Keys are dealt twice, without texts or sets:
candidates cost no further shuffle, however many there are.

Rows with null or repeated ids are rows of their own.  Long texts are whole sets;
an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import arrowtext as X
from .bits import bitmap, passes
from .rows import map_rows
from .simhash import decode
from ..operators.components import components
from ..plans.tables import columns, drop, shared, written

SHINGLE, BANDS, LENGTH, MOST = 5, 6, 23, 6
#: Bits of all fingerprints, and of the SHOWN that key rows carry, that near copies may differ in.
APART, SHOWN, SOME = 95, 2, 40
#: Fingerprints whose keys give the first links; all of them give the others.
FEW = 2
_U = np.uint64
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS, dtype=_U) * _U(2) + _U(1)
_PRINTS = [f"f{k}" for k in range(BANDS)]
_SHOWN = _PRINTS[:SHOWN]


def shingles(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different shingles (64-bit hashes) of all texts, and their bounds."""
    data, offsets = X.buffers(part.column("text"))
    _, _, h, bounds = X.words(data, offsets, fold=X.LOWER)
    rolled = X.rolled(h, SHINGLE)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found.append(np.unique(rolled[a : b - SHINGLE + 1]) if b - a >= SHINGLE else X.rolled(h[a:b], b - a) if b > a else np.zeros(0, _U))
    return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


def classes(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    return X.mix(X.sums(X.mix(v), at) + np.diff(at).astype(_U))


def fingerprints(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS SimHash fingerprints (rows, BANDS) of sets that aren't empty: a bit is 1 if over half of the shingles' hashes have it."""
    out, size = np.zeros((len(at) - 1, BANDS), _U), np.diff(at)
    for band in range(BANDS):
        counts = np.zeros((len(at) - 1, 64), np.int64)
        for a in range(0, len(v), 1 << 15):
            b = min(len(v), a + (1 << 15))
            h = X.mix(v[a:b] * _ODD[band])
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b, "left"))
            counts[first:last] += np.add.reduceat(bits, np.maximum(at[first:last] - a, 0), axis=0, dtype=np.int32)
        out[:, band] = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


@cache
def _codewords() -> np.ndarray:
    """Codeword index of each 23-bit vector."""
    step = 1 << 18
    return np.concatenate([decode(np.arange(a, a + step)).astype(np.int16) for a in range(0, 1 << LENGTH, step)])


def near(segments: np.ndarray) -> np.ndarray:
    """The codewords (rows, MOST) of each segment and of its neighbours at one bit; -1 fills up."""
    table = _codewords()
    found = np.sort(np.stack([table[segments], *(table[segments ^ (1 << k)] for k in range(LENGTH))], 1), 1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, 1)[:, :MOST]


def keys(prints: np.ndarray, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first fingerprints (of rows, BANDS) and the row that each is of."""
    made, rows = [], []
    for band in range(bands):
        low, high = (near((prints[:, band] >> _U(LENGTH * k) & _U((1 << LENGTH) - 1)).astype(np.int64)).astype(np.int32) for k in range(2))
        row, a, b = np.nonzero((low[:, :, None] >= 0) & (high[:, None, :] >= 0))
        made.append(np.int32(band << 24) | low[row, a] << np.int32(12) | high[row, b])
        rows.append(row)
    return np.concatenate(made), np.concatenate(rows)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in X.slices(whole, "text", 1 << 20):
            v, at = shingles(part)
            full, prints = np.diff(at) > 0, np.zeros((part.num_rows, BANDS), _U)
            if full.any():
                prints[full] = fingerprints(v, np.concatenate([at[:-1][full], at[-1:]]))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "cls": _signed(classes(v, at)), "n": pa.array(np.diff(at).astype(np.int32))} | {c: _signed(prints[:, k]) for k, c in enumerate(_PRINTS)})
        X.trimmed()


def keyed(rooted: DataFrame, bands: int = BANDS) -> DataFrame:
    """A row for each key of each class (id, root and some fingerprints), dealt by key."""
    parts, own = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("id", "root", *_SHOWN)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                key, row = keys(np.stack([part.column(c).to_numpy().view(_U) for c in _PRINTS], 1), bands)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(part.column(c).take(row) for c in own)], ["key", *own])
            X.trimmed()

    # Keys are many times what they come from: the classes are dealt out first.
    return rooted.select("id", "root", *_PRINTS).repartition(parts, "id").mapInArrow(read, "key int, " + ", ".join(f"{c} long" for c in own)).repartition(parts, "key")


def _apart(one: list[Column], other: list[Column]) -> Column:
    """Bits in which fingerprints differ."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(one, other, strict=True)), F.lit(0))


def _near(one: Column, other: Column) -> Column:
    """Whether two sets share 4/5 of their union: 9 x shared >= 4 x (both sizes)."""
    return 9 * F.size(F.array_intersect(one, other)) >= 4 * (F.size(one) + F.size(other))


class _Tables:
    """Written tables of one run, to be removed when it is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, frame: DataFrame) -> DataFrame:
        self.paths.append(shared(self.spark))
        return written(frame, self.paths[-1])

    def drop(self) -> None:
        for p in self.paths:
            drop(self.spark, p)


def _verified(pairs: DataFrame, one: DataFrame, texts: DataFrame, tables: _Tables) -> DataFrame:
    """The pairs (a, b) of ids that are near copies.  Only sets of classes that are in pairs leave the texts."""
    left, right = (one.select(F.col("id").alias(c), F.col("cls").alias(f"cls{c}"), F.col("n").alias(f"n{c}"), *[F.col(f).alias(f"{f}{c}") for f in _PRINTS]) for c in "ab")
    bits = _apart([F.col(f"{f}a") for f in _PRINTS], [F.col(f"{f}b") for f in _PRINTS])
    may = (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (bits <= APART)
    pairs = tables.keep(pairs.join(left, "a").join(right, "b").filter(may).select("a", "b", "clsa", "clsb"))
    some = pairs.select(F.col("clsa").alias("c")).union(pairs.select("clsb")).distinct()
    wanted = pairs.sparkSession.sparkContext.broadcast(bitmap(some, "c"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in X.slices(whole, "text", 1 << 20):
                v, at = shingles(part)
                cls = classes(v, at)
                pick = np.flatnonzero(passes(wanted.value, cls))
                _, first = np.unique(cls[pick], return_index=True)
                pick = pick[first]
                bounds = np.concatenate([[0], np.cumsum(np.diff(at)[pick])])
                take = np.arange(bounds[-1]) + np.repeat(at[:-1][pick] - bounds[:-1], np.diff(at)[pick])
                yield pa.RecordBatch.from_pydict({"cls": _signed(cls[pick]), "set": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(v[take]))})
            X.trimmed()

    held = tables.keep(texts.select("text").mapInArrow(sets, "cls long, set array<long>").groupBy("cls").agg(F.first("set").alias("set")))
    wanted.destroy()
    left, right = held.select(F.col("cls").alias("clsa"), F.col("set").alias("x")), held.select(F.col("cls").alias("c"), F.col("set").alias("y"))
    return tables.keep(pairs.join(left, "clsa").join(right, (F.col("clsb") == F.col("c")) & _near(F.col("x"), F.col("y"))).select("a", "b"))


def _roots(first: DataFrame, tables: _Tables) -> DataFrame:
    """(node, root) of trees of links from a to b: each round halves the ways that are left."""
    done, now = None, tables.keep(first.select(F.col("a").alias("node"), F.col("b").alias("root")))
    while True:
        up = now.select(F.col("node").alias("above"), F.col("root").alias("top"))
        if done is not None:
            up = up.unionByName(done.select(F.col("node").alias("above"), F.col("root").alias("top")))
        next_ = tables.keep(now.join(up, F.col("root") == F.col("above"), "left").select("node", F.coalesce("top", "root").alias("root"), F.col("above").isNull().alias("settled")))
        own = next_.filter("settled").drop("settled")
        done = own if done is None else done.unionByName(own)
        now = next_.filter("NOT settled").drop("settled")
        if now.isEmpty():
            return done


def components_of(rows: DataFrame, texts: DataFrame, tables: _Tables) -> DataFrame:
    """cls and root (equal for near copies) of every class that has a set."""
    distinct = rows.filter("n > 0").drop("doc_id").dropDuplicates(["cls"])
    one = tables.keep(distinct.withColumn("id", F.monotonically_increasing_id()))

    order = Window.partitionBy("key").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = lambda of: [F.col(f"{of}{f}") for f in _SHOWN]
    each = keyed(one.withColumn("root", F.col("id")), FEW).drop("root").withColumn("o", F.xxhash64("id"))
    each = each.withColumn("l", F.first(F.struct("o", "id", *_SHOWN)).over(order)).filter((F.col("id") != F.col("l.id")) & (_apart(shown(""), shown("l.")) <= SOME))
    best = tables.keep(each.groupBy("id").agg(F.min(F.struct("l.o", "l.id")).alias("l")).select(F.col("id").alias("a"), F.col("l.id").alias("b")))
    roots = _roots(_verified(best, one, texts, tables), tables)

    rooted = tables.keep(one.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node"))
    again, by_key, by_root = keyed(rooted), Window.partitionBy("key"), Window.partitionBy("key", "root")
    several = again.withColumn("low", F.min("root").over(by_key)).withColumn("high", F.max("root").over(by_key)).filter("low <> high")
    several = several.withColumn("c", F.count("*").over(by_root))
    p = several.withColumn("main", F.first("root").over(by_key.orderBy(F.desc("c"), "root"))).filter("root <> main").alias("p")
    q = again.alias("q")
    # Two outside the largest component meet twice: once is enough.
    once = (F.col("q.root") == F.col("p.main")) | (F.col("p.root") < F.col("q.root"))
    more = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.root") != F.col("q.root")) & once & (_apart(shown("p."), shown("q.")) <= SOME))
    pairs = tables.keep(more.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct())
    found, at = _verified(pairs, one, texts, tables), rooted.select("id", "root")
    edges = found.join(at.toDF("a", "x"), "a").join(at.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(edges).select(F.col("node"), F.col("root").alias("top"))
    return rooted.join(merged, F.col("root") == F.col("node"), "left").select("cls", F.coalesce("top", "root").alias("root"))


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and cls of every row; and for each class its component's root and smallest doc_id (null ids don't count)."""
    texts, tables = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _Tables(docs.sparkSession)
    rows = written(texts.mapInArrow(_printed, "doc_id long, cls long, n int, " + ", ".join(f"{c} long" for c in _PRINTS)))
    roots = components_of(rows, texts, tables).withColumnRenamed("cls", "c")
    each = rows.groupBy("cls").agg(F.min("doc_id").alias("own"))
    # The class of texts without words has no set and is a component of its own.
    rooted = each.join(roots, F.col("cls") == F.col("c"), "left").select("cls", "own", F.coalesce("root", F.lit(-1)).alias("root"))
    least = rooted.groupBy("root").agg(F.min("own").alias("least"))
    known = written(rooted.join(least, "root").select("cls", "root", "least"))
    tables.drop()
    return rows.select("doc_id", "cls"), known


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that have an earlier near copy.

    The row with the smallest doc_id of each component stays.  Where ids repeat
    or are null, one row of the component stays (null ids last).
    """
    rows, known = near_copies(docs)
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        gone = rows.join(known, "cls").filter("doc_id <> least").select("doc_id")
        return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    name = "_near"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"

    def tag(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batch, "text"):
            yield part.append_column(name, _signed(classes(*shingles(part))))

    known = known.select(F.col("cls").alias(name + "c"), F.col("root").alias(name + "r"), F.col("least").alias(name + "l"))
    tagged = map_rows(docs, tag, **{name: LongType()})
    found = tagged.join(known, F.col(name) == F.col(name + "c")).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(name + "l")))
    one = found.withColumn(name + "n", F.row_number().over(Window.partitionBy(name + "r").orderBy("doc_id")))
    return one.filter(F.col(name + "n") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
