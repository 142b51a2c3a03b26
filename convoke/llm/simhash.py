"""Op 5: SimHash near-duplicates, found by Golay codes.

Fingerprint.  Texts are lower-cased in A-Z and cut into words; a bit of the
fingerprint is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
word shingles, repeats included.  A text of fewer words than a shingle is one
shingle; a text without words (null, too) has fingerprint 0 and links like any
other.

Links.  Two fingerprints link at 3 or fewer differing bits.  A fingerprint is
four segments of 16 bits.  Three errors leave a segment without any, and among
those there is one whose right neighbour has one at most.  So a key is a segment
as it is and the index of a Golay codeword near its neighbour.  The (23, 12)
code is perfect: each vector has one codeword within 3 bits; the codewords of a
vector and of those one bit away are 6 at most, and two vectors that differ in
one bit share one.  Equal keys are joined and checked by counting bits within
the join, which gives out true links only.

Components are found over different fingerprints, so copies are never expanded
into pairs.  component_id is the smallest doc_id reachable; null ids don't count
(null if there is no other).  Rows that share a doc_id are rows of their own.  Texts
of any length are read whole, in steps of shingles; an empty table gives none.

A key that many different fingerprints have is compared with all of them: work
grows with the square of such a key's fingerprints, not of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as X
from ..operators.components import components
from ..plans.tables import columns, written

SHINGLE, DISTANCE = 3, 3
#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101
_LENGTH, _CHECKS, _SEGMENT = 23, 11, 16


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit vectors by the generator."""
    v = v.copy()
    for k in range(_LENGTH - 1, _CHECKS - 1, -1):
        v = np.where(v >> k & 1, v ^ (GENERATOR << (k - _CHECKS)), v)
    return v


@cache
def _errors() -> np.ndarray:
    """The error pattern of 3 bits at most for each syndrome."""
    patterns = np.array([sum(1 << k for k in at) for n in range(4) for at in combinations(range(_LENGTH), n)])
    out = np.zeros(1 << _CHECKS, np.int64)
    out[syndrome(patterns)] = patterns
    return out


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within 3 bits of each 23-bit vector."""
    return (v ^ _errors()[syndrome(v)]) >> _CHECKS


@cache
def segment_keys() -> np.ndarray:
    """For each 16-bit segment the codewords of it and of its neighbours at one bit; -1 fills up."""
    v = np.arange(1 << _SEGMENT)
    near = np.sort(np.stack([decode(v), *(decode(v ^ (1 << k)) for k in range(_SEGMENT))], 1), 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, 1)
    return near[:, : int((near >= 0).sum(1).max())]


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of uint64 fingerprints and the row that each is of."""
    parts = [(fingerprints >> np.uint64(_SEGMENT * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    found, rows, table = [], [], segment_keys()
    for k in range(4):
        near = table[parts[(k + 1) % 4]]
        row, col = np.nonzero(near >= 0)
        found.append(k << 28 | parts[k][row] << 12 | near[row, col])
        rows.append(row)
    return np.concatenate(found), np.concatenate(rows)


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The fingerprint of one text's lower-cased words."""
    if not words:
        return 0
    if len(words) <= shingle:
        made = [b" ".join(words)]
    else:
        made = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(42)), "<u8", len(made))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (a signed long) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in X.slices(whole, "text"):
                data, offsets = X.buffers(part.column("text"))
                low = data.tobytes().lower()
                found = [fingerprint(low[a:b].split(), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(read, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column fp) that differ in 3 bits at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            key, row = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(fp[row])})

    keyed = distinct.select("fp").mapInArrow(read, "key long, fp long")
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    return near.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, and root, the component's least fingerprint."""
    rows = written(fingerprints(docs, shingle))
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("fp", "root").join(least, "root")
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("root")
