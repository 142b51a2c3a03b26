"""Op 8: text quality by logistic regression over hashed word n-grams.

Features are hashes of single words, of neighbouring words, and of the shapes of
one, two and three neighbours (a shape is a word's letter cases, digits, length
class and last byte), with a mark where a word repeats its neighbour.  Each
counts by its share of the text's features.  Weights are learned by
follow-the-regularised-leader updates (per-coordinate rates, L1 and L2) on a
sample of at most ``SAMPLE`` labelled rows, those whose doc_id hashes lowest;
a score is the logistic function of the sparse dot product with a text's
features.  A text without words (null, too) scores the bias alone.

Only text is an input of a score.  Rows with null or repeated ids are scored
like others, and texts of any length whole; an empty table gives none.  Labels whose
quality or doc_id is null are not learned from; of several labels of one id the
greatest counts, and of several rows of one id the one whose text has the least hash
is learned from.  Without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrowtext as X
from .rows import map_rows
from ..plans.tables import columns

SAMPLE, BITS, EPOCHS, KEEP = 6000, 20, 6, 0.3
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 1e-4, 1e-4, 6.0
_U = np.uint64
#: Byte classes: 1 capital, 2 small letter, 3 digit, 4 above ASCII, 0 other.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor (a null id is the text "null")."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % divisor


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word's shape."""
    kind = _CLASS[data]
    shape = np.zeros(len(starts), _U)
    for k, most in ((1, 3), (2, 1), (3, 1), (4, 1)):
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(kind == k, dtype=np.int32)])
        shape = shape * _U(4) + np.minimum(total[ends] - total[starts], most).astype(_U)
    last = data[ends - 1]
    shape = shape * _U(256) + np.where(_CLASS[last] > 0, 0, last).astype(_U)
    return shape * _U(4) + np.minimum((ends - starts) >> 3, 3).astype(_U)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Streams of feature numbers, one for each word, and the words' bounds per text.

    Where an n-gram would reach over a text's end, its feature is 0, whose weight stays 0.
    """
    starts, ends, words, bounds = X.words(data, offsets)
    n = len(words)
    if not n:
        return [np.zeros(0, np.int64)] * 6, bounds
    shape = X.mix(shapes(data, starts, ends) + _U(1))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    pick = lambda h, k: np.where(left >= k, (X.mix(h) >> _U(64 - BITS)).astype(np.int64), 0)
    after = lambda h, k: np.concatenate([h[k:], np.zeros(k, _U)])[:n]
    two = shape * _U(3) + after(shape, 1)
    same = words == after(words, 1)
    out = [
        pick(words, 1),
        pick(words * _U(5) + after(words, 1), 2),
        pick(shape, 1),
        pick(two, 2),
        pick(two * _U(7) + after(shape, 2), 3),
        pick(np.where(same, _U(11), _U(13)), 2),
    ]
    return out, bounds


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (different feature numbers, their shares, label) rows."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    solve = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, label = rows[k]
            w, wb = solve(z[at], n[at]), float(solve(np.array(zb), np.array(nb)))
            p = 1 / (1 + np.exp(-np.clip(w @ x + wb, -30, 30)))
            for_all = p - label
            g = for_all * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            step = (np.sqrt(nb + for_all**2) - np.sqrt(nb)) / ALPHA
            zb += for_all - step * wb
            nb += for_all**2
    return solve(z, n).astype(np.float32), float(solve(np.array(zb), np.array(nb)))


def shares(found: np.ndarray) -> bytes:
    """The different numbers (int32) and then their scaled shares (float32)."""
    at, count = np.unique(found, return_counts=True)
    x = (count / max(1, found.size) * SCALE).astype(np.float32)
    return at[at > 0].astype(np.int32).tobytes() + x[at > 0].tobytes()


def learn(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled rows whose remainder by ``fold`` is not ``held``."""
    known = columns(labels, "doc_id", "quality").filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    known = known.filter(remainder(F.col("doc_id"), fold) != held).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in X.slices(whole, "text"):
                streams, bounds = features(*X.buffers(part.column("text")))
                all_of = np.stack(streams, 1).astype(np.int32)
                found = [shares(all_of[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "found": pa.array(found, pa.binary())})

    met = columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    # One row of each id, or a repeated id would bring any number of rows.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    own = met.withColumn("n", first).filter("n = 1").drop("n")
    rows = sorted((doc_id, found, label) for doc_id, label, found in own.mapInArrow(read, "doc_id long, label int, found binary").toLocalIterator())
    half = lambda found, k: np.frombuffer(found, (np.int32, np.float32)[k]).reshape(2, -1)[k]
    return train([(half(found, 0), half(found, 1), label) for _, found, label in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: str = "doc_id") -> DataFrame:
    """Column ``keep`` and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    field = docs.schema[keep]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for whole in batches:
            for part in X.slices(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_pydict({keep: part.column(keep), "score": pa.array(scores(part, weights, bias))})

    return columns(docs, keep, "text").mapInArrow(read, f"`{keep}` {field.dataType.simpleString()}, score double")


def scores(part: pa.RecordBatch, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each row of a batch."""
    streams, bounds = features(*X.buffers(part.column("text")))
    total = np.zeros(part.num_rows)
    for found in streams:
        total += X.sums(weights[found].astype(np.float64), bounds)
    n = np.diff(bounds) * len(streams)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) * SCALE + bias, -30, 30)))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of docs, all columns, that score ``least`` or more.

    A null or empty text scores the bias alone; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def pick(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batch, "text", 2 << 20):
            yield part.filter(pa.array(scores(part, *shared.value) >= least))

    return map_rows(docs, pick)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
