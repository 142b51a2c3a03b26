"""Op 3: exact top-k inner products by length-bucketed retrieval.

Components become floor(1024 * x).  Vectors are dealt and sorted by length, so
each batch of a task is a bucket of like lengths.  For a query, a bucket can
only matter if its longest vector would reach the query's k-th score so far;
that score over both lengths is the bucket's cosine threshold.  Above 1 the
bucket is skipped.  A high threshold is used on coordinates: a vector that
reaches it must agree with the query in its largest coordinate within bounds
that follow from the threshold.  A low one is used on lengths: only vectors
that are long enough are multiplied.  What is left is verified by exact products,
so results are those of all pairs.

Queries come in blocks of bounded size and number of bytes, dealt once to a table
by block.  One block at a time is sent to all tasks (the driver holds no more than
that), meets all vectors where they are, and its tasks' k best for each query are
written; the plan doesn't grow with the blocks.  Thresholds start from the
``SEEDS`` longest vectors.

Vectors that are null, or hold a null or non-finite component, take no part.  A
vector is no candidate for its own row; other rows with its id are.  Missing
components of a shorter vector count as 0.  Products beyond a long are held at
its ends.  Ties go to the smaller vec_id, null
last; a null vec_id is no query.  Repeated ids are queries and candidates of their
own; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import columns, drop, shared, written

K, EVERY, BLOCK, SEEDS, BUCKET = 10, 100, 8192, 1000, 512
#: Bytes of a block of queries, and of each side of the products that are verified at a time.
BLOCK_BYTES, PAIR_BYTES = 32 << 20, 16 << 20
#: From this cosine on coordinates prune more than they cost.
COORDINATE = 0.5
_LAST = np.iinfo(np.int64).max


def prepared(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, norm and x (the floors, as doubles) of every vector that takes part, written by length."""
    e = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = columns(vectors, "vec_id", "embedding").filter(sound)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * 1024).cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm)
    return written(rows.repartitionByRange(F.desc("norm"), F.asc("vec_id"), F.asc("uid")).sortWithinPartitions(F.desc("norm"), F.asc("vec_id"), F.asc("uid")))


def matrix(rows: list, width: int) -> np.ndarray:
    """The vectors as rows, filled up with 0."""
    out = np.zeros((len(rows), width))
    for k, x in enumerate(rows):
        n = min(len(x), width)
        out[k, :n] = x[:n]
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a with those of b, as int64 (held at its ends)."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) @ np.array([[int(v) for v in row] for row in b], object).reshape(b.shape).T
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in row] for row in whole], np.int64).reshape(whole.shape)


class Best:
    """The k best (score, id, uid) of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.queries = k, queries
        self.q, self.score, self.id, self.uid = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        q, score, ids, uid = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids), (self.uid, uid)))
        order = np.lexsort((uid, ids, ~score, q))
        first = np.searchsorted(q[order], np.arange(self.queries + 1))
        rank = np.arange(len(order)) - first[q[order]]
        order = order[rank < self.k]
        self.q, self.score, self.id, self.uid = q[order], score[order], ids[order], uid[order]

    def least(self) -> np.ndarray:
        """The k-th score of each query; -inf if there are fewer."""
        first = np.searchsorted(self.q, np.arange(self.queries + 1))
        out = np.full(self.queries, -np.inf)
        full = np.flatnonzero(np.diff(first) >= self.k)
        out[full] = self.score[first[full + 1] - 1]
        return out


class Block:
    """A block of queries with their floors to scores."""

    def __init__(self, uid: list[int], ids: list[int], x: np.ndarray) -> None:
        self.uid, self.ids, self.x = np.array(uid, np.int64), np.array(ids, np.int64), x
        self.norm = np.sqrt((x * x).sum(1))
        unit = x / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.abs(unit).argmax(1) if x.shape[1] else np.zeros(len(x), np.int64)
        self.at = unit[np.arange(len(x)), self.focus] if x.shape[1] else np.zeros(len(x))
        self.floor = np.full(len(x), -np.inf)

    def bucket(self, best: Best, norm: np.ndarray, ids: np.ndarray, uid: np.ndarray, x: np.ndarray) -> None:
        """Adds what a bucket, longest first, has to the best."""
        floor = np.maximum(self.floor, best.least())
        longest = max(float(norm[0]), 1e-300)
        # A little slack: rounding must never prune what is on the threshold.
        cosine = np.where(np.isfinite(floor), floor, -1.0) / np.maximum(self.norm * longest, 1e-300) - 1e-9
        cosine[(self.norm == 0) & (floor <= 0)] = -1
        live = np.flatnonzero(cosine <= 1)
        if not len(live):
            return
        strict = live[cosine[live] >= COORDINATE]
        rows, cols = [], []
        if len(strict):
            # An angle of at most arccos(t) between two vectors bounds their coordinates' angles.
            turn, angle = np.arccos(np.clip(cosine[strict], -1, 1)), np.arccos(np.clip(self.at[strict], -1, 1))
            low, high = np.cos(np.minimum(np.pi, angle + turn)) - 1e-6, np.cos(np.maximum(0, angle - turn)) + 1e-6
            own = (x / np.maximum(norm, 1e-300)[:, None])[:, self.focus[strict]].T
            may = (own >= low[:, None]) & (own <= high[:, None])
            r, c = np.nonzero(may)
            rows.append(strict[r])
            cols.append(c)
        loose = live[cosine[live] < COORDINATE]
        if len(loose):
            need = np.where(np.isfinite(floor[loose]) & (floor[loose] > 0), floor[loose] / np.maximum(self.norm[loose], 1e-300), 0) * (1 - 1e-9)
            last = np.searchsorted(-norm, -need, "right")
            score = dot(self.x[loose], x[: int(last.max(initial=0))])
            r, c = np.nonzero((score >= floor[loose][:, None]) & (np.arange(score.shape[1]) < last[:, None]) & (self.uid[loose][:, None] != uid[None, : score.shape[1]]))
            best.add(loose[r], score[r, c], ids[c], uid[c])
        if rows:
            r, c = np.concatenate(rows), np.concatenate(cols)
            step = max(1, PAIR_BYTES // max(8, 8 * x.shape[1]))
            for k in range(0, len(r), step):
                i, j = r[k : k + step], c[k : k + step]
                score = paired(self.x[i], x[j])
                ok = (score >= floor[i]) & (self.uid[i] != uid[j])
                best.add(i[ok], score[ok], ids[j[ok]], uid[j[ok]])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows with rows."""
    if max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(a.shape[1], 1) < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([dot(a[k : k + 1], b[k : k + 1])[0, 0] for k in range(len(a))], np.int64)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best; queries are the rows whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    rows = prepared(vectors)
    width, most = rows.agg(F.max(F.size("x")), F.count("*")).first()
    width = width or 0
    block = max(1, min(block, BLOCK_BYTES // max(8, 8 * width)))
    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    place = shared(spark)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    dealt.repartition(min(blocks, 200), "block").write.partitionBy("block").parquet(place)
    seeds = rows.orderBy(F.desc("norm"), "vec_id", "uid").limit(SEEDS).collect() if most else []
    found = shared(spark)
    for b in range(blocks):
        mine = spark.read.schema(dealt.schema).parquet(place).filter(F.col("block") == b).collect()
        own = Block([r["uid"] for r in mine], [r["vec_id"] for r in mine], matrix([r["x"] for r in mine], width))
        if mine and seeds:
            start = Best(len(mine), k)
            own.bucket(start, np.array([r["norm"] for r in seeds]), np.array([_LAST if r["vec_id"] is None else r["vec_id"] for r in seeds]), np.array([r["uid"] for r in seeds]), matrix([r["x"] for r in seeds], width))
            own.floor = start.least()
        sent = spark.sparkContext.broadcast(own)

        def read(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            best = Best(len(own.uid), k)
            for whole in batches:
                for at in range(0, whole.num_rows, BUCKET):
                    part = whole.slice(at, BUCKET)
                    x = matrix(part.column("x").to_pylist(), width) if _ragged(part.column("x"), width) else np.asarray(part.column("x").flatten()).reshape(part.num_rows, width)
                    own.bucket(best, part.column("norm").to_numpy(), part.column("vec_id").fill_null(_LAST).to_numpy(), part.column("uid").to_numpy(), x)
            yield pa.RecordBatch.from_pydict({"quid": pa.array(own.uid[best.q]), "query_id": pa.array(own.ids[best.q]), "vec_id": pa.array(best.id), "uid": pa.array(best.uid), "score": pa.array(best.score)})

        rows.mapInArrow(read, "quid long, query_id long, vec_id long, uid long, score long").write.mode("append").parquet(found)
        sent.destroy()
    drop(spark, place)
    out = spark.read.schema("quid long, query_id long, vec_id long, uid long, score long").parquet(found)
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("uid"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif(F.col("vec_id"), F.lit(_LAST)).alias("vec_id"), "score")


def _ragged(x: pa.ListArray, width: int) -> bool:
    return bool((np.diff(x.offsets.to_numpy()) != width).any()) or width == 0


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
