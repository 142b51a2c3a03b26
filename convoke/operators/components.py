"""Connected components by alternating large-star and small-star steps.

Each step is a partial aggregate (the least neighbour) and a join, so a hub with
any number of neighbours is never gathered.  The number of rounds grows with the
logarithm of the longest path; each round's edges are a written table.  A caller
may name a number of edges up to which one task settles them instead: that spares
the driver the plans of the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import drop, shared, written


def _star(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with u's least neighbour or itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of every node and its root, of all edges."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_pydict({"u": pa.array(list(above), pa.int64()), "v": pa.array([root(x) for x in list(above)], pa.int64())})


def components(edges: DataFrame, most_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) for every node of the edges (columns a, b) but the roots; a root is the least node.

    Up to ``few`` edges, as they are without repeats, are settled in one task.
    """
    spark = edges.sparkSession
    path = shared(spark)
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    if few and now.count() <= few:
        to = shared(spark)
        done = written(now.coalesce(1).mapInArrow(_settled, "u long, v long"), to)
        drop(spark, path)
        return done.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        to = shared(spark)
        now = written(pairs, to)
        drop(spark, path)
        path = to
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
