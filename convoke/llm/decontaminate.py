"""Op 1: benchmark decontamination, in DataFrame functions only.

Texts are lower-cased in A-Z and cut into words (letters, digits and all bytes
from 128 on).  A window is ``size`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window.  Document words inside any
occurrence of a window are hit.

The benchmark's windows are a set of hashes, broadcast while their counted
number and size are within bounds, and joined by shuffle beyond.  Each
document's windows are hashed and probed where its row is; a hit is verified by
comparing words within the join, so only true hits leave it.  A document's words
never travel with a window: one marker per document and the hits go to the
aggregate, which is per row of documents.  By shuffle, markers are dealt by their
rows and pass a left join, so they gather nowhere.

Null and empty texts have no words; null item ids are left out of items.  Rows with the
same doc_id are rows of their own; repeated items count by their different ids.  Texts of
any length are probed whole.  An empty benchmark hits nothing; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import columns, written

SIZE = 10
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.char_length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def hashes(words: Column) -> Column:
    """A hash of each word: windows of them make less garbage than windows of words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """n (words), h (hash), w (words) and items (sorted ids) of each different window."""
    rows = columns(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws"))
    rows = rows.filter(F.size("ws") > 0).withColumn("n", F.least(F.size("ws"), F.lit(size)))
    rows = rows.select("item_id", "ws", "n", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1)).alias("at"))
    rows = rows.select("item_id", "n", F.slice("ws", F.col("at"), F.col("n")).alias("w"))
    return rows.groupBy("n", "w").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("h", F.xxhash64(hashes(F.col("w"))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row for each row of docs (_at is 0) and for each hit (_at: its first word, from 1; wn: its words).

    All columns of docs and _row, _words (their number) and items come along.
    """
    known = benchmark_windows(benchmark, size)
    counted = known.agg(F.count("*"), F.collect_set("n"), F.sum(F.octet_length(F.concat_ws(" ", "w", "items")))).first()
    sizes = sorted(counted[1]) or [size]
    small = counted[0] <= broadcast_windows and (counted[2] or 0) <= BROADCAST_BYTES
    marker = known.sparkSession.range(1).select(F.lit(0).alias("n"), F.array().cast("array<string>").alias("w"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("h"))
    known = known.select("n", "w", "items", "h")
    known = known.unionByName(marker) if small else known
    known = known.select(F.col("n").alias("wn"), F.col("w").alias("ww"), "items", F.col("h").alias("wh"))
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_ws", words(F.col("text")))
    rows = rows.withColumn("_hs", hashes(F.col("_ws"))).withColumn("_words", F.size("_ws").cast("long"))
    # Position 0 is each document's marker, which meets the marker of the windows.
    lengths = F.explode(F.array(*[F.lit(n) for n in sizes]))
    if len(sizes) > 1:
        rows = rows.withColumn("_n", lengths)
        starts = F.when(F.col("_n") == sizes[0], 0).otherwise(1)
    else:
        rows, starts = rows.withColumn("_n", F.lit(sizes[0])), F.lit(0)
    last = F.size("_ws") - F.col("_n") + 1
    rows = rows.withColumn("_at", F.explode(F.when(last >= starts, F.sequence(starts, last)).otherwise(F.when(starts == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))))
    window = lambda c: F.slice(c, F.greatest("_at", F.lit(1)), F.when(F.col("_at") == 0, 0).otherwise(F.col("_n")))
    own = window("_ws")
    rows = rows.withColumn("_h", F.when(F.col("_at") == 0, F.lit(0).cast("long") if small else F.xxhash64("_row")).otherwise(F.xxhash64(window("_hs"))))
    # Written as two comparisons, equality of words stays a condition and the hash alone is the key.
    if small:
        same = (own <= F.col("ww")) & (own >= F.col("ww"))
        return rows.join(F.broadcast(known), (F.col("_h") == F.col("wh")) & same).drop("_ws", "_hs")
    # By shuffle a row carries its own window's words, never the document's.
    rows = rows.withColumn("_own", own).drop("_ws", "_hs")
    same = (F.col("_own") <= F.col("ww")) & (F.col("_own") >= F.col("ww"))
    met = rows.join(known, (F.col("_h") == F.col("wh")) & same, "left")
    return met.filter((F.col("_at") == 0) | F.col("wh").isNotNull()).drop("_own")


def _joined(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int) -> DataFrame:
    """Per row of docs: the columns in keep, n_words, hits and items."""
    met = find_leaks(docs, benchmark, size)
    hit = F.when(F.col("_at") > 0, F.struct(F.col("_at").alias("start"), F.col("wn").alias("n")))
    return met.groupBy("_row", *[F.col(f"`{c}`") for c in keep], F.col("_words").alias("n_words")).agg(
        F.array_sort(F.collect_list(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def covered(hits: Column) -> Column:
    """Number of different words in hits sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).cast("int").alias("next"))
    end = lambda x: x["start"] + x["n"]
    add = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), end(x) - F.greatest(s["next"], x["start"]))).cast("long").alias("n"),
        F.greatest(s["next"], end(x)).cast("int").alias("next"),
    )
    return F.aggregate(hits, zero, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, hits and contaminated of every row."""
    found = _joined(columns(docs, "doc_id", "text"), benchmark, ["doc_id"], size)
    found = found.withColumn("n_hit", covered(F.col("hits")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "hits", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs, all columns, that no benchmark window occurs in.

    Rows are numbered once, in a written table: whatever plan docs is, its rows keep their numbers.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    text = own[[c.lower() for c in docs.columns].index("text")]
    rows = written(docs.toDF(*own).withColumn("number", F.monotonically_increasing_id()))
    met = find_leaks(rows.select("number", F.col(text).alias("text")), benchmark, size)
    leaks = met.filter("_at > 0").select(F.col("number").alias("leak")).distinct()
    return rows.join(leaks, rows["number"] == leaks["leak"], "left_anti").select(*own).toDF(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
