"""Exact search, the pipeline, and the registered queries."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from convoke.llm import queries, topk


def brute(ids, vectors, k=10, every=100):
    width = max(map(len, vectors), default=0)
    x = np.array([[int(np.floor(1024 * float(c))) for c in v] + [0] * (width - len(v)) for v in vectors], object).reshape(len(ids), width)
    out = []
    for i, q in enumerate(ids):
        if q is None or q % every:
            continue
        found = sorted((-int((x[i] * x[j]).sum()), float("inf") if ids[j] is None else ids[j], j) for j in range(len(ids)) if j != i)
        out += [(q, n, None if d == float("inf") else d, -s) for n, (s, d, _) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["plain", "scaled", "few", "zeros", "close", "empty"])
def test_top_k(spark, case):
    rng = np.random.default_rng(3)
    n, width = {"few": (5, 4), "empty": (0, 3)}.get(case, (220, 8))
    v = rng.normal(size=(n, width))
    if case == "scaled":
        v *= 10 ** rng.uniform(-2, 1, (n, 1))
    if case == "zeros":
        v[:60], v[60:120] = 0, v[130]
    if case == "close":
        v = rng.normal(size=(3, width))[rng.integers(0, 3, n)] + 0.02 * v
    ids = [25 * k for k in range(n)]
    if case == "scaled":
        ids[3], ids[5] = None, 100
    rows = [*zip(ids, v.tolist(), strict=True), (9000, None), (9100, [float("nan")] * 3), (9200, [None]), (9300, [float("inf")])]
    frame = spark.createDataFrame([(i, x, "q") for i, x in rows], "vec_id long, embedding array<double>, norm string")
    got = sorted((tuple(r) for r in topk.top_k(frame, block=2 if case == "plain" else 2048).collect()), key=str)
    assert got == brute(ids, v.tolist())


def test_short_and_huge_vectors(spark):
    ids, v = [100, 1, 2, 3], [[1.0, 2.0], [1.0], [1e14, 1e14], [-1.0, 0.5]]
    got = sorted((tuple(r) for r in topk.top_k(spark.createDataFrame(list(zip(ids, v, strict=True)), "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == [(q, n, d, min(s, 2**63 - 1)) for q, n, d, s in brute(ids, v)]


def test_stages(spark, tmp_path):
    clean = [f"word{k} and some more text that is about topic {k} and nothing else at all today" for k in range(40)]
    junk = ["the### of$$$ and### to$$$ in### is$$$ that### it$$$ was###" for _ in range(10)]
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    texts = clean + junk + [clean[0], f"before {leak} after", "my password = hunter2hunter2 is here for you", None, "long " * 3000]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
        if name == "secrets":
            assert docs.filter("doc_id = 52").first().text == "my [ASSIGN] is here for you"
    assert [len(corpus_pipeline.STAGES), list(kept)] == [5, ["quality", "near_duplicates", "benchmarks", "secrets", "packing"]]
    assert kept["quality"] >= set(range(40)) | {51} and not kept["quality"] & set(range(40, 50))
    assert 50 not in kept["near_duplicates"] and kept["near_duplicates"] >= set(range(40))
    assert kept["near_duplicates"] - kept["benchmarks"] == {51} and kept["packing"] == kept["secrets"] == kept["benchmarks"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in any column, repeated rows and ids, and columns that clash with what stages use."""
    shape = "doc_id long, text string, lang string, _row int, number string, cls int, root string, d int, H string, `a.b` int"
    rows = [
        (1, "one two three four five six seven", None, 1, "n", 1, "r", 1, "h", 1), (1, "one two three four five six seven", "en", 1, "n", 1, "r", 1, "h", 1), (None, "one two three four five six seven", "en", None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None), (7, None, "x", 1, "n", 1, "r", 1, "h", 1), (7, "", "x", 1, "n", 1, "r", 1, "h", 1), (8, "token = abcdefgh and more words to read", "x", 1, "n", 1, "r", 1, "h", 1), (9, "w " * 40_000, "x", 1, "n", 1, "r", 1, "h", 1),
    ]
    for name, n in (("full", len(rows)), ("none", 0)):
        base = f"{tmp_path}/{name}"
        spark.createDataFrame(rows[:n], shape).write.parquet(f"{base}/documents.parquet")
        labels = [(1, 1), (8, 1), (1, 0), (None, 1), (9, None)][: n and 5]
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([(None, "six seven"), (1, None), (2, "more words to read"), (2, "--")][: n and 4], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        docs, left = spark.read.parquet(f"{base}/documents.parquet"), {}
        columns = docs.columns
        for stage, run in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(run(spark, docs, base))
            left[stage] = docs.count()
            assert stage == "packing" or docs.columns == columns
        assert corpus_pipeline.run(spark, base).count() == left["packing"]
        if not n:
            assert set(left.values()) == {0}
    # Copies and texts without words are one row each; the benchmark has passages of two texts.
    full = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    once = corpus_pipeline.near_duplicates(spark, full, "")
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in once.collect()) == [(1, "one t"), (7, ""), (8, "token"), (9, "w w w")]
    clean = corpus_pipeline.benchmarks(spark, full, f"{tmp_path}/full")
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["7", "7", "9", "None"]
    hidden = corpus_pipeline.secrets(spark, full, "")
    assert hidden.filter("doc_id = 8").first().text == "[ASSIGN] and more words to read" and hidden.count() == len(rows)
    assert corpus_pipeline.packing(spark, full, "").select("doc_id").distinct().count() == 5


def test_benchmarks_of_a_plan_with_a_shuffle(spark, tmp_path):
    """Rows keep their numbers whatever plan the documents are."""
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('x ', id, ' alpha beta gamma'), concat('y ', id)) AS text").repartition(7).orderBy("text").repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.benchmarks(spark, docs, str(tmp_path)).collect()) == [k for k in range(3000) if k % 3]


def test_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
