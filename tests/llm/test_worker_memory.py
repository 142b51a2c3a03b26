"""Workers give memory back after each batch, and after each pool that is packed."""

import pyarrow as pa

from convoke.llm import nearcopies, packing, rows
from convoke.llm import arrowtext as X


def _calls(spark, monkeypatch, made, batch) -> int:
    """Times that memory is given back while the function that ``made`` hands to mapInArrow reads two batches."""
    calls, given = [], []
    docs = spark.createDataFrame([], "doc_id long, text string")
    kind, plain = type(docs), type(docs).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, schema, *more: given.append(fn) or plain(self, fn, schema, *more))
    monkeypatch.setattr(X, "trimmed", lambda: calls.append(1))
    made(docs)
    out = list(given[0](iter([batch, batch])))
    assert sum(x.num_rows for x in out) == 2 * batch.num_rows
    return len(calls)


def _batch(*names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["a b c d e f", "g"])], list(names))


def test_whole_rows(spark, monkeypatch) -> None:
    assert _calls(spark, monkeypatch, lambda docs: rows.map_rows(docs, lambda x: iter([x])), _batch("c0", "c1")) == 2


def test_fingerprints(monkeypatch) -> None:
    calls = []
    monkeypatch.setattr(X, "trimmed", lambda: calls.append(1))
    assert len(list(nearcopies._printed(iter([_batch("doc_id", "text")] * 2)))) == 2
    assert len(calls) == 2


def test_packing(spark, monkeypatch) -> None:
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(packing, "TaskContext", Task)
    # One pool for each text, and the end of the task.
    assert _calls(spark, monkeypatch, lambda docs: packing.pack(docs, pool=1), _batch("doc_id", "text")) >= 5
