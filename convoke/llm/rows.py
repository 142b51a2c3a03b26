"""Arrow functions over whole rows, whatever their columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

from . import arrowtext as X


def map_rows(docs: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], **more: DataType) -> DataFrame:
    """The rows that fn gives for each batch of docs: its columns, in order, and then ``more``.

    Spark sees plain names only: a dot in a column's name can't be misread.
    """
    own = [f"c{k}" for k in range(len(docs.columns) + len(more))]
    names, inner = docs.columns, docs.toDF(*own[: len(docs.columns)])
    kinds = [f.dataType for f in docs.schema.fields] + list(more.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch.rename_columns(names)):
                yield out.rename_columns(own)
            X.trimmed()

    return inner.mapInArrow(run, StructType([StructField(n, t) for n, t in zip(own, kinds, strict=True)])).toDF(*names, *more)
