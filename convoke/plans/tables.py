"""Tables written between steps, in the folder that the whole cluster shares.

The folder is the one named by spark.checkpoint.dir; where the session names
none, a temporary one is made and set if Spark runs on this machine alone
(tests), and it is an error otherwise: executors elsewhere could not read it.  A
written table cuts lineage: later steps survive the loss of any executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A new folder name under the session's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="convoke-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/convoke-{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str | None = None) -> DataFrame:
    """The frame's rows, written once and read again."""
    spark = frame.sparkSession
    path = path or shared(spark)
    schema = frame.schema
    frame.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    at, fs = _at(spark, path)
    return fs.exists(at)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a written table."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder; none if there is no folder."""
    at, fs = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file, whole at once; False, and nothing changed, if there is one of that name.

    The file is written under another name and renamed.  A local rename would overwrite, so local files get a link.
    """
    at, fs = _at(spark, path)
    new, _ = _at(spark, f"{path.rpartition('/')[0]}/_new-{uuid.uuid4().hex}")
    stream = fs.create(new, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.getUri().getScheme() == "file":
        try:
            os.link(new.toUri().getPath(), at.toUri().getPath())
            done = True
        except FileExistsError:
            done = False
        fs.delete(new, False)
        return done
    done = not fs.exists(at) and fs.rename(new, at)
    if not done:
        fs.delete(new, False)
    return done


def columns(frame: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; the others, whatever their names, can't clash with ours."""
    return frame.select(*[frame[f"`{n}`"] for n in names])
