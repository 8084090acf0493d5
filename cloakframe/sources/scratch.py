"""Tables in the folder that the cluster shares: what is computed once and read several times."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only in local mode, where one machine has all files, a temporary
    one is set if there is none; executors elsewhere couldn't see each other's."""
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cloakframe-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


#: Tables that settled() calls of this thread have seen, the innermost last.
_local = threading.local()


def _inner() -> list[list[DataFrame]]:
    if not hasattr(_local, "inner"):
        _local.inner = []
    return _local.inner


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _inner():
        _inner()[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    delete(df.sparkSession, df._written_to)  # twice does no harm


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """written(make()), after which the tables that make() wrote on its way are deleted."""
    _inner().append([])
    try:
        out = written(make(), label)
    finally:
        own = _inner().pop()
    for table in own:
        if table is not out:
            discard(table)
    if _inner():
        _inner()[-1].append(out)
    return out
