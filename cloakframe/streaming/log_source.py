"""Log records as a stream: a source whose offset is the sequence number, and the newest records as its state.

Records lie in a folder as files named by the numbers they hold, `first-last.parquet`, so that a reader at some number opens only what is newer.
The source is Python, as Spark's file source counts files and not records; its batches are Arrow, and a batch's files are its tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cloakframe.operators import logs
from cloakframe.schema import LOG
from cloakframe.sources import scratch
from cloakframe.sources.model import filesystem

_NAME = re.compile(r"(\d+)-(\d+)-[0-9a-f]+\.parquet$")


def append(records: DataFrame, folder: str) -> None:
    """Add records (seq, ts, level, logger, message) to a folder, one file a task. A file is renamed when it is whole; a task
    that is tried again first looks whether an attempt before it has left its file."""
    run_id = uuid.uuid4().hex[:12]
    columns = [c.split()[0] for c in LOG.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        store.create_dir(at, recursive=True)
        own = f"{run_id}{TaskContext.get().partitionId():08x}"
        whole = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(f"-{own}.parquet")]
        first = last = None
        writer = None
        for batch in batches:
            if not len(batch) or whole:
                continue
            writer = writer or pq.ParquetWriter(f"{at}/_{own}", batch.schema, filesystem=store)
            writer.write_batch(batch)
            low, high = (x.as_py() for x in pc.min_max(batch.column(0)).values())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        if writer:
            writer.close()
            store.move(f"{at}/_{own}", f"{at}/{first}-{last}-{own}.parquet")
        yield pa.RecordBatch.from_arrays([pa.array([int(writer is not None)], pa.int32())], ["n"])

    records.select(*columns).mapInArrow(write, "n int").agg(F.sum("n")).collect()  # one number


class _File(InputPartition):
    def __init__(self, path: str, after: int, upto: int) -> None:
        super().__init__(path)
        self.path, self.after, self.upto = path, after, upto


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, since: int) -> None:
        self.folder, self.since = folder, since

    def _files(self) -> list[tuple[int, int, str]]:
        store, at = filesystem(self.folder)
        found = ((_NAME.search(f.path), f.path) for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)))
        return [(int(m[1]), int(m[2]), path) for m, path in found if m]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"seq": max([self.since, *(last for _, last, _ in self._files())])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(path, start["seq"], end["seq"]) for first, last, path in self._files() if last > start["seq"] and first <= end["seq"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.folder)
        for batch in pq.ParquetFile(partition.path, filesystem=store).iter_batches():
            seq = batch.column(0)
            yield batch.filter(pc.and_(pc.greater(seq, partition.after), pc.less_equal(seq, partition.upto)))


class LogSource(DataSource):
    """spark.readStream.format("log_records").option("path", folder).option("since", seq)"""

    @classmethod
    def name(cls) -> str:
        return "log_records"

    def schema(self) -> str:
        return LOG

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802, ARG002
        return _Reader(self.options["path"], int(self.options.get("since", 0)))


def read(spark: SparkSession, folder: str, since: int = 0) -> DataFrame:
    """A stream of the records of a folder that are newer than `since`. A folder must be filled in order: a number that
    comes after a greater one was read is never seen."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("log_records").option("path", folder).option("since", since).load()


def keep_newest(stream: DataFrame, folder: str, checkpoint: str, capacity: int = logs.CAPACITY) -> DataFrame:
    """Read a stream to its end and hold its newest records; returns what is held. A checkpoint goes on from where it ended.

    Each batch is cut to its own newest first; what is held is a table of `capacity` rows for each batch number, and a batch that is
    run again replaces its own."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        own = logs.newest(batch, capacity)
        before = held(spark, folder, number - 1)
        both = own if before is None else own.unionByName(before)
        logs.newest(both, capacity).write.mode("overwrite").parquet(f"{folder}/{number:09d}")
        if number > 1:
            scratch.delete(spark, f"{folder}/{number - 2:09d}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    out = held(spark, folder)
    return spark.createDataFrame([], LOG) if out is None else out


def held(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame | None:
    """The table of the last batch, or of the last up to a number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    numbers = [int(s.getPath().getName()) for s in system.listStatus(path) if s.getPath().getName().isdigit()]  # two at most
    last = max((n for n in numbers if upto is None or n <= upto), default=None)
    return None if last is None else spark.read.schema(LOG).parquet(f"{folder}/{last:09d}")
