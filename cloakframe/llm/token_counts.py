"""Token counts by separator scan over flat, unindexed token files.

A token file is a sequence of little-endian ids in which an end-of-document id closes each document;
nothing says where documents begin. Files are read by byte ranges, each with one vectorised
search for the id. Documents that cross ranges are stitched by a prefix scan over them: the
running number of tokens places every separator, the running number of separators numbers the documents,
and the running maximum of separator places is where the open document began. The scan has two levels
(groups of ranges, ranges of a group), so one long file isn't one task.

Files lie where Spark and the workers both reach them: on a path that all machines share, or in a store that
pyarrow.fs opens (hdfs, s3, gs). A task writes a file of its own under a name that no other attempt has, and only files
that the table of documents names are read, so lost executors leave nothing wrong behind.

Defined cases: an empty document has 0 tokens; tokens after the last separator are one open document
(closed = false); an empty file has no document; a file that ends inside an id is an error; null and empty texts are
empty documents; an end-of-text mark inside a text is ordinary text here, as it would cut its document; rows that repeat
an id, or id and text, are counted each; a very long text is written in pieces and read in many ranges; an empty table has
no file and gives an empty table; columns that are not asked for are dropped.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.llm import bpe, common

#: Ids of a range, and ids that a writer holds.
BLOCK_TOKENS = 1 << 18
GROUP = 1024


@lru_cache(maxsize=1)
def _codec(path: str) -> bpe.Codec:
    class Ordinary(bpe.Codec):
        def plain(self, text: bytes) -> list[int]:
            return self.encoding.encode_ordinary(text.decode())

    return Ordinary(path)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a file that Spark names by `uri`."""
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def token_files(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write the texts' ids to flat files of 16-bit ids in `folder`, one for each task. Rows (file, ordinal, doc_id):
    which document was the ordinal-th to be appended to the file of that name. Written."""
    vocabulary = path or bpe.default_vocabulary()
    names = ["file", "ordinal", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, task = _codec(vocabulary), TaskContext.get()
        end = np.array([use.end], "<u2")
        name = f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}.ids"
        store, at = opened(f"{folder}/{name}")
        out = None
        place = 0
        try:
            for batch in batches:
                if len(batch) and out is None:
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(at)
                for _, data, offsets in common.blocks(batch):
                    raw = data.tobytes()
                    held: list[np.ndarray] = []
                    for i, cuts in enumerate(bpe.cut_points(data, offsets)):
                        for entry in use.entries(raw[offsets[i] : offsets[i + 1]], cuts):
                            held.append(entry[0])
                        held.append(end)
                    out.write(np.concatenate(held).astype("<u2").tobytes())
                ordinals = pa.array(np.arange(place, place + len(batch)))
                place += len(batch)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch), pa.string()), ordinals, batch.column(0)], names)
        finally:
            if out is not None:
                out.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.written(docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal long, doc_id {kind}"), "documents")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files below `path`; reads no content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def scan(found_files: DataFrame, end: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, token_start, n_tokens, closed) of every document in files (file, length) of ids of `width` bytes."""
    size = width * block_tokens
    ranges = found_files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("place"))
    ranges = ranges.repartition(common.partitions(found_files.sparkSession), "file", "place")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for name, length, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = opened(name)
                with store.open_input_file(at) as source:
                    raw = source.read_at(min(size, length - place * size), place * size)
                if len(raw) % width:
                    raise ValueError(f"{name} ends inside an id")
                ids = np.frombuffer(raw, f"<u{width}")
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == end).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["file", "place", "n", "ends"])

    found = ranges.select("file", "length", "place").mapInArrow(search, "file string, place long, n long, ends array<int>")
    # The search reads every block; the scan then goes over its result several times.
    found = common.written(found.withColumn("group", F.floor(F.col("place") / GROUP)), "ends")
    # Level one: blocks of a group. `last` is the place of the last separator before the block.
    inner = Window.partitionBy("file", "group").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("at", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(inner), F.lit(0)))
    own_last = F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))
    rows = rows.withColumn("own_last", own_last).withColumn("last", F.max("own_last").over(inner))
    # Level two: the groups of a file, one row each.
    sums = found.groupBy("file", "group").agg(F.sum("n").alias("g_n"), F.sum(F.size("ends")).alias("g_docs"))
    tops = rows.groupBy("file", "group").agg(F.max("own_last").alias("g_last"))
    groups = sums.join(tops, ["file", "group"])
    outer = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("g_at", F.coalesce(F.sum("g_n").over(outer), F.lit(0))).withColumn("g_before", F.coalesce(F.sum("g_docs").over(outer), F.lit(0)))
    groups = groups.withColumn("g_open", F.coalesce(F.max(F.col("g_at") + F.col("g_last")).over(outer), F.lit(-1)))
    last_group = groups.groupBy("file").agg(F.sum("g_n").alias("f_n"), F.sum("g_docs").alias("f_docs"), F.max(F.col("g_at") + F.col("g_last")).alias("f_last"))
    rows = rows.join(groups.select("file", "group", "g_at", "g_before", "g_open"), ["file", "group"]).where(F.size("ends") > 0)
    rows = rows.select("file", (F.col("g_at") + F.col("at")).alias("at"), (F.col("g_before") + F.col("docs")).alias("docs"), F.coalesce(F.col("g_at") + F.col("last"), F.col("g_open")).alias("open"), "ends")
    # Each separator with the one before it in the range.
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice("ends", 1, F.size("ends") - 1))
    docs = rows.select("file", "at", "docs", "open", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), before.alias("before"))).alias("i", "x"))
    start = F.coalesce(F.col("at") + F.col("x.before"), F.col("open")) + 1
    closed = docs.select("file", (F.col("docs") + F.col("i")).cast("long").alias("ordinal"), start.cast("long").alias("token_start"), (F.col("at") + F.col("x.end") - start).cast("long").alias("n_tokens"), F.lit(True).alias("closed"))
    tail = F.coalesce("f_last", F.lit(-1)) + 1
    open_ = last_group.where(F.col("f_n") > tail).select("file", F.col("f_docs").cast("long").alias("ordinal"), tail.cast("long").alias("token_start"), (F.col("f_n") - tail).cast("long").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_)


def count_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, file, ordinal, token_start, n_tokens) of every row, counted in the token files."""
    spark = docs.sparkSession
    folder = f"{common.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    ids = token_files(docs, folder, path)
    if not ids.limit(1).count():
        return ids.select("doc_id", "file", "ordinal", F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"))
    # Files of attempts that failed are in no row.
    name = F.element_at(F.split("file", "/"), -1)
    own = files(spark, folder).withColumn("name", name).join(ids.select(F.col("file").alias("name")).distinct(), "name", "left_semi")
    counts = scan(own.select("file", "length"), _end(path or bpe.default_vocabulary())).withColumn("file", name)
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "token_start", "n_tokens")


def _end(path: str) -> int:
    from pathlib import Path

    return sum(1 for line in Path(path).read_bytes().splitlines() if line)
