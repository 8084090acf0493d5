"""Media columns: payloads kept as FLAC, read back with every checksum verified.

store() makes the media column; read_back() decodes it, writes its samples as a table of blocks with the offset of their
first sample, and computes features; pcm_blocks() are such blocks alone; seek() reads a range of samples from
blocks, samples_at() from a stream's seek points.

Defined cases: null and empty texts are one unit of padding; equal texts, and so repeated rows, give equal media; a text
of any length is one stream, coded some frames at a time; an empty table gives an empty one; a null or damaged stream
is a row with its error and without values, and the others go on; a damaged one may be read in parts whose frames
are whole; seek() leaves out documents without a sample in the range, and joins the blocks of one id; columns that are not
asked for are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import common, flac

UNIT, PAD = 576, b"\xff"
TAIL = 32


def payload(text: bytes) -> bytes:
    """The bytes with PAD appended up to a positive multiple of UNIT."""
    return text + PAD * (-len(text) % UNIT if text else UNIT)


def _kind(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.blocks(batch):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                media = flac.encode([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(texts)), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, n_bytes long, media binary")


def groups(batch: pa.RecordBatch, column: int, limit: int = common.BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a binary column of about `limit` bytes: (first row, values)."""
    start, held, size = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        held.append(value.as_py())
        size += len(held[-1] or b"")
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def feature(samples: np.ndarray) -> str:
    """Energy, peak and sign changes of signed samples, and the share of each quarter of the range."""
    x = samples.astype(np.int64)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    shares = np.bincount((x + 128) >> 6, minlength=4)
    return f"energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={changes};quarters={','.join(map(str, shares))}"


def decoded(streams: list[bytes | None]) -> list[tuple[bytes | None, str | None]]:
    """(payload, error) of each stream. Streams are decoded together; where one is damaged, one by one."""
    try:
        return [(p, None) for p in flac.decode(streams)]
    except (flac.FlacError, IndexError, TypeError, ValueError) as e:
        if len(streams) == 1:
            return [(None, "no stream" if streams[0] is None else f"damaged stream: {e}")]
        return [decoded([s])[0] for s in streams]


BLOCK = 64 * UNIT


def cut(payload_: bytes, block: int = BLOCK) -> list[tuple[int, bytes]]:
    """(offset of the first sample, signed samples) of a payload's blocks."""
    signed = (np.frombuffer(payload_, np.uint8) ^ 0x80).tobytes()
    return [(at, signed[at : at + block]) for at in range(0, len(signed), block)]


READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks long, last_offset long, error string"
_SUMMARY = "payload_bytes long, payload_sha256 string, media_bytes long, media_sha256 string, feature string, pcm_blocks long, error string"
_TYPES = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def pcm_rows(media: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, sample_offset, pcm, last, _SUMMARY) from the media column alone: a row for each block of samples; that of a
    stream's last block carries what is said of the whole stream. A stream that can't be read is one row, without samples."""
    names = ["doc_id", "n_bytes", "sample_offset", "pcm", "last", *(c.split()[0] for c in _SUMMARY.split(", "))]

    def one(stream: bytes | None, payload_: bytes | None, error: str | None) -> list[tuple]:
        if payload_ is None:
            return [(None, None, True, None, None, None if stream is None else len(stream), None, None, None, error)]
        blocks = cut(payload_, block)
        samples = (np.frombuffer(payload_, np.uint8) ^ 0x80).view(np.int8)
        whole = (len(payload_), hashlib.sha256(payload_).hexdigest(), len(stream), hashlib.sha256(stream).hexdigest(), feature(samples), len(blocks), None)
        return [(at, pcm, i == len(blocks) - 1, *(whole if i == len(blocks) - 1 else (None,) * len(whole))) for i, (at, pcm) in enumerate(blocks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, streams in groups(batch, 2):
                made = [one(s, *d) for s, d in zip(streams, decoded(streams), strict=True)]
                owner = pa.array([start + i for i, rows in enumerate(made) for _ in rows], pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*(row for rows in made for row in rows), strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {_kind(media)}, n_bytes long, sample_offset long, pcm binary, last boolean, {_SUMMARY}")


def pcm_blocks(media: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, sample_offset, pcm binary, error): signed 8-bit samples, each block with its offset."""
    return pcm_rows(media, block).select("doc_id", "sample_offset", "pcm", "error")


def _crc32(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([None if p is None else zlib.crc32((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()) for p in part], dtype="Int64")


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, READ) from the media column. The blocks of samples are written as a table, which the result's `blocks` is;
    the payload's tail is read from the block that holds it."""
    blocks = common.written(pcm_rows(media), "pcm")
    tail = F.substring("pcm", -TAIL, TAIL)
    last = blocks.where("last").withColumn("tail_crc32", F.pandas_udf(_crc32, "long")(tail)).withColumnRenamed("sample_offset", "last_offset")
    out = last.select("doc_id", *(c.split()[0] for c in READ.split(", ")))
    out.blocks = blocks
    return out


def seek(blocks: DataFrame, start: int, count: int) -> DataFrame:
    """(doc_id, part binary): payload bytes from `start` on, of a table of blocks; only blocks that hold some of them are read."""
    size = F.length("pcm")
    some = blocks.where((F.col("sample_offset") < start + count) & (F.col("sample_offset") + size > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(np.frombuffer(p.as_py(), np.uint8)[max(start - at.as_py(), 0) : start + count - at.as_py()] ^ 0x80).tobytes() for at, p in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["doc_id", "sample_offset", "part"])

    cuts = some.select("doc_id", "sample_offset", "pcm").mapInArrow(run, f"doc_id {_kind(blocks)}, sample_offset long, part binary")
    ordered = F.array_sort(F.collect_list(F.struct("sample_offset", "part")))
    return cuts.groupBy("doc_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["part"])), "")).alias("part"))


def samples_at(media: DataFrame, start: int, count: int) -> DataFrame:
    """(doc_id, part binary, error): payload bytes from `start` on, decoded from the nearest seek point; of a null or damaged
    stream its error in place of the bytes."""

    def one(stream: bytes | None) -> tuple[bytes | None, str | None]:
        if stream is None:
            return None, "no stream"
        try:
            return flac.read_samples(stream, start, count), None
        except (flac.FlacError, IndexError, TypeError, ValueError) as e:
            return None, f"damaged stream: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                parts, errors = zip(*(one(v.as_py()) for v in batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "part", "error"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {_kind(media)}, part binary, error string")
