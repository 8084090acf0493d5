"""Importance resampling towards a target distribution over hashed word n-grams.

A ring of running checksums scans each text once: it keeps the zlib states of the last n starts, extends each by a blank and
the next word, and emits every state's bucket, so that a run of words is never put together as a string. What a document
emits is written as (bucket, count) lists; the corpus' and the target's counts, a document's weight and the ranking all read
those, and no text is read twice.

Counts are summed within each task before they meet, so a shuffle carries at most `buckets` rows a task. The driver sees the two
count vectors alone, whose length is the parameter. The ranking is a range sort whose partitions are written and then numbered:
a score that many documents share is dealt out by id and row number.

Defined cases: null and empty texts have no feature, weight 0, and take no part in the draw, as other texts of under `least`
words; a null id is hashed as the empty string and comes last among equal scores; repeated rows are scored alike, and either may be
drawn; a text or a word of any length is scanned in blocks; an empty table gives an empty result; an empty target gives
every bucket the gain of no count. resample() keeps the columns of docs, whatever their names.
"""

from __future__ import annotations

import array
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cloakframe.llm import common

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 10, 20, 2024
RESULT = ("n_features", "weight", "score", "rank")
#: Columns of this module's own tables.
ROW, WORDS, COUNT, AT, TIMES = "__imp_row", "__imp_words", "__imp_features", "__imp_buckets", "__imp_times"
WEIGHT, SCORE, RANK, PART = "__imp_weight", "__imp_score", "__imp_rank", "__imp_part"

#: Digits, letters and all bytes beyond ASCII stay, capitals of ASCII become small, and the rest parts words.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes that are cut into words at once, and features that are held before they are counted.
BLOCK, HELD = 1 << 20, 1 << 18


def words(raw: bytes, kept: bytes = KEPT, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Words of a text, block by block; one that reaches over a border is put together."""
    open_: list[bytes] = []
    for at in range(0, len(raw), block):
        parts = raw[at : at + block].translate(kept).split(b" ")
        if len(parts) > 1:
            parts[0] = b"".join([*open_, parts[0]])
            open_ = []
            last = parts.pop()
            yield [p for p in parts if p]
        else:
            last = parts[0]
        if last:
            open_.append(last)
    if open_:
        yield [b"".join(open_)]


class Ring:
    """Running checksums of the last n starts."""

    def __init__(self, n: int) -> None:
        self.n, self.states = n, []

    def feed(self, run: Iterable[bytes], out: array.array) -> None:
        """Append the checksum of every run of 1 to n words that ends with a word of `run`."""
        states, n, crc = self.states, self.n, zlib.crc32
        for word in run:
            if states:
                spaced = b" " + word
                states = [crc(spaced, s) for s in states]
            states.append(crc(word))
            out.extend(states)
            if len(states) == n:
                del states[0]
        self.states = states


def emitted(raw: bytes, n: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, features, buckets, times) of a text, in the order of buckets."""
    ring, held, dense, n_words, n_features = Ring(n), array.array("I"), None, 0, 0
    for run in words(raw):
        n_words += len(run)
        ring.feed(run, held)
        if len(held) >= HELD:
            dense = np.bincount(np.frombuffer(held, np.uint32) % buckets, minlength=buckets) + (0 if dense is None else dense)
            n_features += len(held)
            held = array.array("I")
    n_features += len(held)
    rest = np.frombuffer(held, np.uint32) % np.uint32(buckets) if held else np.zeros(0, np.uint32)
    if dense is None:
        at, times = np.unique(rest, return_counts=True)
    else:
        dense = dense + np.bincount(rest, minlength=buckets)
        at = np.flatnonzero(dense)
        times = dense[at]
    return n_words, n_features, at.astype(np.int32), times.astype(np.int32)


def scanned(docs: DataFrame, n: int = 1, buckets: int = BUCKETS, text: str = "text", keep: bool = False) -> DataFrame:
    """docs with ROW, WORDS, COUNT, AT and TIMES, written; the text itself only with `keep`."""
    numbered = docs.select("*", F.monotonically_increasing_id().alias(ROW))
    own = [f for f in numbered.schema if keep or f.name != text]
    lists = ArrayType(IntegerType())
    schema = StructType([*own, StructField(WORDS, LongType()), StructField(COUNT, LongType()), StructField(AT, lists), StructField(TIMES, lists)])
    stay = [i for i, f in enumerate(numbered.schema) if keep or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(batch.schema.get_field_index(text)))
            made = [emitted(data[a:b].tobytes(), n, buckets) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(m[2]) for m in made])]).astype(np.int32))
            flat = lambda k: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int32), pa.int32()))
            new = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), flat(2), flat(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *new], [f.name for f in schema])

    return common.written(numbered.mapInArrow(run, schema), "features")


def totals(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is in a table of scanned(): a vector of `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = features.select(AT, TIMES).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) of each bucket, p the target's share and q the corpus', both with one more count a bucket."""
    all_s, all_t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: float((t + 1) * (all_s + k)) / float((s + 1) * (all_t + k))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, of the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(features: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(ROW, doc_id, WORDS, COUNT, WEIGHT, SCORE) of a table of scanned()."""
    slim = features.select(ROW, WORDS, COUNT, AT, TIMES, "doc_id")
    schema = StructType([slim.schema[ROW], slim.schema["doc_id"], slim.schema[WORDS], slim.schema[COUNT], StructField(WEIGHT, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
            ends = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gain[at] * times)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(1), batch.column(2), pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())], [f.name for f in schema])

    return slim.mapInArrow(run, schema).withColumn(SCORE, F.col(WEIGHT) + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """rows of weighed() with RANK: 1, 2, ... of the highest `percent` of the documents with at least `least` words; else null."""
    spark = rows.sparkSession
    rows = common.written(rows, "weights")
    fit = rows.where(F.col(WORDS) >= least)
    drawn = percent * fit.count() // 100
    order = [F.col(SCORE).desc(), F.col("doc_id").asc_nulls_last(), F.col(ROW)]
    # Written with its partition's number: what counts the partitions and what numbers their rows see the same borders.
    ranged = common.written(fit.repartitionByRange(common.partitions(spark), *order).withColumn(PART, F.spark_partition_id()), "ranged")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy(PART).agg(F.count("*").alias("n")).select(PART, ahead.alias("__imp_ahead"))  # a row for each partition
    placed = ranged.join(F.broadcast(sizes), PART)
    inside = placed.where(F.col("__imp_ahead") < drawn)
    rank = F.col("__imp_ahead") + F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    inside = inside.withColumn(RANK, rank.cast("long")).withColumn(RANK, F.when(F.col(RANK) <= drawn, F.col(RANK)))
    none = F.lit(None).cast("long").alias(RANK)
    others = placed.where(F.col("__imp_ahead") >= drawn).select(*rows.columns, none).unionByName(rows.where(F.col(WORDS) < least).select(*rows.columns, none))
    return inside.select(*rows.columns, RANK).unionByName(others)


def _drawn(docs: DataFrame, target: DataFrame, n: int, buckets: int, percent: int, least: int, seed: int, text: str, keep: bool) -> tuple[DataFrame, DataFrame]:
    features = scanned(docs, n, buckets, text, keep)
    wanted = scanned(target.select(F.col(text).alias("text")), n, buckets)
    gain = gains(totals(features, buckets), totals(wanted, buckets))
    common.discard(wanted)
    return features, ranked(weighed(features, gain, seed), percent, least)


def scores(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, text: str = "text") -> DataFrame:
    """(doc_id, RESULT) of every row of docs."""
    _, rows = _drawn(docs.select("doc_id", text), target, n, buckets, percent, least, seed, text, False)
    return rows.select("doc_id", *(F.col(c).alias(name) for c, name in zip((COUNT, WEIGHT, SCORE, RANK), RESULT, strict=True)))


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, text: str = "text") -> DataFrame:
    """The rows of docs that are drawn, with docs' own columns."""
    features, rows = _drawn(docs, target, n, buckets, percent, least, seed, text, True)
    picked = rows.where(F.col(RANK).isNotNull()).select(F.col(ROW).alias("__imp_picked"))
    return features.join(picked, F.col(ROW) == F.col("__imp_picked"), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The checksum bit by bit: each byte, then seven zeros, so that every element is one shift.
_SHIFTED = "CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END"
_BITS = "flatten(list_transform(range(1, strlen(w) + 1), lambda i: [('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BITS}), lambda c, x: {_SHIFTED}), 4294967295)"


def _runs(table: str) -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all({_SMALL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"


#: DuckDB SQL for scores() with runs of one word, over tables documents and benchmark.
ORACLE = f"""
WITH own AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM ({_runs("documents")}) GROUP BY ALL),
wanted AS MATERIALIZED (SELECT w, count(*) AS n FROM ({_runs("(SELECT item_id AS doc_id, text FROM benchmark)")}) GROUP BY ALL),
crc AS MATERIALIZED (SELECT w, ({_CRC} % {BUCKETS})::BIGINT AS b FROM (SELECT w FROM own UNION SELECT w FROM wanted)),
s AS (SELECT b, sum(n) AS s FROM own JOIN crc USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM wanted JOIN crc USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM own JOIN crc USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN sums USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
