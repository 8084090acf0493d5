"""Shared helpers: table access, scratch space, Arrow text buffers, rolling hashes, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources.scratch import discard, settled, shared_dir, written

__all__ = ["discard", "settled", "shared_dir", "written"]

#: Bytes of text that one numpy pass works on; arrays of eight bytes a character stay near 32 MB.
BLOCK_BYTES = 2 << 20
#: Rows that Spark hands to Python at once.
ARROW_ROWS = 256

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Also lowers the rows of an Arrow batch: Spark bounds a batch's bytes by itself, but at 64 MB, of
    which a task has several."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Partitions of slim tables, of a few dozen bytes a row, that go into one file.
SLIM = 8


def slim_files(spark: SparkSession) -> int:
    return max(1, partitions(spark) // SLIM)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the evaluation fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- Arrow text buffers -------------------------------------------------------------------


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of at most `limit` text bytes (a longer text stands alone).

    Yields (rows, bytes, offsets); row i of the range has bytes[offsets[i]:offsets[i + 1]]."""
    column = batch.column(batch.schema.get_field_index(text))
    data, offsets = utf8(column)
    start, n = 0, len(column)
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        end = min(end, n)
        yield slice(start, end), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of a block, and each text's range of words."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[:n] = ~SPACE[data]
    first = np.ones(n + 1, bool)
    first[1:] = ~word[:-1]
    first[offsets] = True
    starts = np.flatnonzero(word & first)
    last = np.ones(n + 1, bool)
    last[:-1] = ~word[1:]
    ends_at = offsets[1:] - 1
    last[ends_at[ends_at >= 0]] = True
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --- rolling hashes -----------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i < n."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        have = _POWERS[0] = (_geometric(BASE, size), _geometric(pow(BASE, -1, 1 << 64), size))
    return have[0][:n], have[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE ** i; see span_hash."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span that depends on nothing else."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's shingles of `width` words (fewer words: the whole sequence; none:
    no shingle), and each text's range among them."""
    starts, ends, at = word_spans(data, offsets)
    words = span_hash(prefix_hash(data), starts, ends)
    factor = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        rolled = rolled * factor + words[j : j + len(rolled)]
    per = np.diff(at)
    count = np.where(per >= width, per - width + 1, (per > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(out_at[-1], np.uint64)
    full = per >= width
    index = np.repeat(at[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    long = np.repeat(full, count)
    out[long] = rolled[index[long]]
    short = np.flatnonzero((per > 0) & ~full)
    value = per[short].astype(np.uint64)
    for j in range(width - 1):
        more = per[short] > j
        value[more] = value[more] * factor + words[at[short[more]] + j]
    out[out_at[short]] = value
    return mix(out), out_at


# --- components ---------------------------------------------------------------------------


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        if np.array_equal(before, root):
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


#: A key with more rows than this, and than a quarter of a task's share, is dealt over several tasks.
SHARE = 256
SALT = "__salt"


def dealt(many: DataFrame, one: DataFrame, key: str, spread: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """many and `one` (a row for each key, with n: the rows that many has of it) with a column SALT.

    Keys of many rows are dealt over several salts by a hash of `spread`, and their row in `one` is repeated as
    often. With `total` rows in many, at most 4 times the number of partitions have that many: the list of them
    is small by construction, and broadcast."""
    limit = max(SHARE, total // (4 * partitions(many.sparkSession)))
    hot = F.broadcast(one.where(F.col("n") > limit).select(F.col(key).alias("__k"), F.ceil(F.col("n") / limit).cast("int").alias("__of")))
    here = lambda df: df.join(hot, df[key] == F.col("__k"), "left").drop("__k")
    left = here(many).withColumn(SALT, F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__of")).cast("int"), F.lit(0))).drop("__of")
    right = here(one.drop("n")).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__of"), F.lit(1)) - 1))).drop("__of")
    return left, right


def joined(many: DataFrame, one: DataFrame, key: str, spread: list[str], total: int, how: str = "inner") -> DataFrame:
    """many joined with `one` on key; both as in dealt()."""
    left, right = dealt(many, one, key, spread, total)
    return left.join(right, [key, SALT], how).drop(SALT)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node it reaches.

    Alternates large and small stars: every node links its larger neighbours, then its smaller
    ones, to the smallest node it sees. Each round is written to the shared folder, and the one before it
    deleted. All work is joins and partial aggregates; the neighbours of a node with many are dealt over tasks."""
    files = slim_files(edges.sparkSession)
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(files), "edges")
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = state()
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined(both, low, "a", ["b"], 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct().coalesce(files), "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined(large, low, "a", ["b"], seen[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before, edges = edges, written(small.where("a <> b").distinct().coalesce(files), "edges")
        discard(before)
        discard(large)
        now = state()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
