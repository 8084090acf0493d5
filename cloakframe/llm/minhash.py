"""Document fingerprints: MinHash over word shingles.

Every text's shingles of five words go through PERMUTATIONS universal hash functions (odd multiplier
and offset modulo 2 ** 64, high bits kept) in numpy; the least value of each is the signature, of which
a fingerprint keeps one byte a permutation. Equal bytes, corrected for chance, estimate the Jaccard
likeness. near_duplicates() joins bands of the signature in Spark and verifies the Jaccard likeness of
the shingle sets themselves; texts of likeness 0.8 share no band with a chance of 5 in 10 ** 8.

Defined cases: null and empty texts have no shingle, the fingerprint of all ff, and likeness 1 to each
other; with fewer than five words the whole sequence is one shingle; ids are integers; rows without an id come last in
the order of ids; rows with equal ids follow each other by a hash of their text; a single row is
its own next document; an empty table gives an empty one; a text of any length is one row, hashed in pieces; columns
that are not asked for are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import common

WIDTH, PERMUTATIONS = 5, 128
BANDS = 32
THRESHOLD = 0.8
#: Undecided rows of a bucket that one task compares pair by pair.
HOT = 2048
#: Counters of shingles that the driver holds, whatever the input.
SLOTS = 1 << 18
#: Bits of a text's bitmap.
BITS = 1024
#: Rows of buckets that are searched at once, and pairs of them that one numpy pass compares.
GATHER, PAIRS = 8192, 1 << 16

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def least_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each permutation over each text's shingles, and which texts have none."""
    hashes, at = common.word_shingles(data, offsets, WIDTH)
    n = len(offsets) - 1
    least = np.full((n, PERMUTATIONS), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.flatnonzero(np.diff(at))
    # Pieces that stay in the processor's cache; a text's pieces are joined by their minimum.
    step = 1 << 14
    for start in range(0, len(hashes), step):
        part = hashes[start : start + step]
        own = full[(at[full] < start + len(part)) & (at[full + 1] > start)]
        cuts = np.maximum(at[own] - start, 0)
        for p in range(PERMUTATIONS):
            low = np.minimum.reduceat(part * FACTORS[p] + OFFSETS[p], cuts)
            least[own, p] = np.minimum(least[own, p], low)
    return least, np.diff(at) == 0


def shortened(least: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """One byte a permutation: the high bits by a hash, as least values are small."""
    out = (common.mix(least >> np.uint64(24)) >> np.uint64(56)).astype(np.uint8)
    out[empty] = 255
    return out


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint bytes of a block's texts: one row a text, one byte a permutation."""
    return shortened(*least_values(data, offsets))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows of fingerprints: chance agreement is 1 in 256."""
    same = (a == b).mean(axis=1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def compressed(texts: pa.Array) -> pa.Array:
    """Texts packed one by one for the way; null counts as empty."""
    pack = zstandard.ZstdCompressor(level=3)
    data, at = common.utf8(texts)
    raw = data.tobytes()
    return pa.array([pack.compress(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def expanded(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


# --- each text against its edited form and the next text --------------------------------------

LEAST = -(1 << 63)


def sort_keys(k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys of bytes whose order is that of the pairs (k, h) of signed numbers."""
    pairs = np.stack([k, h], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    raw = np.ones((len(pairs), 17), np.uint8)  # a last byte that isn't zero, as trailing zeros don't count
    raw[:, :16] = pairs.astype(">u8").view(np.uint8).reshape(-1, 16)
    return raw.view("S17").ravel()


def borders(keys: DataFrame) -> np.ndarray:
    """Where parts begin in the order of (k, h): at quantiles of k, and inside every k of many rows at equal ranges of
    its hashes. Their number is a few times that of the partitions."""
    n = common.partitions(keys.sparkSession)
    total, parts = keys.count(), 4 * n
    limit = max(common.SHARE, total // parts)
    at = [(int(x), LEAST) for x in keys.approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts)]
    for k, rows in keys.groupBy("k").count().where(F.col("count") > limit).collect():
        pieces = -(-rows // limit)
        at += [(k, LEAST + (j << 64) // pieces) for j in range(pieces)] + [(min(k, (1 << 63) - 2) + 1, LEAST)]
    return np.unique(sort_keys(*(np.array([x[i] for x in at], np.int64) for i in (0, 1))))


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (part, tail, doc_id, z, h): descending ids, equal ones by a hash of their text, cut into parts that lie
    sorted, each with the row that follows it as its tail. One shuffle of the texts, compressed; the borders are few."""
    n = common.partitions(docs.sparkSession)
    h = F.xxhash64(common.whole_text())
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k"), h.alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(borders(keys))

    @F.pandas_udf("int")
    def part_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, sort_keys(k.to_numpy(), h.to_numpy()), side="right").astype(np.int32))

    first = sorted((r["part"], r["x"]["k"], r["x"]["h"]) for r in keys.groupBy(part_of("k", "h").alias("part")).agg(F.max(F.struct("k", "h")).alias("x")).collect())
    # The greatest row of a part follows the part above it; the greatest of all follows the lowest part.
    above = {first[i][1:]: first[(i + 1) % len(first)][0] for i in range(len(first))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.set_column(1, "z", compressed(batch.column(1)))
            k, h = batch.column(0).cast(pa.int64()).fill_null(LEAST).to_numpy(), batch.column(2).to_numpy()
            part = np.searchsorted(shared.value, sort_keys(k, h), side="right").astype(np.int32)
            again = [i for i, x in enumerate(zip(k.tolist(), h.tolist(), strict=True)) if x in above]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(k), bool)), *batch.columns], names)
            if again:
                more = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([pa.array([above[int(k[i]), int(h[i])] for i in again], pa.int32()), pa.array(np.ones(len(again), bool)), *more.columns], names)

    names = ["part", "tail", "doc_id", "z", "h"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text", h.alias("h")).mapInArrow(deal, f"part int, tail boolean, doc_id {kind}, z binary, h long")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), F.col("h").desc())


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, RESULT): each text beside the text whose last half gives way to the next one's first."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Runs of rows within one part; each begins with the last row of the one before."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part, tail, doc_id, z in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                row = (part, tail, doc_id, expanded(z).decode())
                if held and row[0] != held[-1][0]:
                    yield held
                    held, size = [], 0
                if held and held[-1][1]:
                    continue  # one tail is enough
                held.append(row)
                size += len(row[3] or "")
                if size > common.BLOCK_BYTES // 2 and len(held) > 1:
                    yield held
                    held = held[-1:]
                    size = len(held[0][3] or "")
        if len(held):
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            texts = [r[3] or "" for r in rows]
            edited = [t[: len(t) - len(t) // 2] + following[: len(t) // 2] for t, following in zip(texts, texts[1:], strict=False)]
            if not edited:
                continue
            own, other = signatures(*block([t.encode() for t in texts])), signatures(*block([t.encode() for t in edited]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r in rows[:-1]], type_),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([bytes(x).hex() for x in own[:-1]]),
                    pa.array([bytes(x).hex() for x in other]),
                    pa.array(likeness(own[:-1], other)),
                    pa.array(likeness(own[:-1], own[1:])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    type_ = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.int64()
    return in_order(docs).select("part", "tail", "doc_id", "z").mapInArrow(run, f"doc_id {kind}, {RESULT}")


# --- near-duplicates -------------------------------------------------------------------------


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, bands array<long>) of every row; equal keys for equal texts.

    A band's key comes from whole least values, so that chance seldom makes strangers share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.blocks(batch):
                least, _ = least_values(data, offsets)
                own = [batch.column(c).slice(rows.start, len(least)) for c in (0, 2)]
                keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(least), axis=0)
                for j in range(PERMUTATIONS // BANDS):
                    keys = common.mix(keys * np.uint64(common.BASE) + least[:, j :: PERMUTATIONS // BANDS])
                bands = pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*own, bands], ["doc_id", "text_key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.md5(common.whole_text().cast("binary")).alias("text_key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key string, bands array<long>")


def packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tid, z): the compressed texts of `wanted` (text_key, tid), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), compressed(batch.column(1))], ["text_key", "z"])

    texts = docs.select(F.md5(common.whole_text().cast("binary")).alias("text_key"), "text").mapInArrow(run, "text_key string, z binary")
    return texts.groupBy("text_key").agg(F.first("z").alias("z")).join(wanted, "text_key").select("tid", "z")


def shingle_sets(packed_: pa.Array) -> Iterator[np.ndarray]:
    """The different shingles of each compressed text, sorted. Short texts go through numpy together."""

    def sets() -> Iterator[np.ndarray]:
        hashes, at = common.word_shingles(*block(held), WIDTH)
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(hashes[start:end].view(np.int64))

    held: list[bytes] = []
    size = 0
    for z in packed_:
        held.append(expanded(z.as_py()))
        size += len(held[-1])
        if size > common.BLOCK_BYTES // 8:
            yield from sets()
            held, size = [], 0
    if held:
        yield from sets()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b), a written table, that reach the threshold.

    The texts of all a of one b follow b's text, which is read once. A text that stands in many pairs is dealt over
    several tasks, on either side."""
    total = pairs.count()
    n = common.partitions(pairs.sparkSession)
    members, hubs = common.dealt(pairs, pairs.groupBy("b").agg(F.count("*").alias("n")), "b", ["a"], total)
    part = F.col(common.SALT).alias("part")
    asked = hubs.select("b", part, F.lit(0).alias("role"), F.col("b").alias("tid")).unionByName(members.select("b", part, F.lit(1).alias("role"), F.col("a").alias("tid")))
    asked = common.written(asked, "asked")
    own = texts.join(asked.groupBy("tid").agg(F.count("*").alias("n")), "tid")
    rows = common.joined(asked, own, "tid", ["b", "part"], asked.count())
    rows = rows.select("b", "part", "role", "tid", "z").repartition(n, "b", "part").sortWithinPartitions("b", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.int64)
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for b, role, tid, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), shingle_sets(batch.column(4)), strict=True):
                if role == 0:
                    hub = s
                elif (likeness_ := jaccard(s, hub)) >= threshold:
                    found.append((tid, b, likeness_))
            columns = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "jaccard"])

    return rows.mapInArrow(run, "a long, b long, jaccard double")


def every_two(ends: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b < ends[a], of rows whose bucket ends at ends[a]: about `limit` pairs at a time, in order, those of one a together."""
    later = ends - np.arange(len(ends)) - 1
    upto = np.concatenate([[0], np.cumsum(later)])
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + limit, side="right")) - 1)
        a = np.repeat(np.arange(start, stop), later[start:stop])
        yield a, a + 1 + np.arange(len(a)) - (upto[a] - upto[start])
        start = stop


def compatible(n: np.ndarray, at: np.ndarray, m: np.ndarray, by: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two texts of n and m shingles may reach the threshold if the first that they share, in the order of all
    texts, is number `at` of the one and `by` of the other: what may still be shared must be enough."""
    most = np.minimum(n - at, m - by)
    return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-6) & (most >= threshold / (1 + threshold) * (n + m) - 1e-6)


def bitmap(s: np.ndarray) -> bytes:
    """BITS bits, set where some shingle falls. A bit that differs between two texts is a shingle that one of them
    lacks, so the number of such bits never exceeds that of the shingles that they don't share."""
    bits = np.zeros(BITS, bool)
    bits[s % BITS] = True
    return np.packbits(bits).tobytes()


def bitmaps(texts: DataFrame) -> DataFrame:
    """(tid, bits) of texts (tid, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bitmap(s) for s in shingle_sets(batch.column(1))], pa.binary())], ["tid", "bits"])

    return texts.select("tid", "z").mapInArrow(run, "tid long, bits binary")


def near_pairs(some: pa.Table, threshold: float, best: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of two rows of one bucket in whole buckets (bucket, root, tid, side, size, place, bits) that lie together:
    rows of different groups that compatible() accepts and whose bitmaps don't differ too much to reach the
    threshold. In a bucket of two blocks only pairs across them count.

    best: of each row only the pair whose bitmaps differ least."""
    bucket, group, side = (some[c].to_numpy() for c in ("bucket", "root", "side"))
    size, place = (some[c].to_numpy().astype(np.float64) for c in ("size", "place"))
    bits = np.frombuffer(b"".join(some["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    two = np.repeat(np.minimum.reduceat(side, cuts[:-1]) != np.maximum.reduceat(side, cuts[:-1]), np.diff(cuts))
    least = np.full(len(bucket), BITS + 1)
    partner = np.zeros((2, len(bucket)), np.int64)
    for a, b in every_two(np.repeat(cuts[1:], np.diff(cuts)), PAIRS):
        kept = (group[a] != group[b]) & (~two[a] | (side[a] != side[b]))
        a, b = a[kept], b[kept]
        kept = compatible(size[a], place[a], size[b], place[b], threshold)
        a, b = a[kept], b[kept]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        kept = apart <= (1 - threshold) / (1 + threshold) * (size[a] + size[b]) + 1e-6
        a, b, apart = a[kept], b[kept], apart[kept]
        if best:
            row, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((apart[pair], row))
            row, pair = row[order], pair[order]
            new = np.append(True, row[1:] != row[:-1])[: len(row)]
            row, pair = row[new], pair[new]
            new = (apart[pair] < least[row]) | ((apart[pair] == least[row]) & (a[pair] == row))
            row, pair = row[new], pair[new]
            least[row], partner[0, row], partner[1, row] = apart[pair], a[pair], b[pair]
        else:
            yield a, b
    if best:
        yield tuple(np.unique(partner[:, least <= BITS], axis=1))


def bucket_pairs(rows: DataFrame, threshold: float, best: bool) -> DataFrame:
    """(a, b) by near_pairs() of rows (bucket, root, tid, side, size, place, bits), whose buckets hold at most two blocks.

    Many buckets go through numpy together, as most have few rows."""

    def pairs(some: pa.Table) -> Iterator[pa.RecordBatch]:
        tid = some["tid"].to_numpy()
        for a, b in near_pairs(some, threshold, best):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(tid[a]), pa.array(tid[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(x) for x in held) >= GATHER:
                some = pa.Table.from_batches(held)
                key = some["bucket"].to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if whole:
                    yield from pairs(some.slice(0, whole))
                    held = some.slice(whole).to_batches()
        if sum(len(x) for x in held):
            yield from pairs(pa.Table.from_batches(held))

    rows = rows.repartition(common.partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "tid")
    near = rows.mapInArrow(run, "a long, b long")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_blocks(rows: DataFrame, hot: int) -> DataFrame:
    """rows (bucket, n, tid, ...) with `side`: a bucket of n > hot rows becomes blocks of which any two meet
    in a bucket of their own."""
    parts = F.ceil(F.col("n") / hot).cast("int")
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("tid"), parts).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = F.xxhash64("bucket", F.least("side", "_other"), F.greatest("side", "_other"))
    return dealt.withColumn("bucket", F.when(F.col("n") > hot, pair).otherwise(F.col("bucket"))).drop("n", "_other")


def undecided(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, root, tid, ...), a written table, whose bucket holds more than one root, with its size as `members`."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l <> _h")
    return common.joined(rows, sizes.select(by, "n", F.col("n").alias("members")), by, ["tid"], rows.count())


def rare_shingles(texts: DataFrame, threshold: float) -> DataFrame:
    """(bucket, tid, size, place): of each text's shingles in one order for all texts, rare ones first, as many as
    two texts that reach the threshold can't differ in: such texts share one of these.

    Any order is right; a rough count by SLOTS hash slots makes it a good one and bounds what is broadcast."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                np.add.at(counts, s % SLOTS, 1)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])

    slots = texts.select("z").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for tid, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                n = len(s) - math.ceil(threshold * len(s) - 1e-9) + 1 if len(s) else 0
                first = s[np.lexsort((s, counts[s % SLOTS]))[:n]]
                columns = (first, np.full(n, tid, np.int64), np.full(n, len(s), np.int64), np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "tid", "size", "place"])

    return texts.select("tid", "z").mapInArrow(run, "bucket long, tid long, size long, place long")


def distinct_texts(signed_: DataFrame) -> DataFrame:
    """(tid, text_key, bands): one row for each text, numbered, written. Numbers, not keys, go through the joins."""
    once = signed_.groupBy("text_key").agg(F.first("bands").alias("bands"))
    return common.written(once.withColumn("tid", F.monotonically_increasing_id()), "texts")


def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (tid, ...) with the root that the links (a, b) give, written."""
    root = common.components(links.select("a", "b")).withColumnRenamed("node", "tid")
    return common.written(rows.join(root, "tid", "left").withColumn("root", F.coalesce("root", "tid")), "rooted")


def near_links(distinct: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(a, b, jaccard): verified links between different texts (their tid), enough to connect each class.

    First each band's members are checked against the least of them. Bands whose members then lie in one class are
    done. The members of the others meet on their rare shingles, which loses no pair: again against the least of each
    bucket, and then those that are still apart with each other, as far as sizes, places and bitmaps let them reach the
    threshold: each with the one most like it, and last all that are apart even then. Buckets that have become one class are left
    out of what follows. A bucket of more than `hot` such rows is dealt into blocks that meet two at a time."""
    banded = distinct.select("tid", F.explode("bands").alias("band"))
    hub = banded.groupBy("band").agg(F.min("tid").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = common.written(common.joined(banded, hub, "band", ["tid"], BANDS * distinct.count()), "shared")
    texts = common.written(packed(docs, shared.select("tid").distinct().join(distinct.select("tid", "text_key"), "tid")), "packed")
    pairs = common.written(shared.where("tid <> b").select(F.col("tid").alias("a"), "b").distinct(), "pairs")
    first = common.written(verified(pairs, texts, threshold), "first")
    crowd = undecided(rooted(shared.select("band", "tid"), first), "band").select("tid").distinct()
    rare = common.written(rare_shingles(texts.join(crowd, "tid", "left_semi"), threshold), "rare")
    rows = common.written(undecided(rooted(rare, first), "bucket"), "undecided")
    least = rows.groupBy("bucket").agg(F.min(F.struct("tid", "size", "place", "root")).alias("h"), F.count("*").alias("n"))
    star = common.joined(rows, least, "bucket", ["tid"], rows.count())
    n, m = F.col("size"), F.col("h.size")
    most = F.least(n - F.col("place"), m - F.col("h.place"))
    fits = (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6) & (most >= threshold / (1 + threshold) * (n + m) - 1e-6)
    pairs = common.written(star.where((F.col("root") != F.col("h.root")) & fits).select(F.col("tid").alias("a"), F.col("h.tid").alias("b")).distinct(), "pairs")
    links, bits = common.written(first.unionByName(verified(pairs, texts, threshold)), "second"), None
    for best in (True, False):
        rows = common.written(undecided(rooted(rows.select(*rare.columns), links), "bucket"), "apart")
        if bits is None:
            bits = common.written(bitmaps(texts.join(rows.select("tid").distinct(), "tid", "left_semi")), "bitmaps")
        near = common.written(bucket_pairs(in_blocks(rows.withColumnRenamed("members", "n").join(bits, "tid"), hot), threshold, best), "near")
        links = common.written(links.unionByName(verified(near, texts, threshold)).distinct(), "linked")
    return links


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(doc_id, n_links, class_id) of every row: the links found between its text and other texts, and the least
    id of the texts that links reach, itself included.

    Equal texts meet first and count as one; a class without any id has class null."""
    rows = common.written(signed(docs), "signed")
    distinct = distinct_texts(rows)
    links = common.settled("links", lambda: near_links(distinct, docs, threshold, hot).select("a", "b"))
    of = common.settled("classes", lambda: text_classes(rows, distinct, links))
    return common.joined(rows.select("doc_id", "text_key"), of, "text_key", ["doc_id"], rows.count()).select("doc_id", "n_links", "class_id")


def text_classes(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(text_key, n_links, class_id, n) of every text, with the number of its rows."""
    root = common.components(links).withColumnRenamed("node", "tid")
    ends = links.select(F.col("a").alias("tid")).unionByName(links.select(F.col("b").alias("tid"))).groupBy("tid").agg(F.count("*").alias("n_links"))
    least = rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).join(distinct.select("tid", "text_key"), "text_key")
    least = least.join(root, "tid", "left").join(ends, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    least = common.written(least.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")), "least")
    ids = least.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    of = common.joined(least.drop("least"), ids, "root", ["tid"], least.count())
    return of.select("text_key", "n_links", "class_id", F.col("rows").alias("n"))
