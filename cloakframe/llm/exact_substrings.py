"""Exact substring dedup by column-wise suffix sorting.

A byte goes if a string of WIDTH bytes covers it that starts earlier as well (smaller id, or earlier in
the same text). Equal strings must meet, whatever text they stand in:

1. Every window of WIDTH bytes has an anchor, the gram of GRAM bytes inside it with the least hash.
   Neighbouring windows share anchors; a run of them is a piece, and equal windows lie in pieces
   of equal anchors. Anchors that occur once end here, and so do all but the first of equal pieces:
   their windows have all occurred before.
2. Different pieces of one anchor get their bytes, and windows whose hash occurs once among them are cut off.
3. The rest are the strings of a collection whose Burrows-Wheeler transform and common prefixes are
   built column by column (column_bwt). Suffixes with a common prefix of WIDTH are equal
   windows; all but the first of a class go.

Equal pieces are told by a BLAKE2b digest of 128 bits under a key drawn for each run, so no text can be made to
collide; the transform decides among the different ones.

Frequent anchors, which a share of the documents shows beforehand, are dealt over tasks by anchor and digest, and all
their different pieces go on. An anchor with more than HOT different pieces is cut again by longer grams, at last by
the whole window, so no anchor gathers more than HOT of them in one task. Texts move compressed.

Defined cases: null and empty texts have nothing to remove; rows that repeat both id and text count as
one document and each gets its result; ids are integers; texts that share an id are ordered by their hash; null ids come
last; an empty table gives an empty one; a very long text is cut into parts that share their borders; columns that are
not asked for are dropped.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import column_bwt, common

WIDTH = 100
GRAM = 24
LONGER = (62, 86, WIDTH)
HOT = 2048
#: Pieces of one collection, unless one anchor has more.
COLLECTION = 3000
#: One document in so many shows which anchors are frequent: they are dealt apart, which changes no result. So many
#: anchors at most for each partition.
SHOWN, FREQUENT = 16, 8
#: A longer text is cut into overlapping parts while anchors are searched.
PART = 4 << 20
PLACE = np.uint64((1 << 24) - 1)


# --- pieces --------------------------------------------------------------------------------


def digests(raw: bytes, begin: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """Two 64-bit halves of the keyed digest of each span of raw."""
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16, key=key).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(made, np.uint64).reshape(-1, 2)


def pieces(data: np.ndarray, offsets: np.ndarray, gram: int, key: bytes = b"") -> tuple[np.ndarray, ...]:
    """(text, start, end, anchor, digest) of every piece of a block's texts, places in the block."""
    n, span = len(data), WIDTH - gram + 1
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64).reshape(-1, 2)
    prefix = common.prefix_hash(data)
    _, down = common.powers(n + 1)
    hashes = common.mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    ranked = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    # Least of each window of `span`: the end of one row of `span` and the beginning of the next.
    rows = np.full(-(-len(ranked) // span) * span, ~np.uint64(0))
    rows[: len(ranked)] = ranked
    rows = rows.reshape(-1, span)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WIDTH + 1
    least = (np.minimum(tail[:windows], head[span - 1 : span - 1 + windows]) & PLACE).astype(np.int64)
    start = np.flatnonzero(np.arange(windows) + WIDTH <= np.repeat(offsets[1:], np.diff(offsets))[:windows])
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64).reshape(-1, 2)
    least = least[start]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)]))
    begin = start[first]
    end = start[np.append(first[1:], len(start)) - 1] + WIDTH
    return np.searchsorted(offsets, begin, side="right") - 1, begin, end, hashes[least[first]], digests(data.tobytes(), begin, end, key)


def parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, place in that text, bytes, offsets) so that every window is in exactly one part."""
    if len(offsets) != 2 or len(data) <= PART:
        yield 0, 0, data, offsets
        return
    for at in range(0, len(data) - WIDTH + 1, PART):
        part = data[at : at + PART + WIDTH - 1]
        yield 0, at, part, np.array([0, len(part)])


def _packed(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (start << 8) | size


PIECE = "anchor long, digest long, digest2 long, k long, place long, done boolean, hot boolean"


def _piece_batch(anchor, digest, k, place, done, hot, extra=()) -> pa.RecordBatch:  # noqa: ANN001
    names = ["anchor", "digest", "digest2", "k", "place", "done", "hot", "piece"]
    columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (anchor, digest[:, 0], digest[:, 1])] + [pa.array(k), pa.array(place), pa.array(done), pa.array(hot), *extra]
    return pa.RecordBatch.from_arrays(columns, names[: len(columns)])


def firsts(anchor: np.ndarray, digest: np.ndarray, k: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, anchors, done): pieces sorted so that the first of equal ones keeps its anchor; the others are done, as
    their windows have occurred before, and are dealt out by their place instead."""
    order = np.lexsort((place, k, digest[:, 1], digest[:, 0], anchor))
    k, place, anchor, digest = k[order], place[order], anchor[order], digest[order]
    done = np.zeros(len(k), bool)
    done[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1]).all(axis=1)
    return order, np.where(done, common.mix((k * 1_000_003 + place).view(np.uint64)), anchor), done


def frequent(docs: DataFrame, key: bytes = b"") -> np.ndarray:
    """Anchors that many pieces of a share of docs have, sorted; their number is bounded by that of the partitions."""
    shown = anchored(docs.where(F.pmod(F.xxhash64("k"), F.lit(SHOWN)) == 0), key=key).where("not done")
    most = shown.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.col("n").desc(), "anchor").limit(FREQUENT * common.partitions(docs.sparkSession))
    return np.sort(most.select("anchor").toArrow()["anchor"].to_numpy().view(np.uint64))


def anchored(docs: DataFrame, often: np.ndarray | None = None, key: bytes = b"") -> DataFrame:
    """(PIECE) of every text of docs (k, text), of a block's with firsts(). Anchors in `often` are hot."""
    often = np.zeros(0, np.uint64) if often is None else often
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for rows, block, at in common.blocks(batch):
                for first, ahead, data, offsets in parts(block, at):
                    text, begin, end, anchor, digest = pieces(data, offsets, GRAM, key)
                    k = keys[rows][text + first]
                    place = _packed(begin - offsets[text] + ahead, end - begin)
                    order, anchor, done = firsts(anchor, digest, k, place)
                    yield _piece_batch(anchor, digest[order], k[order], place[order], done, np.isin(anchor, shared.value) & ~done)

    return docs.select("k", "text").mapInArrow(run, PIECE)


def resolve(rows: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Of PIECE rows: (k, place, anchor, open[, piece]). Not open: all windows have occurred before;
    open: the first of its kind among different pieces of one anchor, or of a hot one. Others are left out."""
    n = common.partitions(rows.sparkSession)
    route = F.when(F.col("hot"), F.xxhash64("anchor", "digest", "digest2")).otherwise(F.col("anchor"))
    rows = rows.repartition(n, route).sortWithinPartitions("anchor", "digest", "digest2", "k", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # anchor and digest of the row before
        waiting: pa.RecordBatch | None = None  # the only kind of the current anchor so far
        for batch in batches:
            if not len(batch):
                continue
            anchor, digest, other = (batch.column(c).to_numpy() for c in range(3))
            done = batch.column(5).to_numpy(zero_copy_only=False)
            again = np.concatenate([[last is not None and anchor[0] == last[0]], anchor[1:] == anchor[:-1]])
            same = again & np.concatenate([[last is not None and (digest[0], other[0]) == last[1:]], (digest[1:] == digest[:-1]) & (other[1:] == other[:-1])])
            kind = ~same & ~done
            group = np.cumsum(~again) - (not again[0])
            kinds = np.bincount(group, kind, group[-1] + 1)
            kinds[group[batch.column(6).to_numpy(zero_copy_only=False)]] += 2  # others may be in another task
            joins = bool(again[0])
            if joins:  # the first group goes on from the batch before
                kinds[0] += 1
                if waiting is not None and kinds[0] > 1:
                    yield _resolved(waiting, np.array([0]), True, with_bytes)
                    waiting = None
                elif waiting is None:
                    kinds[0] += 1
            elif waiting is not None:
                waiting = None
            wait = None
            if kinds[-1] == 1:
                at = np.flatnonzero(kind & (group == group[-1]))
                wait = batch.slice(int(at[0]), 1) if len(at) else waiting
            yield _resolved(batch, np.flatnonzero(kind & (kinds[group] > 1)), True, with_bytes)
            yield _resolved(batch, np.flatnonzero(same | done), False, with_bytes)
            waiting, last = wait, (int(anchor[-1]), int(digest[-1]), int(other[-1]))

    return rows.mapInArrow(run, "k long, place long, anchor long, open boolean" + ", piece binary" * with_bytes)


def _resolved(batch: pa.RecordBatch, rows: np.ndarray, open_: bool, with_bytes: bool) -> pa.RecordBatch:
    some = batch.take(pa.array(rows, pa.int64()))
    columns = [some.column(3), some.column(4), some.column(0), pa.array(np.full(len(rows), open_)), *([some.column(7)] if with_bytes else [])]
    return pa.RecordBatch.from_arrays(columns, ["k", "place", "anchor", "open", "piece"][: len(columns)])


# --- collections -----------------------------------------------------------------------------


def _starts(flags: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where runs of set flags begin that don't cross owners."""
    before = np.concatenate([[False], flags[:-1] & (owner[1:] == owner[:-1])])
    return np.flatnonzero(flags & ~before)


def repeated(k: np.ndarray, start: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, start, end) of the runs of windows that occur earlier among the strings, which hold all
    occurrences of their windows; string i stands at start[i] of text k[i]."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    count = np.diff(offsets) - WIDTH + 1
    owner = np.repeat(np.arange(len(strings)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offsets[owner]
    prefix = common.prefix_hash(data)
    hashes = common.span_hash(prefix, place, place + WIDTH)
    # A window alone with its hash is alone.
    order = np.argsort(hashes)
    twin = hashes[order][1:] == hashes[order][:-1]
    some = np.zeros(len(hashes), bool)
    some[order[1:]] |= twin
    some[order[:-1]] |= twin
    first = _starts(some, owner)
    if not len(first):
        return k[:0], start[:0], start[:0]
    last = len(some) - 1 - _starts(some[::-1], owner[::-1])[::-1]
    begin, end, own = place[first], place[last] + WIDTH, owner[first]
    at = start[own] + begin - offsets[own]
    # Equal strings: the first stands for all, and the others have occurred before.
    digest = common.span_hash(prefix, begin, end)
    order = np.lexsort((at, k[own], digest, end - begin))
    same = np.zeros(len(order), bool)
    same[1:] = (digest[order][1:] == digest[order][:-1]) & ((end - begin)[order][1:] == (end - begin)[order][:-1])
    raw = data.tobytes()
    for i in np.flatnonzero(same).tolist():  # equal in hash and length: equal byte for byte?
        a, b = order[i - 1], order[i]
        same[i] = raw[begin[a] : end[a]] == raw[begin[b] : end[b]]
    copies, kept = order[same], order[~same]
    rows = column_bwt.construct([raw[begin[i] : end[i]] for i in kept])
    group, string, length = column_bwt.repeats(rows, WIDTH)
    own_k, own_at = k[own[kept]][string], at[kept][string] + (end - begin)[kept][string] - length
    order = np.lexsort((own_at, own_k, group))
    later = np.zeros(len(order), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    gone_k, gone_at = own_k[order][later], own_at[order][later]
    order = np.lexsort((gone_at, gone_k))
    gone_k, gone_at = gone_k[order], gone_at[order]
    runs = np.flatnonzero(np.concatenate([[True], (gone_k[1:] != gone_k[:-1]) | (gone_at[1:] != gone_at[:-1] + 1)])) if len(gone_k) else np.zeros(0, np.int64)
    stop = gone_at[np.append(runs[1:], len(gone_at)) - 1] + WIDTH if len(runs) else runs
    return (
        np.concatenate([k[own[copies]], gone_k[runs]]),
        np.concatenate([at[copies], gone_at[runs]]),
        np.concatenate([at[copies] + (end - begin)[copies], stop]),
    )


def sorted_collections(rows: DataFrame, collection: int = COLLECTION) -> DataFrame:
    """(k, s, e): runs of bytes whose windows occur earlier, of rows (anchor, k, place, piece)."""
    n = common.partitions(rows.sparkSession)
    rows = rows.select("anchor", "k", "place", "piece").repartition(n, "anchor").sortWithinPartitions("anchor", "k", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result(some: pa.Table) -> pa.RecordBatch:
            place = some.column("place").to_numpy()
            found = repeated(some.column("k").to_numpy(), place >> 8, some.column("piece").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["k", "s", "e"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < collection:
                continue
            some = pa.Table.from_batches(held)
            anchor = some.column("anchor").to_numpy()
            other = np.flatnonzero(anchor != anchor[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield result(some.slice(0, cut))
            held = some.slice(cut).combine_chunks().to_batches()
        if held and sum(map(len, held)):
            yield result(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "k long, s long, e long")


# --- documents ---------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with k, a long that orders the documents, and one row of each k; k is equal only for
    rows with equal id and text. Ids that are distinct and not null serve as they are."""
    ids = docs.select("doc_id").agg(F.count("*").alias("n"), F.count("doc_id").alias("own"))
    repeated_ = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    n, own = ids.first()
    if n == own and not repeated_:
        docs = docs.withColumn("k", F.col("doc_id").cast("long"))
        return docs, docs
    spark = docs.sparkSession
    docs = docs.withColumn("_h", F.xxhash64(common.whole_text()))
    ranked = docs.select("doc_id", "_h").distinct().repartitionByRange(common.partitions(spark), F.col("doc_id").asc_nulls_last(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "_h")
    ranked = common.written(ranked.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "ranks")
    # Rows a partition: a few numbers, one for each partition.
    ahead, sizes = 0, {}
    for part, low, count in sorted(ranked.groupBy("_part").agg(F.min("_place"), F.count("*")).collect()):
        sizes[part] = ahead - low
        ahead += count
    base = F.element_at(F.create_map(*(F.lit(x).cast("long") for item in sizes.items() for x in item)), F.col("_part").cast("long")) if sizes else F.lit(0)
    ranked = ranked.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), (F.col("_place") + base).alias("k"))
    docs = docs.join(ranked, docs["doc_id"].eqNullSafe(ranked["_id"]) & (docs["_h"] == ranked["_hash"])).drop("_id", "_h", "_hash")
    return docs, docs.dropDuplicates(["k"])


def packed(docs: DataFrame) -> DataFrame:
    """(k, doc_id, z): texts compressed for the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, at = common.utf8(batch.column(2))
            raw = data.tobytes()
            z = [pack.compress(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(z, pa.binary())], ["k", "doc_id", "z"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("k", "doc_id", "text").mapInArrow(run, f"k long, doc_id {kind}, z binary")


def with_bytes(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(anchor, k, place, piece): the bytes of the pieces (anchor, k, place)."""
    asked = open_.groupBy("k").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(len(batch)):
                raw = unpack.decompress(batch.column(1)[i].as_py())
                place = np.array(batch.column(3)[i].as_py(), np.int64)
                cut = [raw[p >> 8 : (p >> 8) + (p & 255)] for p in place.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(2)[i].as_py(), pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(cut), pa.int64()), pa.array(place), pa.array(cut, pa.binary())], ["anchor", "k", "place", "piece"])

    joined = texts.select("k", "z").join(asked.hint("merge"), "k").select("k", "z", "anchors", "places")
    return joined.mapInArrow(run, "anchor long, k long, place long, piece binary")


def recut(rows: DataFrame, gram: int, key: bytes = b"") -> DataFrame:
    """PIECE rows with bytes: the pieces of `rows` cut by longer grams, of a batch's with firsts(). All anchors are hot,
    but for whole windows, which are their own anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            strings = batch.column(3).to_pylist()
            data = np.frombuffer(b"".join(strings), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
            text, begin, end, anchor, digest = pieces(data, offsets, gram, key)
            raw = data.tobytes()
            k, at = keys[text], _packed((place[text] >> 8) + begin - offsets[text], end - begin)
            order, anchor, done = firsts(anchor, digest, k, at)
            cut = pa.array([raw[a:b] for a, b in zip(begin[order].tolist(), end[order].tolist(), strict=True)], pa.binary())
            yield _piece_batch(anchor, digest[order], k[order], at[order], done, ~done & (gram < WIDTH), (cut,))

    return rows.select("anchor", "k", "place", "piece").mapInArrow(run, PIECE + ", piece binary")


def spans(docs: DataFrame, texts: DataFrame, hot: int = HOT, collection: int = COLLECTION) -> DataFrame:
    """(k, s, e): runs of bytes to remove; they may overlap."""
    key = os.urandom(16)
    found = common.written(resolve(anchored(docs, frequent(docs, key), key)), "pieces")
    span = [F.shiftright("place", 8).alias("s"), (F.shiftright("place", 8) + F.col("place").bitwiseAND(255)).alias("e")]
    gone = found.where(~F.col("open")).select("k", *span)
    open_ = found.where("open").select("anchor", "k", "place")
    sizes = open_.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
    crowded = common.written(sizes, "crowded")
    if not crowded.limit(1).count():
        return gone.unionByName(sorted_collections(with_bytes(open_, texts), collection))
    rows = common.written(with_bytes(open_, texts), "bytes")
    gone = gone.unionByName(sorted_collections(rows.join(crowded, "anchor", "left_anti"), collection))
    rows = rows.join(crowded, "anchor", "left_semi")
    for gram in LONGER:
        again = common.written(resolve(recut(rows, gram, key), with_bytes=True), "recut")
        gone = gone.unionByName(again.where(~F.col("open")).select("k", *span))
        open_ = again.where("open").select("anchor", "k", "place", "piece")
        if gram == WIDTH:  # a piece is one window: no anchor has two kinds, but for equal hashes
            return gone.unionByName(sorted_collections(open_, collection))
        crowded = common.written(open_.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "crowded")
        gone = gone.unionByName(sorted_collections(open_.join(crowded, "anchor", "left_anti"), collection))
        if not crowded.limit(1).count():
            return gone
        rows = open_.join(crowded, "anchor", "left_semi")
    return gone


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(docs: DataFrame, hot: int = HOT, collection: int = COLLECTION) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row."""
    docs, single = keyed(docs.select("doc_id", "text"))
    texts = packed(docs)
    marks = common.settled("marks", lambda: spans(single, texts if single is docs else packed(single), hot, collection))
    marks = marks.groupBy("k").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for i in range(len(batch)):
                raw = unpack.decompress(batch.column(1)[i].as_py()) if batch.column(1)[i].as_py() else b""
                s, e = (np.array(batch.column(c)[i].as_py() or [], np.int64) for c in (2, 3))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order]) if len(s) else e
                new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
                begin, end = s[new], e[np.append(np.flatnonzero(new)[1:], len(s)) - 1] if len(s) else e
                kept, at = [], 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(rest), len(begin), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = texts.join(marks.hint("merge"), "k", "left").select("doc_id", "z", "s", "e")
    return joined.mapInArrow(run, f"doc_id {kind}, {RESULT}, kept binary")
