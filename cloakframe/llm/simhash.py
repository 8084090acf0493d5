"""SimHash near-dedup over a segment-popcount embedding.

A 64-bit fingerprint maps to the bit counts of its segments. Flipping a bit moves one count by one,
so the Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints.
The embedding's dimensions fall into groups; within distance LIMIT, all groups but LIMIT have distance
zero, so the points of any link share a grid cell made of the counts of all groups but some LIMIT. Within a cell the Manhattan bound comes first, the exact
distance of the surviving pairs after it.

Only distinct fingerprints meet. Cells are sorted, not gathered, and leave Python as a spanning
forest. The members of a cell with more than HOT fingerprints meet again on a finer grid (more groups, of which as
many as before may differ), which is as exact and has smaller cells. What is still larger on the finest grid is
dealt into blocks, of which any two meet. Cells, Manhattan bound and exact distance decide at every size.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer than three
words make one shingle; repeated rows share a component; with no id at all the component is null; an empty
table gives an empty one; a text of any length is one row; classes() drops columns that are not asked for, and
deduplicate() keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cloakframe.llm import common

WIDTH, SEED, LIMIT = 3, 42, 3
SEGMENT_BITS = 2
#: Groups of the grid, and of the finer grids of dense cells: 20, 84 and 220 cells a fingerprint.
GROUPS = (6, 9, 12)
HOT = 4096

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(len(words) - WIDTH + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(WIDTH, len(words)) - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also..., fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.utf8(batch.column(1))
            raw = memoryview(data)
            fps = [fingerprint(bytes(raw[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fps, pa.int64())], ["doc_id", *also, "fp"])

    own = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *also))
    return docs.select("doc_id", "text", *also).mapInArrow(run, f"{own}, fp long")


def cells(fps: DataFrame, groups: int = GROUPS[0]) -> DataFrame:
    """(cell, fp): the grid cells of each fingerprint's embedding, one for each choice of groups.

    The counts of a segment of two bits are 0, 1, 2: a cell's counts pack into a long."""
    n = 64 // SEGMENT_BITS
    counts = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))) for i in range(n)]
    packed = F.lit(0).cast("long")
    for i, c in enumerate(counts):
        packed = packed.bitwiseOR(F.shiftleft(c.cast("long"), 2 * i))
    edges = [round(n * g / groups) for g in range(groups + 1)]
    masks = []
    for chosen in combinations(range(groups), groups - LIMIT):
        mask = sum(3 << (2 * i) for g in chosen for i in range(edges[g], edges[g + 1]))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    # The array is a literal of the plan; each of its masks makes one cell.
    masked = F.transform(F.array(*map(F.lit, masks)), lambda m, i: F.xxhash64(i, F.col("v").bitwiseAND(m)))
    return fps.withColumn("v", packed).select("fp", F.explode(masked).alias("cell"))


_COUNTS = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def ones(x: np.ndarray) -> np.ndarray:
    return _COUNTS[x.view(np.uint16).reshape(-1, 4)].sum(axis=1, dtype=np.int64)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embeddings, with the counts of all segments side by side in a word."""
    even, two = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333)
    ca, cb = (a & even) + (a >> np.uint64(1) & even), (b & even) + (b >> np.uint64(1) & even)
    total = np.zeros(len(a), np.int64)
    for shift in (0, 2):
        # One field of four bits a segment, kept from borrowing by a guard bit.
        guard = np.uint64(0x8888888888888888)
        x = ((ca >> np.uint64(shift) & two) | guard) - (cb >> np.uint64(shift) & two)
        low = (x ^ guard).view(np.uint8)
        fields = np.stack([low & 15, low >> 4]).astype(np.int64)
        total += np.where(fields > 7, 16 - fields, fields).sum(axis=0).reshape(-1, 8).sum(axis=1)
    return total


def forest(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among fingerprints that share a cell; cells lie together."""
    values, node = np.unique(fp, return_inverse=True)
    bits = fp.view(np.uint64)
    root = np.arange(len(values))
    at = np.arange(len(fp))
    lag = 1
    while True:
        at = at[at + lag < len(fp)]
        at = at[cell[at] == cell[at + lag]]
        if not len(at):
            break
        a, b = bits[at], bits[at + lag]
        near = np.flatnonzero(manhattan(a, b) <= LIMIT)
        near = near[ones(a[near] ^ b[near]) <= LIMIT]
        x, y = root[node[at[near]]], root[node[at[near] + lag]]
        if (x != y).any():
            root = common.local_roots(len(values), np.concatenate([np.arange(len(values)), x]), np.concatenate([root, y]))
        lag += 1
    child = np.flatnonzero(root != np.arange(len(values)))
    return values[child], values[root[child]]


def cell_links(rows: DataFrame) -> DataFrame:
    """(a, b) links among rows (cell, fp) that lie sorted by cell in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(cell, fp)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            if sum(x.shape[1] for x in held) < 1 << 16:
                continue
            cell, fp = np.concatenate(held, axis=1)
            cut = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
            if cut:
                yield links(cell[:cut], fp[:cut])
            held = [np.stack([cell[cut:], fp[cut:]])]
        if held:
            yield links(*np.concatenate(held, axis=1))

    return rows.select("cell", "fp").mapInArrow(run, "a long, b long")


def blocks(dense: DataFrame, hot: int) -> DataFrame:
    """Rows (cell, fp) of cells with n members, dealt into parts of about `hot` of which any two meet in a cell of their own."""
    parts = F.ceil(F.col("n") / hot).cast("int")
    dealt = dense.withColumn("side", F.pmod(F.xxhash64("fp"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.select(F.xxhash64("cell", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "fp")


def roots(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root) of the distinct fingerprints `fps` (fp) that have a link."""
    n = common.partitions(fps.sparkSession)
    links = None
    for groups in GROUPS:
        placed = cells(fps, groups)
        size = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("members", F.col("n"))
        total = fps.count() * comb(groups, LIMIT)
        shared = common.written(common.joined(placed, size, "cell", ["fp"], total).withColumnRenamed("members", "n"), "cells")
        dense = shared.where(F.col("n") > hot)
        last = not dense.limit(1).count()
        rows = shared.where(F.col("n") <= hot).select("cell", "fp")
        if groups == GROUPS[-1] and not last:
            rows = rows.unionByName(blocks(dense, hot))
        found = cell_links(rows.repartition(n, "cell").sortWithinPartitions("cell", "fp"))
        links = found if links is None else links.unionByName(found)
        if last:
            break
        fps = common.written(dense.select("fp").distinct(), "dense")
    return common.components(links)


def grouped(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """rows (doc_id, fp, ...), a written table, with root (one fingerprint for all that links reach) and component_id."""
    of = common.settled("members", lambda: members(rows, hot))
    return common.joined(rows, of, "fp", [c for c in rows.columns if c != "fp"], rows.count())


def members(rows: DataFrame, hot: int) -> DataFrame:
    """(fp, root, component_id, n) of the fingerprints of rows, with the number of their rows."""
    total = rows.count()
    distinct = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    root = roots(distinct.select("fp"), hot)
    of = distinct.join(root, distinct["fp"] == root["node"], "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "least", "root", F.col("n").alias("rows"))
    of = common.written(of, "roots")
    component = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return common.joined(of.drop("least"), component, "root", ["fp"], total).withColumnRenamed("rows", "n")


def classes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    found = grouped(common.written(fingerprints(docs), "fingerprints"), hot)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs without all but one row of each component: the row with the smallest id stays, null ids last.

    Of rows that repeat that id, the one whose text has the least hash stays. Rows are numbered in a written
    copy of docs, so the texts move once, dealt by that number."""
    kept = common.written(docs.select(F.monotonically_increasing_id().alias("__row"), *(F.col(f"`{c}`") for c in docs.columns)), "numbered")
    own = kept.select("doc_id", "text", F.col("__row").alias("row"), F.xxhash64(common.whole_text()).alias("tie"))
    rows = common.written(fingerprints(own, ("row", "tie")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row")
    first = grouped(rows, hot).groupBy("root").agg(F.min_by("row", order).alias("__row")).select("__row")
    return kept.join(first, "__row", "left_semi").drop("__row")
