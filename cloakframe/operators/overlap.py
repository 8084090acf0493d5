"""Overlap resolution and clipping of findings within a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.text import let, running
from cloakframe.schema import FINDING, FINDINGS


def by_start(findings: Column) -> Column:
    keyed = F.transform(findings, lambda f: F.struct(f["start"].alias("s"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def clusters(findings: Column) -> Column:
    """Findings as arrays of those that hang together: each begins where no earlier one reaches."""
    keyed = F.transform(findings, lambda f, i: F.struct(f["start"].alias("s"), i.alias("i"), f.alias("f")))
    return let(F.transform(F.array_sort(keyed), lambda x: x["f"]), _cut)


def _cut(ordered: Column) -> Column:
    reach = running(ordered, F.lit(-1), lambda end, f: (F.greatest(end, f["end"]), end), "int")
    # 1-based places at which a cluster begins, and one beyond the last.
    first = lambda ends: F.filter(F.transform(ordered, lambda f, i: F.when(f["start"] >= F.get(ends, i), i + 1)), lambda i: i.isNotNull())
    slices = lambda at: F.transform(at, lambda a, i: F.slice(ordered, a, F.coalesce(F.get(at, i + 1), F.size(ordered) + 1) - a))
    return let(let(reach, first), slices)


def resolved(findings: Column) -> Column:
    """Greedy, the longest first: ties by start, then by the order in which they came. A finding stays
    if it is disjoint from all that stayed before it. Ordered by start.

    Only findings that hang together are compared; nearly all of a text's stand alone."""

    def step(kept: Column, x: Column) -> Column:
        meets = F.exists(kept, lambda k: (x["f"]["start"] < k["end"]) & (k["start"] < x["f"]["end"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(x["f"])))

    def greedy(cluster: Column) -> Column:
        # A cluster is in the order of starts and, where equal, of arrival: ties need no more than the place in it.
        keyed = F.transform(cluster, lambda f, i: F.struct((f["start"] - f["end"]).alias("n"), i.alias("i"), f.alias("f")))
        return by_start(F.aggregate(F.array_sort(keyed), F.array().cast(FINDINGS), step))

    return F.flatten(F.transform(clusters(findings), lambda c: F.when(F.size(c) == 1, c).otherwise(greedy(c))))


def clipped(findings: Column, spans: Column) -> Column:
    """Findings that lie within some value span, by start. One sweep over both: a finding is inside if the farthest end among
    the spans that begin before it or with it isn't before its own."""
    none = F.lit(None).cast(FINDING)
    events = F.concat(
        F.transform(spans, lambda s, i: F.struct(s["start"].cast("int").alias("s"), F.lit(0).alias("o"), i.alias("i"), s["end"].cast("int").alias("e"), none.alias("f"))),
        F.transform(findings, lambda f, i: F.struct(f["start"].alias("s"), F.lit(1).alias("o"), i.alias("i"), f["end"].alias("e"), f.alias("f"))),
    )

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["o"] == 0, F.greatest(reach, x["e"])).otherwise(reach), F.when((x["o"] == 1) & (x["e"] <= reach), x["f"])

    return F.when(F.size(findings) > 0, F.filter(running(F.array_sort(events), F.lit(-1), step, FINDING), lambda f: f.isNotNull())).otherwise(findings)


#: Code points of the cells in which findings and spans of a table meet.
CELL = 1024


def clipped_rows(findings: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Rows of findings (key, start, end, ...) that lie within a span (key, start, end) of their document.

    A span stands in every cell that it touches, a finding in that of its start alone, so they meet by an equality and a
    document of many findings is spread over its cells. The exact ends decide."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    placed = spans.where(F.col("end") > F.col("start")).select(F.col(key).alias("_key"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(cell("start"), F.floor((F.col("end") - 1) / CELL))).alias("_at"))
    inside = (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_at")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    return findings.withColumn("_cell", cell("start")).join(placed, inside, "left_semi").drop("_cell")


def resolved_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """resolved() of a table (key, start, end, order, ...) whose keys may have any number of rows: `order` says which came first.

    Of rows with equal key, start and end only the first can stay, and an aggregate within each task finds it before any
    row moves. Windows cut a key into clusters that hang together. A cluster's rows then pass through a task as three flat arrays:
    longest first, a row stays if neither its first nor its last point is covered, since whatever stayed before it is as long
    or longer and so covers one of the two if they meet. Each point is covered once, so the cost is that of sorting.

    Null keys are a key; empty rows (end <= start) meet nothing that stays and are kept."""
    first = rows.groupBy(key, "start", "end").agg(F.min(order).alias(order))
    by_place = Window.partitionBy(key).orderBy("start", order)
    reach = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    cut = first.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)))
    schema = first.select(key, "start", "end", order).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []

        def settled() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(open_).combine_chunks()
            yield from whole.filter(pa.array(greedy(*(whole.column(c).to_numpy() for c in ("start", "end", order)), whole.column("_new").to_numpy()))).select(schema.names).to_batches()

        for batch in batches:
            begins = np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False))
            if len(begins) and begins[-1] > 0 or len(begins) and open_:
                # What stands before the last beginning is complete.
                open_.append(batch.slice(0, begins[-1]))
                yield from settled()
                open_ = []
                batch = batch.slice(begins[-1])
            open_.append(batch)
        if open_:
            yield from settled()

    kept = cut.select(*schema.names, "_new").mapInArrow(run, schema)
    if set(rows.columns) == set(schema.names):
        return kept.select(*rows.columns)
    mine = [rows[c].eqNullSafe(kept[c]) for c in (key, "start", "end", order)]
    return rows.join(kept, mine[0] & mine[1] & mine[2] & mine[3], "left_semi")


def greedy(start: np.ndarray, end: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which of the rows stay; rows stand by place, and `new` marks those that begin a cluster."""
    cluster = np.cumsum(new)
    width = int(max(end.max(initial=0) - start.min(initial=0), 0)) + 2
    low = int(start.min(initial=0))
    at = lambda x: cluster * width + (x - low)  # noqa: E731  clusters one after the other
    heads, tails = at(start), at(end - 1)
    points = np.unique(np.concatenate([heads, tails]))
    a, b = np.searchsorted(points, heads), np.searchsorted(points, tails)
    covered = np.zeros(len(points), bool)
    stay = np.zeros(len(start), bool)
    for i in np.lexsort((order, start, start - end, cluster)):
        if end[i] <= start[i]:
            stay[i] = True
        elif not (covered[a[i]] or covered[b[i]]):
            stay[i] = True
            covered[a[i] : b[i] + 1] = True
    return stay
