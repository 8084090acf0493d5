"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

A source's budget is a number of words. Complete epochs take every document whole; what is left of
the budget is filled in the order of exponential keys -ln(u) / weight, u from the document's id, and
weight from its quality label, so that good documents come earlier. The order within a source is
summed in two levels: key ranges first, then rows within a range, so that a source with a third
of all rows is spread over many tasks.

Only DataFrame functions. The texts are read once: their sizes and keys are written beside a row number, the plan is
made of those, and rows get their part of it by that number.

Defined cases: null text has size 0 and is never taken; null sources form one source, ordered last; u depends on id
and text, so that null and repeated ids are dealt out like others; rows that repeat both count as one after the other,
and either may be cut; a very long text is one row; an empty table gives an empty result; columns named as
a result column are replaced in mix() and all others are kept. Windows over sources hold one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Weight of a document by its quality label; none: 1.
QUALITY = {1: 2.0, 0: 0.5}
#: Key ranges per source.
RANGES = 1024
RESULT = ("size", "source_size", "target", "taken")
#: Columns of this module's own tables.
ROW, SIZE, DRAW, TIMES, COPY = "__mix_row", "__mix_size", "__mix_draw", "__mix_times", "__mix_copy"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Of rows (source, _source, source_size): (_source, source_size, target), shares by weight, none above MOST times its size.

    Resharing the excess until none is above ends with a common level: source i gets
    min(cap_i, weight_i * level). In the order of cap / weight, the capped sources are a prefix,
    and each prefix gives one candidate level. Capping raises the level as long as it is above the
    next ratio, and lowers it afterwards: the highest candidate holds.
    The table has a row for each source, so its windows are small."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (rank % len(WEIGHTS) + 1).cast("int"))
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
    rest_cap = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = rest_cap / rest_weight
    rows = rows.withColumn("level", level)
    return rows.withColumn("level", F.max("level").over(everything)).select("_source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def draw(doc_id: Column, text: Column) -> Column:
    """-ln(u) with u in (0, 1) from 52 bits of the md5 of id and text."""
    own = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text.cast("binary")))
    bits = F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, SIZE and DRAW."""
    return docs.select("*", F.monotonically_increasing_id().alias(ROW), words(F.col("text")).alias(SIZE), draw(F.col("doc_id"), common.whole_text()).alias(DRAW))


def planned(rows: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """(ROW, doc_id, size, source_size, target, taken) of rows (ROW, doc_id, source, SIZE, DRAW), a written table."""
    rows = rows.select(ROW, "doc_id", "source", F.col(SIZE).alias("size"), DRAW)
    weight = F.lit(1.0)
    if quality is not None:
        best = quality.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        rows = rows.join(best.hint("merge"), "doc_id", "left")
        for label, w in QUALITY.items():
            weight = F.when(F.col("_quality") == label, F.lit(w)).otherwise(weight)
    rows = rows.withColumn("_key", F.col(DRAW) / weight)
    # exp(-key) lies in (0, 1): equal ranges of it deal a source's rows out.
    rows = rows.withColumn("_range", F.floor((1 - F.exp(-F.col("_key"))) * RANGES).cast("int"))
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).select(ROW, "doc_id", "source", "size", "_key", "_range", "_source")
    sums = rows.groupBy("source", "_source", "_range").agg(F.sum("size").alias("_sum"))
    own = targets(sums.groupBy("source", "_source").agg(F.sum("_sum").alias("source_size")))
    ahead = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    plan = plan.join(own, "_source").select("_source", "_range", "_ahead", "source_size", "target")
    within = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", ROW).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan.hint("merge"), ["_source", "_range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - epochs * F.col("source_size") - F.col("_ahead") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select(ROW, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes of each row.

    quality: rows (doc_id, quality); the best label of an id counts."""
    rows = common.written(numbered(docs.drop(*RESULT)), "numbered")
    return rows.drop(SIZE, DRAW).join(planned(rows, quality).drop("doc_id").hint("merge"), ROW).drop(ROW)


def takings(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: mix() without what else docs has."""
    slim = numbered(docs).select(ROW, "doc_id", "source", SIZE, DRAW)
    rows = common.written(slim.repartition(common.slim_files(docs.sparkSession)), "sizes")
    return planned(rows, quality).drop(ROW)


def materialise(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The mix as rows of docs, whatever their columns: a document once for every time that it is taken, always whole.
    The one document of a source that the budget cuts is there once more if at least half of it is wanted. Untaken
    documents go, and with them those without a word."""
    rows = common.written(numbered(docs), "numbered")
    plan = planned(rows, quality)
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    plan = plan.where("size > 0").select(ROW, times.alias(TIMES)).where(F.col(TIMES) > 0)
    made = rows.drop(SIZE, DRAW).join(plan.hint("merge"), ROW).select("*", F.explode(F.sequence(F.lit(1), F.col(TIMES))).alias(COPY))
    return made.drop(ROW, TIMES, COPY)


#: DuckDB SQL for mix() over tables documents and labels; own(...) as in targets().
ORACLE = f"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce(text, '') AS body,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}) / CASE q WHEN 1 THEN {QUALITY[1]}::DOUBLE WHEN 0 THEN {QUALITY[0]}::DOUBLE ELSE 1.0::DOUBLE END AS k
  FROM documents d LEFT JOIN best USING (doc_id)),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sums),
ranked AS (SELECT *, {MOST}::DOUBLE * source_size / w AS ratio FROM weighed),
levels AS (
  SELECT *, (({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum({MOST}::DOUBLE * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))) AS level
  FROM ranked WINDOW before AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
own AS (
  SELECT source, source_size, least({MOST}::DOUBLE * source_size, w * (SELECT max(level) FROM levels)) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, o.source_size, o.target, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
    CASE WHEN o.source_size > 0 THEN floor(o.target / o.source_size)::BIGINT ELSE 0 END AS epochs
  FROM sized s JOIN own o ON s.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken FROM placed
"""
