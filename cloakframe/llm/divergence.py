"""How far the sources of a language differ in their words: joint count histograms of every pair of sources.

A word's counts in two sources decide what it adds to their divergence, so equal pairs of counts are tallied and the
function is evaluated once for each, times how many words have it. Words with the same counts in all sources are one pattern; the
pairs of a pattern's sources give the cells in which both counts are above zero. Cells with a zero are implied: a source's own
histogram without what stands in common cells, and for (0, 0) what is left of the vocabulary.

Words are counted within each task before they meet, so a source of a third of all rows reaches a shuffle as (word, count)
rows; the highest words of a source are cut to the limit within each task as well. The result has a row for each ordered pair of sources
of a language, so a word's list of sources is no longer than a share of the result.

Defined cases: null language, source and text count as empty strings, and the empty string is a language or source as others
are; a text without words still gives its source a place; repeated rows are documents of their own; a text of any
length is counted in blocks; a language whose vocabulary is empty has divergences of 0; a language of one source has no pairs; an
empty table gives an empty result. Other columns of docs are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm import common
from cloakframe.llm.importance import words

LEAST_DOCUMENTS, SCALE, RANKS = 3, 1_000_000_000, 200
#: Letters and all bytes beyond ASCII make up a word; capitals of ASCII become small.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words that a task holds before it passes them on.
HELD = 200_000


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each word, summed by task; a source's row without a word says
    that it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        in_docs: dict[tuple[str, str], Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for group, own in n.items():
                seen = in_docs[group]
                terms = list(own)
                for at in range(0, len(terms), 10_000):
                    some = terms[at : at + 10_000]
                    columns = [pa.array([group[0]] * len(some)), pa.array([group[1]] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([own[t] for t in some], pa.int64()), pa.array([seen[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            n.clear()
            in_docs.clear()

        places: set[tuple[str, str]] = set()
        held = 0
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            fresh = set()
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if group not in places:
                    fresh.add(group)
                own, seen = n.setdefault(group, Counter()), in_docs.setdefault(group, Counter())
                before = len(own)
                distinct: set[bytes] = set()
                for run_ in words(data[offsets[i] : offsets[i + 1]].tobytes(), KEPT):
                    own.update(run_)
                    distinct.update(run_)
                seen.update(distinct)
                held += len(own) - before
                if held >= HELD:
                    yield from flushed()
                    held = 0
            if fresh:
                if len(places) < HELD:  # beyond, a place may be told more than once
                    places |= fresh
                lang, source = zip(*fresh, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.nulls(len(fresh), pa.string()), pa.array([0] * len(fresh), pa.int64()), pa.array([0] * len(fresh), pa.int64())], ["lang", "source", "term", "n", "docs"])
        yield from flushed()

    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = slim.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, own): the words of at least `least` documents of a language, with their counts by source, in its order."""
    per = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("own"))
    return per.where(F.col("docs") >= least).drop("docs")


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + size)), exact; null where both are 0."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), F.nullif((total + size).cast("decimal(31,0)"), F.lit(0).cast("decimal(31,0)"))) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact: shares are below 2^30 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def cells(patterns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, c, d, m): in how many words of a language source a has count c and b has d, zero counts included, for every row
    of pairs (lang, a, b, size), a before b. patterns: rows (lang, own, m)."""
    later = lambda i: F.slice("own", i + 2, F.greatest(F.size("own") - i - 1, F.lit(0)))
    beside = F.transform("own", lambda x, i: F.transform(later(i), lambda y: F.struct(x["source"].alias("a"), y["source"].alias("b"), x["n"].alias("c"), y["n"].alias("d"))))
    common_ = patterns.select("lang", "m", F.explode(F.flatten(beside)).alias("x")).groupBy("lang", "x.a", "x.b", "x.c", "x.d").agg(F.sum("m").alias("m"))
    own = patterns.select("lang", "m", F.explode("own").alias("x")).groupBy("lang", "x.source", "x.n").agg(F.sum("m").alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda c, d, m: F.struct(c.alias("c"), d.alias("d"), m.alias("m"))

    def told(rows: DataFrame, *signed: Column) -> DataFrame:
        return rows.select("lang", "a", "b", F.explode(F.array(*signed)).alias("x")).select("lang", "a", "b", "x.*")

    c, d, n, m = (F.col(x) for x in "cdnm")
    both = told(common_, cell(c, d, m), cell(c, zero, -m), cell(zero, d, -m), cell(zero, zero, m))
    first = told(pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]), cell(n, zero, m), cell(zero, zero, -m))
    second = told(pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]), cell(zero, n, m), cell(zero, zero, -m))
    rest = told(pairs, cell(zero, zero, F.col("size")))
    rows = both.unionByName(first).unionByName(second).unionByName(rest).groupBy("lang", "a", "b", "c", "d").agg(F.sum("m").alias("m"))
    return rows.where("m <> 0 or (c = 0 and d = 0)")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each source from every other of its language (`pair`), and
    the words that set it apart from the whole language (`term`, the first `ranks`)."""
    counts = common.written(counted(docs), "counts")
    terms = common.written(kept(counts, least), "terms")
    sizes = terms.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_total"))
    totals = terms.select("lang", F.explode("own").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    zeros = {"total": 0, "size": 0, "lang_total": 0}
    groups = common.written(groups.fillna(zeros).coalesce(common.slim_files(docs.sparkSession)), "groups")  # a row for each source

    end = lambda name: groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"total_{name}"))
    pairs = groups.select("lang", F.col("source").alias("a"), "size").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    patterns = common.written(terms.groupBy("lang", "own").agg(F.count("*").alias("m")), "patterns")
    made = cells(patterns, pairs).join(end("a"), ["lang", "a"]).join(end("b"), ["lang", "b"]).join(groups.select("lang", "size").distinct(), "lang")
    made = made.withColumn("p", share(F.col("c"), F.col("total_a"), F.col("size"))).withColumn("q", share(F.col("d"), F.col("total_b"), F.col("size")))
    summed = lambda p, q: F.sum(F.coalesce(excess(F.col(p), F.col(q)).cast("decimal(19,0)") * F.col("m").cast("decimal(19,0)"), F.lit(0).cast("decimal(38,0)"))).cast("long")
    made = made.groupBy("lang", "a", "b").agg(summed("p", "q").alias("there"), summed("q", "p").alias("back"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("there").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value")))
    by_pair = made.select("lang", F.explode(sides).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "x.value")

    own = terms.select("lang", F.col("term").alias("item"), F.col("total").alias("term_total"), F.explode("own").alias("x")).select("lang", "item", "term_total", "x.*")
    own = own.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("size"))).withColumn("q", share(F.col("term_total"), F.col("lang_total"), F.col("size")))
    by_term = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", excess(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return by_pair.withColumn("rank", rank).unionByName(by_term.withColumn("rank", rank).where(F.col("rank") <= ranks))


#: DuckDB SQL for audit() over the table documents, by brute force: every source with every word.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, k.term, k.total, coalesce(n.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS p, 1 + ({SCALE}::HUGEINT * (total + 1)) // (sum(total) OVER g + count(*) OVER g) AS q
  FROM grid WINDOW g AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN summed USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= {RANKS}
"""
