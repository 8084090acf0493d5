"""Measures over tables of documents: preservation of placeholders, recall of labels, verdicts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import tokens
from cloakframe.functions.text import barrier, let, nth_place, quoted
from cloakframe.operators.substitute import resolvable


def token_multiset(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): the placeholders of each text. The key leads every later shuffle."""
    return df.select(key, F.explode(tokens.tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def preservation(df: DataFrame, key: str, sent: str, returned: str) -> DataFrame:
    """(key, token, entity, sent, preserved, lost, mode) of each text's placeholders.

    The counts of both texts come from one row's two arrays, so nothing is joined."""
    both = df.select(key, F.col(returned).alias("_r"), tokens.tokens(F.col(sent)).alias("_s"), tokens.tokens(F.col(returned)).alias("_b"))
    each = both.select(key, "_r", "_s", "_b", F.explode(F.array_distinct("_s")).alias("token"))
    n = lambda c: F.size(F.filter(F.col(c), lambda t: t == F.col("token"))).cast("long")
    counted = each.select(key, "token", tokens.entity_of(F.col("token")).alias("entity"), n("_s").alias("sent"), F.least(n("_s"), n("_b")).alias("preserved"), "_r")
    lost = F.col("sent") - F.col("preserved")
    return counted.select(key, "token", "entity", "sent", "preserved", lost.alias("lost"), F.when(lost > 0, tokens.mangling(F.col("token"), F.col("_r"))).alias("mode"))


def by_entity(preserved: DataFrame) -> DataFrame:
    return preserved.groupBy("entity").agg(F.sum("sent").alias("sent"), F.sum("preserved").alias("preserved"))


def by_mode(preserved: DataFrame) -> DataFrame:
    return preserved.where("lost > 0").groupBy("mode").agg(F.sum("lost").alias("lost"))


def rate(preserved: DataFrame, unmatched: DataFrame) -> DataFrame:
    """One row: sent, preserved, percent (0 where nothing was sent), unmatched.

    unmatched: rows (n). Both sides are one row, from partial sums."""
    sums = preserved.agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum("preserved"), F.lit(0)).alias("preserved"))
    rest = unmatched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unmatched"))
    percent = F.when(F.col("sent") > 0, 100.0 * F.col("preserved") / F.col("sent")).otherwise(0.0)
    return sums.join(rest).select("sent", "preserved", percent.alias("percent"), "unmatched")


def verdict(results: DataFrame) -> DataFrame:
    """One row: 2 after an error, 1 after a loss or an unmatched placeholder, else 0. Rows (error, lost, unmatched)."""
    return results.agg(worst(F.col("error"), F.lit(True)).alias("verdict"))


def worst(error: Column, own: Column) -> Column:
    """The verdict over the rows (lost, unmatched) that are one's own, as an aggregate: several verdicts are one pass."""
    each = F.when(error.isNotNull(), 2).when((F.col("lost") > 0) | (F.col("unmatched") > 0), 1).otherwise(0)
    return F.coalesce(F.max(F.when(own, each)), F.lit(0))


def line_parity(before: Column, after: Column) -> Column:
    count = lambda c: F.regexp_count(c, F.lit("\n"))
    return count(before) == count(after)


def recall(labels: DataFrame, anonymized: DataFrame) -> DataFrame:
    """(doc_id, total, missed, recall) of gating labels (doc_id, value, phase) in texts (doc_id, text)."""
    gating = labels.where("phase = 1").join(anonymized.select("doc_id", "text"), "doc_id")
    missed = F.sum(F.contains("text", "value").cast("long"))
    grouped = gating.groupBy("doc_id").agg(F.count("*").alias("total"), missed.alias("missed"))
    return grouped.withColumn("recall", (F.col("total") - F.col("missed")) / F.col("total"))


def resolvability(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """labels with `resolves`, whether the labelled occurrence stands in the document, and `place`, where."""
    joined = labels.join(documents.select("doc_id", "text"), "doc_id")
    place = nth_place(F.col("text"), F.col("value"), F.coalesce("occurrence", F.lit(1)))
    return joined.withColumn("resolves", resolvable(F.col("text"), F.col("value"), F.col("occurrence"))).withColumn("place", place).drop("text")


#: Between white space, with at most one mark behind: what stands inside an address or a number is no word.
_FREE = (r"(?<![^\x20\x09-\x0D])", r"(?=[.,;:!?]?(?![^\x20\x09-\x0D]))")


def free_words(text: Column) -> Column:
    """Words of three letters or more that stand free in a text, with repeats."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{_FREE[0]}\p{{L}}{{3,}}+{_FREE[1]}"), F.lit(0))


def replaced(values: Column, text: Column, anonymized: Column) -> Column:
    """Those of an array of values that stand free in the anonymized text less often than in the text."""
    pattern = lambda v: F.concat(F.lit(_FREE[0]), quoted(v), F.lit(_FREE[1]))
    count = lambda t, v: F.regexp_count(F.coalesce(t, F.lit("")), pattern(v))
    # Plain counts come first, as a pattern for each value is dear: a lost value is lost outside the placeholders too.
    plain = lambda t, v: F.length(F.replace(t, v, F.lit(""))) - F.length(t)
    less = lambda clear, v: (plain(text, v) < plain(clear, v)) & (count(text, v) > count(anonymized, v))
    clear = F.regexp_replace(F.coalesce(anonymized, F.lit("")), tokens.TOKEN, " ")
    lost = let(clear, lambda c: F.filter(values, lambda v: (F.length(v) > 0) & less(c, v)))
    return F.when(text.eqNullSafe(anonymized), F.array().cast("array<string>")).otherwise(lost)


_FREE_WORD = regex.compile(rf"{_FREE[0]}\p{{L}}{{3,}}+{_FREE[1]}")


def word_losses(made: DataFrame, key: str) -> DataFrame:
    """(key, w, lost) of (key, text, anonymized): the distinct free words of each text, and whether each stands free less often in the
    anonymized text (null: as the text); and a row without a word for each. Words are counted in Arrow batches, as a fold in
    the JVM has no counter that grows in place."""
    kind = made.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, lost = [], [], []
            for i, (text, anonymized) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                before = Counter(_FREE_WORD.findall(text.as_py() or ""))
                after = Counter(_FREE_WORD.findall(anonymized.as_py())) if anonymized.is_valid else before
                rows += [i] * (len(before) + 1)
                words += [None, *before]
                lost += [False, *(n > after[w] for w, n in before.items())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(words, pa.string()), pa.array(lost, pa.bool_())], [key, "w", "lost"])

    return made.select(key, "text", "anonymized").mapInArrow(run, f"`{key}` {kind}, w string, lost boolean")


def replaced_terms(made: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_controls, n_replaced, replaced) of texts (key, text, anonymized): which terms (w) stand free in a text, and which of
    them stand there less often after substitution.

    Words are counted within their row, so a text passes on its distinct words alone, and those meet the terms by an equality.
    Rows of one key count as one text; a text without a term has a row of zeros."""
    changed = F.when(~F.col("text").eqNullSafe(F.col("anonymized")), F.coalesce("anonymized", F.lit("")))
    rows = word_losses(made.select(key, "text", changed.alias("anonymized")), key)
    known = terms.select(F.col("w").alias("_w")).distinct()
    # One join, so that the texts are made once. What keeps a text without terms meets no word, and each goes its own way.
    own = F.coalesce("w", F.concat(F.lit("#"), F.col(key).cast("string")))
    met = rows.join(known, own == F.col("_w"), "left").where("w is null or _w is not null")
    each = met.groupBy(key, "w").agg(F.max("lost").alias("lost"))
    lost = F.array_sort(F.collect_list(F.when(F.col("lost"), F.col("w"))))
    out = each.groupBy(key).agg(F.count("w").alias("n_controls"), lost.alias("replaced"))
    return out.select(key, "n_controls", F.size("replaced").cast("long").alias("n_replaced"), "replaced")


def controls_kept(controls: DataFrame, made: DataFrame) -> DataFrame:
    """(doc_id, n_controls, n_replaced, replaced) of values that must stay in clear, rows (doc_id, value),
    in texts (doc_id, text, anonymized): over-detection by document."""
    each = controls.groupBy("doc_id").agg(F.array_sort(F.collect_set("value")).alias("controls"))
    return control_counts(made.select("doc_id", "text", "anonymized").join(each, "doc_id"))


def control_counts(rows: DataFrame) -> DataFrame:
    """The same of rows that hold their `controls` as an array."""
    rows = barrier(rows, "replaced", replaced(F.col("controls"), F.col("text"), F.col("anonymized")))
    return rows.select("doc_id", F.size("controls").cast("long").alias("n_controls"), F.size("replaced").cast("long").alias("n_replaced"), "replaced")


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels by phase and by type, context and subject each: one pass with grouping sets."""
    sets = labels.groupingSets([["phase", "type"], ["phase", "context"], ["phase", "subject"], ["phase"]], "phase", "type", "context", "subject")
    return sets.agg(F.count("*").alias("n"))


def tier_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("tier").agg(F.count("*").alias("n"))
