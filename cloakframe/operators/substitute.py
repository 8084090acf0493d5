"""Substitution of values by placeholders, the leak check, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import automaton, tokens
from cloakframe.functions.text import W, barrier, between, blocks, let, longest_first, occurrences, quoted, running
from cloakframe.schema import SPANS

#: Private characters that mark substituted values while a text is taken apart.
OPEN, CLOSE = "\ue000", "\ue001"
MARKS = f"[{OPEN}{CLOSE}]"
#: Values that an alternation tries one by one; rows with more go through an automaton, which matches the same.
MANY = 64
#: Alternation of no value.
NEVER = "(?!)"


def guarded(value: Column) -> Column:
    """A literal pattern that doesn't start or end inside a word, where the value's own ends are words."""
    left = F.when(value.rlike(f"^[{W}]"), f"(?<![{W}])").otherwise("")
    right = F.when(value.rlike(f"[{W}]$"), f"(?![{W}])").otherwise("")
    return F.concat(left, quoted(value), right)


def alternation(values: Column) -> Column:
    """One pattern for all values, the longest first."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(longest_first(values), guarded), "|")).otherwise(NEVER)


def marked_text(text: Column, pattern: Column) -> Column:
    """The text with every match between OPEN and CLOSE, found in one pass."""
    return F.regexp_replace(text, pattern, F.lit(f"{OPEN}$0{CLOSE}"))


def _replaced(marked: Column, mapping: Column) -> Column:
    """Marked matches as their placeholders; null if one isn't in the mapping."""
    parts = F.transform(F.split(marked, MARKS, -1), lambda p, i: F.when(i % 2 == 0, p).otherwise(F.element_at(mapping, p)))
    return let(parts, lambda xs: F.when(~F.exists(xs, lambda x: x.isNull()), F.array_join(xs, "")))


def with_substitution(df: DataFrame, text: Column, values: Column, mapping: Column, spans: Column | None = None) -> DataFrame:
    """df with `_s`, a struct<text, n, leaks>: every occurrence of a value as its placeholder, their number, and the values that
    still stand in the result; of structured documents inside value spans only, each span on its own. text is null where the
    mapping has a gap.

    Rows of up to MANY values stay in the JVM and are evaluated step by step. Others pass through an automaton in Arrow batches;
    of the rest, nulls are passed."""
    few = (F.size(values) > 0) & (F.size(values) <= MANY)
    out = barrier(df, "_p", F.when(few, alternation(values)).otherwise(NEVER))
    out = barrier(out, "_m", F.when(few, _marked(text, F.col("_p"), spans)).otherwise(text))
    out = barrier(out, "_r", F.when(few, F.struct(_replaced(F.col("_m"), mapping).alias("text"), F.regexp_count("_m", F.lit(OPEN)).alias("n"))).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n"))))
    left = F.when(few & F.col("_r.text").isNotNull(), leaks(F.col("_r.text"), values)).otherwise(F.array().cast("array<string>"))
    here = F.struct(F.col("_r.text").alias("text"), F.col("_r.n").alias("n"), left.alias("leaks"))
    many = F.size(values) > MANY
    given = [F.when(many, c) for c in (text, values, mapping, F.lit(None).cast(SPANS) if spans is None else spans)]
    return barrier(out.withColumn("_a", automaton.substituted(*given)), "_s", F.when(many, F.col("_a")).otherwise(here)).drop("_p", "_m", "_r", "_a")


def _marked(text: Column, pattern: Column, spans: Column | None) -> Column:
    if spans is None:
        return marked_text(text, pattern)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"))))
    kind = "struct<a:int,b:int,e:int>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, F.when(s["s"] < at, at).otherwise(s["e"])), F.when(s["s"] >= at, F.struct(at.alias("a"), s["s"].alias("b"), s["e"].alias("e")))

    def joined(cuts: Column, parts: Column) -> Column:
        pieces = F.transform(cuts, lambda c: F.concat(between(parts, c["a"], c["b"]), marked_text(between(parts, c["b"], c["e"]), pattern)))
        return F.concat(F.array_join(pieces, ""), between(parts, F.coalesce(F.element_at(cuts, -1)["e"], F.lit(0)), F.length(text)))

    own = F.filter(running(ordered, F.lit(0), step, kind), lambda c: c.isNotNull())
    return let(own, lambda cuts: F.when(F.size(cuts) > 0, let(blocks(text), lambda parts: joined(cuts, parts))).otherwise(text))


def leaks(text: Column, values: Column) -> Column:
    """Values that still stand in a text, placeholders aside; keys of structured documents count."""
    return F.when(F.size(values) > 0, let(tokens.blanked(text), lambda blank: F.filter(values, lambda v: F.contains(blank, v)))).otherwise(F.array().cast("array<string>"))


def rehydrated(text: Column, reverse: Column) -> Column:
    """struct<text, unmatched, dropped>: values restored; unknown and altered placeholders are
    reported, and so are minted ones of which nothing came back."""
    return let(
        F.struct(tokens.restored(text, reverse).alias("out"), tokens.unknown_tokens(text, reverse).alias("unknown"), tokens.tokens(text).alias("present")),
        lambda x: let(tokens.altered_tokens(x["out"], reverse, x["unknown"]), lambda altered: _reported(x["out"], x["unknown"], altered, x["present"], reverse)),
    )


def _reported(out: Column, unknown: Column, altered: Column, present: Column, reverse: Column) -> Column:
    seen = F.transform(altered, lambda a: F.concat(F.lit("<<"), F.upper(F.regexp_extract(a, r"([A-Za-z_]+_\p{Nd}{2,})", 1)), F.lit(">>")))
    dropped = F.array_except(F.map_keys(reverse), F.concat(present, seen))
    return F.struct(out.alias("text"), F.concat(unknown, altered).alias("unmatched"), F.array_sort(dropped).alias("dropped"))


def restores(text: Column, original: Column) -> Column:
    return text.eqNullSafe(original)


def resolvable(text: Column, value: Column, occurrence: Column) -> Column:
    """Whether a labelled occurrence exists."""
    return occurrences(text, value) >= F.coalesce(occurrence, F.lit(1))
