"""Pattern matches with code-point offsets, and plain text functions; all of them stay in the JVM.

The patterns follow one dialect whatever the engine's locale: a word character is [\\p{L}\\p{N}_], a
digit \\p{Nd}, white space what Unicode and ASCII separators cover."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.schema import FINDINGS

W = r"\p{L}\p{N}_"
S = r"\s\x1c-\x1f\x85\p{Z}"
D = r"\p{Nd}"
#: What a look-behind takes for a word character. Java's sees half of a character beyond U+FFFF, unless the pattern names one
#: itself: this digit is in W already, and makes it see whole ones.
BEHIND = W + "\U0001d7ce"

# The shapes that tier 1 recognises.
# A local part is tried once in a run of its characters, from the run's beginning or the end of the match before: other
# starts of the run end at the same character, and a megabyte without a blank stays linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL = rf"""(?iu)(?<![{W}])(?:https?://|www\.)[^{S}<>"')\]]+|(?iu)(?<![{W}])(?:linkedin\.com|github\.com)/[^{S}<>"')\]]+"""
# A number begins with one of three kinds of characters: looked at first, it spares most places the look behind.
PHONE = (
    rf"(?=[+({D}])(?<![{BEHIND}.])(?:\+{D}{{1,3}}[{S}.\-]?)?(?:\({D}{{1,4}}\)[{S}.\-]?|{D}{{1,4}}[{S}.\-])?"
    rf"{D}{{3}}[{S}.\-]?{D}{{3,4}}(?:[{S}.\-]?{D}{{2,4}})?(?![{W}.])"
)
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
HEADER = rf"^{_LETTER}[{W}'’\-.]*(?: {_LETTER}[{W}'’\-.]*){{1,3}}$"
PHONE_DIGITS = 9
TRAILING = r"(?<![.,;:)])[.,;:)]++$"
#: White space at the end of a line's text.
RIGHT = rf"(?<![{S}])[{S}]++$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once, however often the body names it: plain columns are
    copied into every place that uses them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is evaluated once for each row: filters and projections above a generator
    aren't pushed below it with copies of the expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def none() -> Column:
    return F.array().cast(FINDINGS)


def finding(start: Column, end: Column, entity: Column | str, value: Column, tier: Column | str, score: float = 1.0) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), as_column(entity).alias("entity_type"), value.alias("value"), as_column(tier).alias("tier"), F.lit(score).alias("score"))


#: Items that a fold gathers into one array before it goes on with the next.
GROUP = 256


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind>: what step(state, item) gives beside its next state, item by item.

    An array that grows in a fold is copied at every step. This one grows within a group of GROUP items, and the groups are
    put together at the end, so the cost of a text's matches is in proportion to their number."""

    def within(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def across(acc: Column, group: Column) -> Column:
        inner = F.aggregate(group, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), within)
        return let(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def over(xs: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / GROUP).cast("int")), lambda i: F.slice(xs, i * GROUP + 1, F.lit(GROUP)))
        made = F.aggregate(groups, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), across)
        return F.when(F.size(xs) > 0, F.flatten(made["out"])).otherwise(F.array().cast(f"array<{kind}>"))

    return let(items, over)


#: Code points of the blocks in which parts of a text are looked up.
BLOCK = 4096


def blocks(text: Column) -> Column:
    """The text in blocks: substring() counts from the beginning of its string, so parts of a long one are cut from its blocks."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks_: Column, start: Column, end: Column) -> Column:
    """The part of a text from start to end (exclusive), of its blocks()."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")

    def of(i: Column) -> Column:
        lo, hi = F.greatest(start - i * BLOCK, F.lit(0)), F.least(end - i * BLOCK, F.lit(BLOCK))
        return F.substring(F.get(blocks_, i), lo.cast("int") + 1, (hi - lo).cast("int"))

    # What ends in the first block, as all parts of short texts do, is cut from it as it is.
    short = F.substring(F.get(blocks_, F.lit(0)), start.cast("int") + 1, (end - start).cast("int"))
    whole = F.when(end <= BLOCK, short).otherwise(F.array_join(F.transform(F.sequence(first, last), of), ""))
    return F.when(end > start, whole).otherwise("")


def places(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """array<struct<start, value>> of the matches; start counts code points.

    split() leaves the text between matches and regexp_extract_all() the matches themselves; the
    running length of both is the offset. Texts without a match skip the fold."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    shown = values if not group else F.regexp_extract_all(text, pattern, F.lit(group))

    def zipped(whole: Column) -> Column:
        return F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), (whole if not group else shown).alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        return start + F.length(x["whole"]), F.struct(start.alias("start"), x["value"].alias("value"))

    kind = "struct<start:int,value:string>"
    walked = running(let(values, zipped), F.lit(0), step, kind)
    return F.when(F.regexp_like(text, pattern), walked).otherwise(F.array().cast(f"array<{kind}>"))


PATTERNS = {"EMAIL": EMAIL, "URL": URL, "PHONE": PHONE}
#: What every match of a pattern holds, one of them: plain search is much cheaper than the pattern, and few texts have any.
HELD = {"EMAIL": ("@",), "URL": ("://", *(a + b + "." for a in "wW" for b in "wW"), *(a + b + "/" for a in "oO" for b in "mM"))}


def matches(text: Column, entity: str) -> Column:
    """array<struct<start, value>> of a pattern's matches, which texts are not searched for that can't have any."""
    found = places(text, PATTERNS[entity])
    if entity not in HELD:
        return found
    some = reduce(or_, (F.contains(text, F.lit(part)) for part in HELD[entity]))
    return F.when(some, found).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def pattern_findings(text: Column, *kinds: str) -> Column:
    """Tier 1: e-mail addresses, URLs and phone numbers, in this order; or only some kinds."""

    def of(entity: str) -> Column:
        found = matches(text, entity)
        if entity == "PHONE":
            found = F.filter(found, lambda x: F.length(F.regexp_replace(x["value"], rf"[^{D}]", "")) >= PHONE_DIGITS)

        def one(x: Column) -> Column:
            value = F.regexp_replace(x["value"], TRAILING, "")
            return finding(x["start"], x["start"] + F.length(value), entity, value, "regex")

        return F.transform(found, one)

    return F.concat(*(of(k) for k in PATTERNS if not kinds or k in kinds))


def header_findings(text: Column) -> Column:
    """Tier 0 of plain text: the first line that isn't blank, if it looks like a name.

    It begins at the first character that isn't white space, so no other line is looked at."""
    rest = F.when(F.left(text, F.lit(1)).rlike(f"[{S}]"), F.regexp_replace(text, rf"\A[{S}]+", "")).otherwise(text)
    head = lambda r: F.struct(F.substring_index(r, "\n", 1).alias("line"), (F.length(text) - F.length(r)).alias("start"))
    return let(let(rest, head), lambda h: let(F.struct(F.regexp_replace(h["line"], RIGHT, "").alias("name"), h["start"].alias("start")), _header_of))


def _header_of(head: Column) -> Column:
    name, start = head["name"], head["start"]
    # Superscripts count as digits as well.
    good = (F.length(name) > 0) & ~name.rlike(r"[,@\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]") & name.rlike(HEADER)
    return F.when(good, F.array(finding(start, start + F.length(name), "PERSON", name, "header"))).otherwise(none())


# Fields of a structured document that are personal by where they stand.
FIELD_RULES = (
    (r"^basics\.name$", "PERSON"),
    (r"^basics\.email$", "EMAIL"),
    (r"^basics\.phone$", "PHONE"),
    (r"^basics\.(?:url|website)$", "URL"),
    (r"^basics\.image$", "IDENTIFIER"),
    (r"^basics\.location\.address$", "ADDRESS"),
    (r"^basics\.location\.postalCode$", "POSTAL"),
    (r"^basics\.location\.(?:city|region)$", "LOCATION"),
    (r"^basics\.profiles\[\d+\]\.username$", "HANDLE"),
    (r"^basics\.profiles\[\d+\]\.url$", "URL"),
)
#: What every path that a rule names begins with.
FIELD_ROOT = "basics."


def field_type(path: Column) -> Column:
    """Entity type of a field by its path; null where no rule holds. Paths outside FIELD_ROOT are not held against the rules."""
    out = F.when(path.isNull() | ~F.startswith(path, F.lit(FIELD_ROOT)), F.lit(None).cast("string"))
    for pattern, entity in FIELD_RULES:
        out = out.when(path.rlike(pattern), entity)
    return out


def field_findings(text: Column, spans: Column) -> Column:
    """Tier 0 of structured documents: whole values of personal fields."""

    def of(parts: Column) -> Column:
        typed = F.transform(spans, lambda s: F.struct(s.alias("s"), field_type(s["path"]).alias("type")))  # a path's rules are tried once
        own = F.transform(F.filter(typed, lambda x: x["type"].isNotNull()), lambda x: finding(x["s"]["start"], x["s"]["end"], x["type"], between(parts, x["s"]["start"], x["s"]["end"]), "field"))
        return F.filter(own, lambda f: ~f["value"].rlike(rf"^[{S}]*$"))

    return let(blocks(text), of)


DERIVED_LENGTH = 8


def derivatives(name: Column) -> Column:
    """Handles that people build from a name: eight joins of its first and last alphabetic part."""
    return let(F.filter(F.split(name, rf"[{S}.]+", -1), lambda w: w.rlike(r"^\p{L}+$")), _forms)


def _forms(words: Column) -> Column:
    first, last = F.lower(F.element_at(words, 1)), F.lower(F.element_at(words, -1))
    f, l = F.substring(first, 1, 1), F.substring(last, 1, 1)  # noqa: E741
    forms = F.array(
        F.concat(first, last), F.concat(f, last), F.concat(first, l), F.concat(last, first),
        F.concat_ws(".", first, last), F.concat_ws("_", first, last), F.concat_ws("-", first, last), F.concat_ws(".", f, last),
    )
    long = F.filter(F.array_distinct(forms), lambda x: F.length(x) >= DERIVED_LENGTH)
    return F.when(F.size(words) >= 2, long).otherwise(F.array().cast("array<string>"))


def quoted(value: Column) -> Column:
    """A pattern that matches the value literally."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def derivative_findings(text: Column, names: Column) -> Column:
    """Tier 3: handles derived from the names, wherever they stand."""
    return let(derived_forms(names), lambda forms: let(derivative_pattern(forms), lambda p: pattern_hits(text, p)))


def derived_forms(names: Column) -> Column:
    return longest_first(F.array_distinct(F.flatten(F.transform(names, derivatives))))


def derivative_pattern(forms: Column) -> Column:
    """One pattern for all forms; where there are none, one that never matches."""
    some = F.concat(F.lit(f"(?iu)(?<![{BEHIND}.])(?:"), F.array_join(F.transform(forms, quoted), "|"), F.lit(f")(?![{W}])"))
    return F.when(F.size(forms) > 0, some).otherwise(F.lit("(?!)"))


def pattern_hits(text: Column, pattern: Column) -> Column:
    """Tier 3 findings of a pattern from derivative_pattern()."""
    found = places(text, pattern)
    return F.transform(found, lambda x: finding(x["start"], x["start"] + F.length(x["value"]), "HANDLE", x["value"], "derivative"))


def longest_first(values: Column) -> Column:
    """By length, the longest first; ties keep their order."""
    keyed = F.transform(values, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def normalise_columns(text: Column) -> Column:
    """Layout text to lines: wide gaps break the line, narrow ones are one space, no blank runs."""
    text = F.regexp_replace(text, " {6,}", "\n")
    text = F.regexp_replace(text, " {2,5}", " ")
    blank = rf"[{S}&&[^\n]]"
    text = F.regexp_replace(text, rf"(?<!{blank}){blank}++(?=\n|$(?![\s\S]))", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"^\n+", ""), r"(?<!\n)\n++$(?![\s\S])", "")


def line_number(text: Column, at: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.regexp_count(F.left(text, at), F.lit("\n")) + 1


def occurrences(text: Column, value: Column) -> Column:
    """How often a value stands in a text, without overlaps."""
    return F.when(F.length(value) > 0, F.size(F.split(text, quoted(value), -1)) - 1).otherwise(0)


def nth_place(text: Column, value: Column, n: Column) -> Column:
    """0-based offset of the n-th occurrence of a value, without overlaps; null where there are fewer."""

    def at(parts: Column) -> Column:
        before = F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda acc, p: acc + F.length(p))
        return F.when((n > 0) & (F.size(parts) > n), before + (n - 1) * F.length(value))

    return F.when(F.length(value) > 0, let(F.split(text, quoted(value), -1), at))


# Markers of fonts whose characters are icons.
ICON_FONTS = ("fontawesome", "wingding", "dingbat", "glyphicon", "materialicons", "octicon", "entypo", "ionicons")


def strip_icons(text: Column, runs: Column) -> Column:
    """struct<text, removed, ambiguous>: runs (font, text) of icon fonts go where they occur once."""
    icons = F.filter(runs, lambda r: F.lower(r["font"]).rlike("|".join(ICON_FONTS)))

    def step(acc: Column, r: Column) -> Column:
        n = occurrences(acc["text"], r["text"])
        return F.struct(
            F.when(n == 1, F.replace(acc["text"], r["text"], F.lit(""))).otherwise(acc["text"]).alias("text"),
            (acc["removed"] + F.when(n == 1, 1).otherwise(0)).alias("removed"),
            (acc["ambiguous"] + F.when(n > 1, 1).otherwise(0)).alias("ambiguous"),
        )

    return F.aggregate(icons, F.struct(text.alias("text"), F.lit(0).alias("removed"), F.lit(0).alias("ambiguous")), step)


def metadata_block(metadata: Column) -> Column:
    """The non-blank entries of a metadata map as a text block; null where there are none."""
    # The keys that are shown, in their order.
    keys = F.array(*map(F.lit, ("Author", "Title", "Subject", "Creator", "Producer")))
    rows = F.filter(F.transform(keys, lambda k: F.struct(k.alias("k"), F.trim(F.element_at(metadata, k)).alias("v"))), lambda x: F.length(x["v"]) > 0)
    lines = F.transform(rows, lambda x: F.concat_ws(": ", x["k"], x["v"]))
    return F.when(F.size(lines) > 0, F.concat(F.lit("[PDF METADATA]\n"), F.array_join(lines, "\n")))
