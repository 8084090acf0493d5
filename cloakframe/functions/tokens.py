"""Placeholders such as <<PERSON_01>>: their form, and what became of them in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.text import W, places

#: Two digits or more: numbering goes on past 99.
TOKEN = r"<<[A-Z_]+_[0-9]{2,}>>"
ENTITY = r"^<<([A-Z_]+)_[0-9]{2,}>>$"
#: A looser form that a model may leave behind; it reports failures and never resolves them.
_GAP = r"[\s\p{Z}]"
# A remnant without an opening starts at a run of blanks or one blank into it, never deeper, so a long run is read twice at most.
MANGLED = (
    rf"(?<![{W}<])(?:(?:<<|<|\[\[|\[|\{{\{{|⟪){_GAP}*+|(?<!{_GAP}{_GAP}){_GAP}*+)"
    rf"([A-Za-z_]+_\p{{Nd}}{{2,}}){_GAP}*(?:>>|>|\]\]|\]|\}}\}}|⟫)?(?![{W}>])"
)


def token(entity: Column, number: Column) -> Column:
    return F.format_string("<<%s_%02d>>", entity, number)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def entity_of(value: Column) -> Column:
    return F.when(value.rlike(ENTITY), F.regexp_extract(value, ENTITY, 1)).otherwise("?")


def map_tokens(text: Column, of: callable) -> Column:
    """The text with each placeholder t replaced by of(t)."""
    gaps, found = F.split(text, TOKEN, -1), tokens(text)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("token"))
    rebuilt = F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], F.when(x["token"].isNull(), "").otherwise(of(x["token"])))), "")
    return F.when(text.rlike(TOKEN), rebuilt).otherwise(text)


def blanked(text: Column) -> Column:
    """Placeholders as so many spaces; offsets stay."""
    return map_tokens(text, lambda t: F.repeat(F.lit(" "), F.length(t)))


def restored(text: Column, reverse: Column) -> Column:
    """Placeholders as their values; unknown ones stay."""
    return map_tokens(text, lambda t: F.coalesce(F.element_at(reverse, t), t))


def unknown_tokens(text: Column, reverse: Column) -> Column:
    return F.filter(tokens(text), lambda t: F.element_at(reverse, t).isNull())


def altered_tokens(text: Column, reverse: Column, reported: Column) -> Column:
    """Remnants of minted placeholders that a model changed, besides those already reported. Where none was minted, as in most
    texts, nothing is searched."""
    whole = F.regexp_extract_all(text, F.lit(MANGLED), F.lit(0))
    # Letters begin with the body: what stands before it is brackets and blanks.
    pairs = F.transform(whole, lambda w: F.struct(w.alias("whole"), F.regexp_extract(w, r"([A-Za-z_]+_\p{Nd}{2,})", 1).alias("body")))
    canonical = lambda x: F.concat(F.lit("<<"), F.upper(x["body"]), F.lit(">>"))
    hit = F.filter(pairs, lambda x: F.map_contains_key(reverse, canonical(x)) & ~F.array_contains(reported, x["whole"]))
    # A remnant counts once, as it is reported by then.
    found = F.array_distinct(F.transform(hit, lambda x: x["whole"]))
    return F.when(F.size(reverse) == 0, F.array().cast("array<string>")).otherwise(found)


# The names of the modes.
def mangling(value: Column, response: Column) -> Column:
    """How a lost placeholder was altered."""
    inner = F.regexp_replace(F.regexp_replace(value, "^<<", ""), ">>$", "")
    stem = F.regexp_replace(inner, "_[^_]*$", "")
    return (
        F.when(F.contains(response, inner), "delimiters stripped/altered")
        .when(F.contains(F.lower(response), F.lower(inner)), "case changed")
        .when(F.contains(response, stem), "number altered/dropped")
        .otherwise("token absent entirely")
    )


def highlighted(text: Column) -> Column:
    """HTML with the placeholders marked."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, r"(&lt;&lt;[A-Z_]+_[0-9]{2,}&gt;&gt;)", r'<span class="tok">$1</span>')


def token_places(text: Column) -> Column:
    return places(text, TOKEN)
