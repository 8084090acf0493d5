"""Detection: tiers 0 to 3 of a document, merged. Everything is one projection, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text as T
from cloakframe.operators.overlap import clipped, resolved

#: The model's findings that count, and the least score.
NER_ENTITIES, NER_SCORE = ("PERSON", "LOCATION"), 0.5


def accepted(findings: Column, least: float = NER_SCORE) -> Column:
    """Tier 2: findings of a language model that pass the list of entities and the threshold."""
    return F.filter(findings, lambda f: f["entity_type"].isin(*NER_ENTITIES) & (f["score"] >= least))


def persons(findings: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(findings, lambda f: f["entity_type"] == "PERSON"), lambda f: f["value"]))


def with_findings(df: DataFrame, text: Column, spans: Column | None = None, ner: Column | None = None, least: float = NER_SCORE) -> DataFrame:
    """df with `findings`, as detect() has them, but evaluated tier by tier: nested bindings of
    large expressions take the planner longer than the rows take the executors."""
    structure = T.header_findings(text) if spans is None else T.field_findings(text, spans)
    blank = text.isNull() | text.rlike(rf"^[{T.S}]*$")
    base = F.concat(structure, T.pattern_findings(text), *([] if ner is None else [accepted(ner, least)]))
    out = T.barrier(df, "_base", F.when(blank, T.none()).otherwise(base))
    out = T.barrier(out, "_forms", T.derived_forms(persons(F.col("_base"))))
    out = T.barrier(out, "_pattern", T.derivative_pattern(F.col("_forms")))
    found = F.concat("_base", T.pattern_hits(text, F.col("_pattern")))
    return T.barrier(out, "findings", resolved(found if spans is None else clipped(found, spans))).drop("_base", "_forms", "_pattern")


def candidates(text: Column, spans: Column | None = None, ner: Column | None = None) -> Column:
    """All tiers' findings, in the order that breaks ties."""
    structure = T.header_findings(text) if spans is None else T.field_findings(text, spans)
    found = F.concat(structure, T.pattern_findings(text), *([] if ner is None else [accepted(ner)]))
    return T.let(found, lambda f: F.concat(f, T.derivative_findings(text, persons(f))))


def detect(text: Column, spans: Column | None = None, ner: Column | None = None) -> Column:
    """Findings of a text, disjoint and ordered; of structured documents within value spans only."""
    found = candidates(text, spans, ner)
    found = resolved(found if spans is None else clipped(found, spans))
    blank = text.isNull() | text.rlike(rf"^[{T.S}]*$")
    return F.when(blank, T.none()).otherwise(found)
