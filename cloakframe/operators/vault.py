"""The vault: which placeholder stands for which value.

In a row it is an array of entries in the order of numbering; as a table it is kept apart from
what leaves the engine. A session's numbering depends on its own rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.text import let
from cloakframe.functions.tokens import token

ENTRY = "struct<value:string,entity_type:string,token:string>"


def entries(findings: Column) -> Column:
    """Entries of disjoint findings in document order: a value's first finding fixes its type, and
    each type counts its distinct values."""
    return let(findings, _entries)


def _entries(findings: Column) -> Column:
    # Sorted by value and place, the first row of each value has its type: no value looks through all findings.
    placed = F.array_sort(F.transform(findings, lambda f, i: F.struct(f["value"].alias("value"), i.alias("at"), f["entity_type"].alias("entity_type"))))
    return let(placed, lambda rows: let(F.filter(rows, lambda x, i: (i == 0) | ~F.get(rows, i - 1)["value"].eqNullSafe(x["value"])), _numbered))


def _numbered(firsts: Column) -> Column:
    def of(kind: Column) -> Column:
        own = F.array_sort(F.transform(F.filter(firsts, lambda x: x["entity_type"] == kind), lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value"))))
        return F.transform(own, lambda x, i: F.struct(x["at"].alias("at"), x["value"].alias("value"), kind.alias("entity_type"), token(kind, i + 1).alias("token")))

    kinds = F.array_distinct(F.transform(firsts, lambda x: x["entity_type"]))
    ordered = F.array_sort(F.flatten(F.transform(kinds, of)))
    return F.transform(ordered, lambda x: F.struct(x["value"].alias("value"), x["entity_type"].alias("entity_type"), x["token"].alias("token")))


def forward(entries_: Column) -> Column:
    return F.map_from_arrays(F.transform(entries_, lambda e: e["value"]), F.transform(entries_, lambda e: e["token"]))


def reverse(entries_: Column) -> Column:
    return F.map_from_arrays(F.transform(entries_, lambda e: e["token"]), F.transform(entries_, lambda e: e["value"]))


def numbered(findings: DataFrame, session: str, order: list[str]) -> DataFrame:
    """(session, value, entity_type, ord, token) of a table of findings whose sessions span rows.

    Two windows with the same leading key: Spark sorts each session once more, but shuffles the
    distinct values only, as the first occurrence is found by a partial aggregate."""
    place = F.struct(*order)
    firsts = findings.groupBy(session, "value").agg(F.min(F.struct(place.alias("at"), F.col("entity_type").alias("entity_type"))).alias("first"))
    numbering = Window.partitionBy(session, "entity_type").orderBy("at", "value")
    rows = firsts.select(session, "value", F.col("first.entity_type").alias("entity_type"), F.col("first.at").alias("at"))
    rows = rows.withColumn("ord", F.row_number().over(numbering))
    return rows.select(session, "value", "entity_type", "ord", token(F.col("entity_type"), F.col("ord")).alias("token"))


def extended(stored: DataFrame, findings: DataFrame, session: str, order: list[str]) -> DataFrame:
    """The vault (session, value, entity_type, ord, token) of earlier runs with the entries that new findings add.

    A value that a session has keeps its token and its first type; new ones are numbered on from the highest number of their
    session and type. Minting a session's findings in parts, in their order, gives what minting them at once gives."""
    fresh = findings.join(stored.select(session, "value"), [session, "value"], "left_anti")
    new = numbered(fresh, session, order).drop("token")
    ahead = stored.groupBy(session, "entity_type").agg(F.max("ord").alias("_ahead"))
    new = new.join(ahead, [session, "entity_type"], "left").withColumn("ord", F.col("ord") + F.coalesce("_ahead", F.lit(0)))
    new = new.select(session, "value", "entity_type", "ord", token(F.col("entity_type"), F.col("ord")).alias("token"))
    return stored.select(*new.columns).unionByName(new.select(*(F.col(c).cast(stored.schema[c].dataType).alias(c) for c in new.columns)))


def save(vault: DataFrame, table: str, session: str, buckets: int = 64) -> None:
    """Store a vault by session: what extended() joins with it then moves the findings alone."""
    vault.write.mode("overwrite").bucketBy(buckets, session).sortBy(session).saveAsTable(table)


def create(vault: DataFrame, sessions: DataFrame) -> DataFrame:
    """The vault with the given sessions (session_id) emptied, as new ones replace old ones."""
    return vault.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


destroy = create


def destroyed(vault: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, removed): whether destroy() finds something of each requested session."""
    known = vault.select("session_id").distinct().withColumn("removed", F.lit(True))
    return sessions.select("session_id").distinct().join(known, "session_id", "left").select("session_id", F.coalesce("removed", F.lit(False)).alias("removed"))


def live(vault: DataFrame) -> DataFrame:
    """One row: the number of sessions."""
    return vault.agg(F.countDistinct("session_id").alias("n_sessions"))


def missing(vault: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requested sessions that the vault doesn't have."""
    return sessions.select("session_id").distinct().join(vault.select("session_id").distinct(), "session_id", "left_anti")


def summary(vault: DataFrame) -> DataFrame:
    """Placeholders with the length of their values only."""
    return vault.select("session_id", "token", F.length("value").alias("value_length"))
