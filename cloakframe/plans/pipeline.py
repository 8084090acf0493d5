"""The document pipeline: detect, substitute, check for leaks, send, restore.

A session is one document here; its vault is an array in the row until split() parts the rows
that may leave from those that may not. What leaves carries no value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.config import Options
from cloakframe.functions import tokens
from cloakframe.functions.text import S, barrier, let
from cloakframe.operators import detect, substitute, vault
from cloakframe.operators import ner as ner_tier
from cloakframe.sources import model, scratch


def session_id(key: Column) -> Column:
    """Depends on the document alone, so a repeated task makes the same one."""
    return F.sha2(F.concat(F.lit("session:"), key.cast("string")), 256)


def anonymized(docs: DataFrame, key: str = "doc_id", text: str = "text", spans: str | None = None, ner: str | None = None, least: float = detect.NER_SCORE) -> DataFrame:
    """docs with session_id, findings, vault, anonymized, n_findings, n_tokens, n_unique, n_replaced, extra, leaks
    and status: ok, no_findings, or why the row is blocked. One projection: no shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = detect.with_findings(docs.withColumn("session_id", session_id(F.col(key))), body, F.col(spans) if spans else None, F.col(ner) if ner else None, least)
    entered = barrier(found, "vault", vault.entries(F.col("findings")))
    values = F.transform("vault", lambda e: e["value"])
    made = substitute.with_substitution(entered, body, values, vault.forward(F.col("vault")), F.col(spans) if spans else None)
    out = made.withColumn("anonymized", F.col("_s.text")).withColumn("n_replaced", F.col("_s.n")).withColumn("leaks", F.col("_s.leaks")).drop("_s")
    failed = (F.col("ner_status") == "failed") if "ner_status" in docs.columns else F.lit(False)
    status = (
        F.when(body.rlike(rf"^[{S}]*$"), "blank")
        .when(failed, "ner_failed")
        .when(F.contains(body, F.lit(substitute.OPEN)) | F.contains(body, F.lit(substitute.CLOSE)), "reserved_character")
        .when(body.rlike(tokens.TOKEN), "token_in_source")
        .when(F.col("anonymized").isNull(), "substitution_failed")
        .when(F.size("leaks") > 0, "leak")
        .when(F.size("findings") == 0, "no_findings")
        .otherwise("ok")
    )
    n = F.size("findings")
    return out.select(
        "*",
        n.alias("n_findings"),
        tokens.token_count(F.col("anonymized")).alias("n_tokens"),
        F.size("vault").alias("n_unique"),
        F.greatest(F.col("n_replaced") - n, F.lit(0)).alias("extra"),
        status.alias("status"),
    )


def split(made: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleared, blocked, vault): rows (key, session_id, text) that may leave; rows (key, status, leak_count)
    that may not; and the private table (session_id, token, value, entity_type)."""
    fine = F.col("status").isin("ok", "no_findings")
    cleared = made.where(fine).select(key, "session_id", F.col("anonymized").alias("text"))
    blocked = made.where(~fine).select(key, "status", F.size("leaks").alias("leak_count"))
    private = made.select("session_id", F.explode("vault").alias("e")).select("session_id", "e.token", "e.value", "e.entity_type")
    return cleared, blocked, private


def rehydrated(answers: DataFrame, private: DataFrame, session: str = "session_id") -> DataFrame:
    """answers (session, text, ...) with rehydrated, unmatched, dropped_tokens and ok. One shuffle on the session."""
    maps = private.groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_r"))
    none = F.create_map().cast("map<string,string>")
    joined = barrier(answers.join(maps, session, "left"), "_o", let(F.coalesce("_r", none), lambda r: substitute.rehydrated(F.col("text"), r)))
    return joined.select("*", F.col("_o.text").alias("rehydrated"), F.col("_o.unmatched").alias("unmatched"), F.col("_o.dropped").alias("dropped_tokens"), (F.size("_o.unmatched") == 0).alias("ok")).drop("_r", "_o")


def run(docs: DataFrame, options: Options, factory: Callable[[], model.Transport], key: str = "doc_id", text: str = "text", spans: str | None = None, analyzer: Callable[[], ner_tier.Analyzer] | None = None, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, blocked): the whole round trip of each document that may leave.

    With options.ner, the analyzer's findings of at least options.ner_score count as the model tier; a row on which it failed is
    blocked unless options.ner_lenient, and without an analyzer the other tiers go on alone. Detection and the exchange run once, as no action on the
    results may send a text again. What holds values in clear, the vault, lies in the shared folder while this function runs and is
    deleted before it returns, also if it fails; so are the answers, unless `ledger` names a folder to keep them in. Both
    results are tables of the shared folder: results hold the restored texts, delete them with scratch.discard()."""
    spark = docs.sparkSession
    passing: list[DataFrame] = []
    answered = None
    try:
        if options.ner:
            docs = ner_tier.with_ner(docs, analyzer, text)
            if options.ner_lenient:
                docs = docs.drop("ner_status")
        made = anonymized(docs, key, text, spans, "ner" if options.ner else None, options.ner_score)
        made = scratch.written(made.select(key, "session_id", "status", "leaks", "anonymized", "vault"), "made")
        passing.append(made)
        cleared, blocked, private = split(made, key)
        answered = model.exchange(cleared, key, "text", options, factory, ledger)
        results = scratch.written(rehydrated(answered.withColumn("session_id", session_id(F.col(key))), private), "results")
        return results, scratch.written(blocked, "blocked")
    finally:
        for table in passing:
            scratch.discard(table)
        if ledger is None and answered is not None and hasattr(answered, "_ledger"):
            scratch.delete(spark, answered._ledger)


def write_report(made: DataFrame, path: str, key: str = "doc_id") -> None:
    """The nested results as JSON, one line for each document."""
    result_rows(made, key).write.mode("overwrite").json(path)


def result_rows(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """One nested row for each document: stages original, anonymized and tripwire."""

    def with_tokens(tokens_: Column) -> Column:
        return F.transform("findings", lambda f: F.struct(f["entity_type"].alias("entity_type"), f["tier"].alias("tier"), F.round(f["score"], 2).alias("score"), F.coalesce(F.element_at(tokens_, f["value"]), F.lit("?")).alias("token")))

    shown = let(vault.forward(F.col("vault")), with_tokens)
    return made.select(
        key,
        F.col("status").isin("ok", "no_findings").alias("ok"),
        F.when(~F.col("status").isin("ok", "no_findings"), F.col("status")).alias("error"),
        F.struct(
            F.struct(F.length("text").alias("char_count")).alias("original"),
            F.struct(F.col("anonymized").alias("text"), shown.alias("findings"), "n_tokens", "n_unique", "n_replaced").alias("anonymized"),
            F.struct((F.size("leaks") > 0).alias("fired"), F.size("leaks").alias("leak_count")).alias("tripwire"),
        ).alias("stages"),
    )
