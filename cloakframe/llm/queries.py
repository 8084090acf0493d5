"""Queries over the test tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import bpe, chat, divergence, exact_substrings, importance, language, media, minhash, mixing, quality, secret_scan, simhash, token_counts
from cloakframe.llm.common import held_out, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edits(documents(spark, sf_dir))


def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 1: bands of signatures joined, Jaccard verified."""
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.remove(documents(spark, sf_dir)).drop("kept")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(documents(spark, sf_dir)))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.takings(docs, table(spark, sf_dir, "labels"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir), keep_text=False).select("doc_id", *secret_scan.RESULT)


def planted_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over documents with parts of credentials planted in each."""
    return secret_scan.scan(secret_scan.planted(documents(spark, sf_dir)), keep_text=False).select("doc_id", *secret_scan.RESULT)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scores(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.planted(table(spark, sf_dir, "conversations"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_suffix_array_dedup,
        op3_media_columns,
        op4_simhash_near_dedup,
        op5_token_counts,
        op6_quality_classifier,
        op7_mixing_to_weights,
        op8_bpe_round_trip,
        op9_language_id,
        op10_secret_scan,
        op11_importance_resampling,
        op12_chat_formatting,
        op13_source_divergence,
        pipeline,
        minhash_classes,
        planted_secret_links,
    )
}

ORACLES: dict[str, str] = {
    "op7_mixing_to_weights": mixing.ORACLE,
    "op10_secret_scan": secret_scan.ORACLE,
    "planted_secret_links": secret_scan.PLANTED_ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op12_chat_formatting": chat.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
