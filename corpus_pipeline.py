"""The corpus pipeline: quality filter, near-dedup, secret redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes
every stage as Parquet to the shared folder and reads it again. An empty table gives an empty one at every stage, a text
of any length is one row, and columns that docs has besides its own pass through all stages but the last with their
values, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import bpe, mixing, quality, secret_scan, simhash
from cloakframe.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from the labels of these documents.

    Null and empty texts have the score of the model's bias; equal texts, and so repeated rows, stay or go together;
    a score that equals the threshold stays."""
    return quality.filter_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, at 3 bits or fewer: the row with the smallest id, null ids last.

    Null, empty and blank texts are copies of each other; of rows that repeat an id, the text with the least hash stays."""
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars brought up to date.

    Null and empty texts stay as they are; repeated rows are each redacted; spans that overlap become one mark."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a whole document for each time that it is taken.

    Texts without a word, null ones included, are never taken; null sources are one source; repeated rows are taken
    each on its own, and ties between them are broken by their number."""
    return mixing.materialise(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): the documents' ids, their number, and whether they decode to the text.

    Null and empty texts have no ids and are exact; repeated rows have equal ids, each its own."""
    encoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"))
    return encoded.selectExpr("doc_id", "lang", "source", "size(ids) as n_tokens", "ids", "decoded = coalesce(text, '') as exact")


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing to target weights", mix_sources),
    ("bpe encoding", encode),
]

#: Not expressible: the classifier is trained, fingerprints are Python's; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
