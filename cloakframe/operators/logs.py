"""Log records: redaction of secrets, the leak check, and reading the newest ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.automaton import Matcher
from cloakframe.functions.text import longest_first, quoted
from cloakframe.sources import scratch

LEAST, CAPACITY, MARK = 4, 2000, "[REDACTED]"
#: Values that one task holds beside the messages, at most, and their bytes.
SMALL, HELD_BYTES = 100_000, 8 << 20
#: Messages that one task holds of a part that they share.
SHARE = 100_000


def secret(value: Column) -> Column:
    """The trimmed value if it is long enough to be told apart from ordinary text; else null."""
    trimmed = F.trim(value)
    return F.when(F.length(trimmed) >= LEAST, trimmed)


def filename_secrets(filename: Column) -> Column:
    """A file's name without its suffix, and that with separators as spaces."""
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")
    return F.filter(F.array_distinct(F.array(secret(stem), secret(F.translate(stem, "_-", "  ")))), lambda x: x.isNotNull())


def redacted(message: Column, secrets: Column) -> Column:
    """The message with every secret of a short list replaced, the longest first, in one pass."""
    pattern = F.array_join(F.transform(longest_first(F.filter(secrets, lambda s: s.isNotNull())), quoted), "|")
    return F.when(F.length(pattern) > 0, F.regexp_replace(message, pattern, F.lit(MARK))).otherwise(message)


def held(values: DataFrame, most: int) -> list[str] | None:
    """The distinct values of a table (value), if they are at most `most` and HELD_BYTES; else None, and nothing is collected."""
    n, size = values.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    return [r["value"] for r in values.collect()] if n <= most and size <= HELD_BYTES else None


def redacted_records(records: DataFrame, secrets: DataFrame, small: int = SMALL) -> DataFrame:
    """records (..., message) with every secret of a table (secret) replaced, the longest at a place first.

    Up to `small` secrets of HELD_BYTES make one automaton for each task, and messages are read once. More of them meet the
    messages on their rarest part, and every message is searched for those that may stand in it."""
    known = secrets.select(secret(F.col("secret")).alias("value")).where("value is not null").distinct()
    values = held(known, small)
    if values is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, marks = Matcher(values, guarded=False), dict.fromkeys(values, MARK)
            for batch in batches:
                at = batch.schema.get_field_index("message")
                made = [None if m is None else search.replaced(m, marks)[0] for m in batch.column(at).to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(made, pa.string()))

        return records.mapInArrow(run, records.schema)
    pairs = _met(records.select("message").distinct(), known)
    own = pairs.groupBy("message").agg(F.collect_set("value").alias("_secrets"))  # no more than the message has substrings
    return records.join(own, "message", "left").withColumn("message", F.when(F.col("_secrets").isNull(), F.col("message")).otherwise(redacted(F.col("message"), F.col("_secrets")))).select(*records.columns)


def secrets_table(vault: DataFrame, files: DataFrame) -> DataFrame:
    """(secret): what logs must not show: values of the vault, and names of files (filename)."""
    values = vault.select(secret(F.col("value")).alias("secret")).where("secret is not null")
    names = files.select(F.explode(filename_secrets(F.col("filename"))).alias("secret"))
    return values.unionByName(names).distinct()


def _grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{LEAST}}}))"), F.lit(1)))


def leaked(logs: DataFrame, labels: DataFrame, small: int = SMALL) -> DataFrame:
    """Labels (..., value) that stand in some message.

    Up to `small` distinct values of HELD_BYTES make one automaton for each task, through which the messages pass once; a task passes
    on each value that it found, once. More of them meet the messages on their rarest part, and the value decides."""
    known = labels.where(F.length("value") >= LEAST)
    distinct = known.select("value").distinct()
    values = held(distinct, small)
    if values is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, found = Matcher(values, guarded=False), set()
            for batch in batches:
                for message in batch.column(0).to_pylist():
                    if message:
                        found |= search.present(message)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["value"])

        found = logs.select("message").mapInArrow(run, "value string").distinct()
    else:
        found = _met(logs.select("message").distinct(), distinct).select("value").distinct()
    return known.join(found, "value", "left_semi").select(*labels.columns)


def _met(messages: DataFrame, values: DataFrame) -> DataFrame:
    """(message, value) of values that stand in distinct messages. They meet on the substring of LEAST characters that is
    rarest among the messages; one that many messages have is dealt over several tasks, on both sides."""
    grams = messages.select("message", F.explode(_grams(F.col("message"))).alias("gram"))
    frequency = _placed(scratch.written(grams.groupBy("gram").agg(F.count("*").alias("n")), "frequency"))
    # A value of which some part stands in no message stands in none.
    parts = values.select("value", F.explode(_grams(F.col("value"))).alias("gram")).join(frequency, "gram", "left")
    rare = parts.groupBy("value").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    of = F.ceil(F.col("g.n") / SHARE).cast("int")
    rare = scratch.written(rare.select("value", "g.gram", of.alias("of")), "rare")
    wanted = _placed(rare.select("gram", "of").distinct())  # of a gram that some value needs
    dealt = grams.join(wanted, "gram").withColumn("salt", F.pmod(F.xxhash64("message"), F.col("of")).cast("int"))
    rare = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")
    return rare.join(dealt.drop("of"), ["gram", "salt"]).where(F.contains("message", "value")).select("message", "value").distinct()


#: Grams that every task may hold: there are no more different ones than the alphabet makes, however many messages there are.
GRAMS = 500_000


def _placed(grams: DataFrame) -> DataFrame:
    """A table of different grams, to be joined where the texts are if it is small: every text has as many grams as characters, and
    moving those with their text is a multiple of the input."""
    return F.broadcast(grams) if grams.count() <= GRAMS else grams


def newest(logs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The records that a ring of `capacity` would hold: a distributed top-k, not a global window."""
    return logs.orderBy(F.col("seq").desc()).limit(capacity)


def since(logs: DataFrame, seq: int, capacity: int = CAPACITY) -> DataFrame:
    """Held records after `seq`, each with the latest number."""
    held = newest(logs, capacity)
    return held.withColumn("latest", F.max("seq").over(Window.partitionBy(F.lit(0)))).where(F.col("seq") > seq)


def sequenced(records: DataFrame, order: list[str]) -> DataFrame:
    """records with seq 1, 2, ... in the given order: range partitions number their own rows, and the partitions' sizes, one row
    each, say where each begins. The ranges are written first: made twice, their borders would be drawn twice."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.written(records.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    own = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(F.broadcast(sizes.select("_p", ahead.alias("_ahead"))), "_p").withColumn("seq", (F.col("_ahead") + F.col("_i")).cast("long")).drop("_p", "_i", "_ahead")
