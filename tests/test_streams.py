from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.plans.catalogue import QUERIES
from cloakframe.schema import LOG
from cloakframe.streaming import log_source, streams

TURNS = "session_id string, ts timestamp, seq int, text string"


def at(minutes: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_transforms_accept_streams(spark, tmp_path):
    turns = [("s", at(1), 1, "mail a@b.cc"), ("t", at(1), 1, "d@e.ff")]
    spark.createDataFrame(turns, TURNS).write.parquet(str(tmp_path / "turns"))
    read = spark.readStream.schema(TURNS).parquet(str(tmp_path / "turns"))
    cleared = streams.anonymize_stream(read.withColumn("doc_id", F.concat_ws(":", "session_id", "seq")))
    minted = streams.number_stream(read)
    assert (cleared.isStreaming, cleared.columns) == (True, ["doc_id", "session_id", "text"])
    assert (minted.isStreaming, minted.columns) == (True, ["session_id", "value", "entity_type", "ord", "token"])


def rows(df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(100)
    finally:
        query.stop()
    return {tuple(r) for r in df.sparkSession.table(name).collect()}


def test_late_turns_are_numbered_in_their_order(spark, tmp_path):
    """A turn that is late by less than the delay has the number that a batch would give it; one beyond it is left out; and an idle
    session begins anew."""
    parts = [
        [("s", at(5), 2, "mail c@d.ee and x@y.zz"), ("t", at(1), 1, "d@e.ff"), ("v", at(2), 1, "a@b.cc")],
        [("s", at(1), 1, "a@b.cc, c@d.ee"), ("u", at(2), 1, None), ("v", at(2), 1, "a@b.cc")],
        [("s", at(20), 3, "x@y.zz q@r.ss")],
        [("t", at(300), 2, "k@l.mm")],
        [("s", at(2), 1, "too@late.org")],
        [("end", at(900), 1, None)],
    ]
    for part in parts:
        spark.createDataFrame(part, TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files of one second have no order
    read = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    minted = rows(streams.number_stream(read), "minted", tmp_path)
    expected = [("s", "a@b.cc", 1), ("s", "c@d.ee", 2), ("s", "x@y.zz", 3), ("s", "q@r.ss", 4), ("t", "d@e.ff", 1), ("t", "k@l.mm", 1), ("v", "a@b.cc", 1)]
    assert minted == {(s, v, "EMAIL", n, f"<<EMAIL_0{n}>>") for s, v, n in expected}
    cleared = rows(streams.anonymize_stream(read.withColumn("doc_id", F.concat_ws(":", "session_id", "seq"))), "cleared", tmp_path)
    assert {(r[0], r[2]) for r in cleared} >= {("t:1", "<<EMAIL_01>>"), ("s:1", "<<EMAIL_01>>, <<EMAIL_02>>")}


def test_findings_at_one_place_of_one_turn(spark, tmp_path):
    """Two rows of a turn with names at the same place: each is numbered, as in a batch."""
    turns = [(1, 0, "user", "Maria Stone\nhello"), (1, 0, "user", "Peter Falk\nhello"), (1, 1, "user", "Anna Berg\nok")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    batch, stream = ({tuple(r) for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("q14_session_numbering", "q14_numbering_of_streams"))
    assert stream == batch == {(1, v, "PERSON", n, f"<<PERSON_0{n}>>") for n, v in enumerate(("Maria Stone", "Peter Falk", "Anna Berg"), 1)}


@pytest.mark.parametrize("capacity", [3, 100])
def test_log_stream_goes_on_where_it_ended(spark, tmp_path, capacity):
    def records(first: int, last: int):
        return spark.createDataFrame([(i, at(i), "INFO", "l", f"m{i}") for i in range(first, last)], LOG).repartition(3)

    folder, held, checkpoint = (str(tmp_path / n) for n in ("log", "held", "checkpoint"))
    seen = []
    for first, last in ((1, 1), (1, 8), (8, 8), (8, 21), (21, 23)):
        log_source.append(records(first, last), folder)
        got = log_source.keep_newest(log_source.read(spark, folder, 2), held, checkpoint, capacity)
        seen.append(sorted(r["seq"] for r in got.collect()))
    want = [list(range(3, n)) for n in (3, 8, 8, 21, 23)]
    assert seen == [w[-capacity:] for w in want]
    assert {r["message"] for r in log_source.held(spark, held).collect()} == {f"m{i}" for i in seen[-1]}
