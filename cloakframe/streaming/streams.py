"""The pipeline on streams. Documents are independent rows, so the batch transform serves as it is; a
conversation whose turns arrive over time keeps its vault as state of its session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cloakframe.functions.tokens import token
from cloakframe.operators import detect
from cloakframe.plans import pipeline


def anonymize_stream(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A stream of (key, session_id, text) of documents that may leave."""
    return pipeline.split(pipeline.anonymized(docs, key), key)[0]


#: The state store that keeps values one by one; the default one rewrites a session's state as a whole.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Minting(StatefulProcessor):
    """A session's values, each an entry of its own, and its findings that still wait for the watermark."""

    def __init__(self, session: str, idle_ms: int | None) -> None:
        self.session, self.idle_ms = session, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "value string", "ord int")
        self.counts = handle.getMapState("counts", "entity_type string", "n int")
        # All of a finding is its key: rows of one turn may have findings at one place.
        self.waiting = handle.getMapState("waiting", "ms long, seq long, start int, value string, entity_type string", "waits boolean")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        for batch in rows:
            for ms, seq, start, value, entity in zip(batch["ms"], batch["seq"], batch["start"], batch["value"], batch["entity_type"], strict=True):
                found = isinstance(value, str)  # a turn without findings keeps the session awake
                self.waiting.updateValue((int(ms), int(seq), int(start), value if found else "", entity if found else ""), (True,))
                self.handle.registerTimer(int(ms))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        now = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        new = []
        for ms, seq, start, value, entity in sorted(tuple(k) for k, _ in self.waiting.iterator() if k[0] <= now):
            self.waiting.removeKey((ms, seq, start, value, entity))
            if self.idle_ms is not None and last is not None and ms - last > self.idle_ms:
                self._forget()
            last = ms
            if value and not self.known.containsKey((value,)):
                n = (self.counts.getValue((entity,))[0] if self.counts.containsKey((entity,)) else 0) + 1
                self.counts.updateValue((entity,), (n,))
                self.known.updateValue((value,), (n,))
                new.append((key[0], value, entity, n))
        if self.idle_ms is not None and last is not None and last + self.idle_ms <= now:
            self._forget()
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            if self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms)
        if new:
            yield pd.DataFrame(new, columns=[self.session, "value", "entity_type", "ord"])

    def _forget(self) -> None:
        self.known.clear()
        self.counts.clear()

    def close(self) -> None:
        pass


def number_stream(turns: DataFrame, session: str = "session_id", delay: str = "10 minutes", idle_ms: int | None = 3_600_000) -> DataFrame:
    """A stream of new vault entries (session, value, entity_type, ord, token) of sessions that span turns (session, ts, seq, text).

    Findings wait until the watermark, `delay` behind the latest turn, has passed them, and are then numbered by (ts, seq, place): a turn that
    comes late by no more than that has the numbers that a batch over the whole session would give it; one that is later than the watermark
    of the batch before is left out. Each value is an entry of the session's map state, so a turn reads and writes its own values
    alone. A session that rests for more than `idle_ms` of event time begins anew, and its state goes with the watermark; None keeps it."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    found = detect.with_findings(turns.withWatermark("ts", delay), F.col("text"))
    rows = found.select(session, "ts", "seq", F.explode_outer("findings").alias("f"))
    rows = rows.select(session, "ts", F.unix_millis("ts").alias("ms"), F.col("seq").cast("long").alias("seq"), F.coalesce("f.start", F.lit(0)).alias("start"), F.col("f.value").alias("value"), F.col("f.entity_type").alias("entity_type"))
    kind = turns.schema[session].dataType.simpleString()
    minted = rows.groupBy(session).transformWithStateInPandas(statefulProcessor=_Minting(session, idle_ms), outputStructType=f"{session} {kind}, value string, entity_type string, ord int", outputMode="Append", timeMode="EventTime")
    return minted.withColumn("token", token(F.col("entity_type"), F.col("ord")))


def log_counts(records: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Records by window and level; late ones within `late` still count."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", window), "level").agg(F.count("*").alias("n"), F.max("seq").alias("latest"))
