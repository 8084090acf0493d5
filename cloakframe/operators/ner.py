"""Tier 2: findings of a language model that the caller brings; loaded once for each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cloakframe.schema import FINDINGS

#: Maps a text to (start, end, entity type, score); offsets count code points.
Analyzer = Callable[[str], list[tuple[int, int, str, float]]]


#: Findings, and bytes of text, after which a task passes on what it has: its memory doesn't grow with a batch of rows.
PASSED, PASSED_BYTES = 8192, 4 << 20
_FINDINGS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("value", pa.string()), ("tier", pa.string()), ("score", pa.float64())]))


def with_ner(docs: DataFrame, factory: Callable[[], Analyzer] | None, text: str = "text") -> DataFrame:
    """docs with `ner` (findings) and `ner_status`: ready, unavailable (no findings), or failed for rows that
    the analyzer raised on, which must not be sent. Rows pass through in Arrow batches, and texts are taken from them one by one."""
    at = docs.columns.index(text)
    names = [*docs.columns, "ner", "ner_status"]

    def of(analyze: Analyzer | None, value: str | None) -> tuple[list[dict], str]:
        if analyze is None:
            return [], "unavailable"
        try:
            rows = analyze(value) if value and value.strip() else []
            return [{"start": s, "end": e, "entity_type": t, "value": value[s:e], "tier": "ner", "score": p} for s, e, t, p in rows], "ready"
        except Exception:  # noqa: BLE001  fail closed, by row
            return [], "failed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            analyze = factory() if factory else None
        except Exception:  # noqa: BLE001  a model that can't be loaded is unavailable
            analyze = None
        for batch in batches:
            begin, found, status, n, size = 0, [], [], 0, 0
            for i, value in enumerate(batch.column(at)):
                made = of(analyze, value.as_py())
                found.append(made[0])
                status.append(made[1])
                n, size = n + len(made[0]), size + (value.as_buffer().size if value.is_valid else 0)
                if n >= PASSED or size >= PASSED_BYTES or i + 1 == len(batch):
                    own = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, _FINDINGS), pa.array(status, pa.string())], names)
                    begin, found, status, n, size = i + 1, [], [], 0, 0

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, ner {FINDINGS}, ner_status string")
