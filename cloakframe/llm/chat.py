"""Chat formatting by event sourcing: a log of events is folded into conversations, and those are rendered for training.

A log has rows (conv_id, place, message, seq, kind, role, text). `place` orders a conversation's messages, `message` tells them
apart, and `seq` orders the log. Kinds: open (role; the text begins empty), delta (text is appended), edit (text in
place of what was there), regenerate (what was there goes, deltas follow), delete (the message goes). Others change nothing.

The log is partitioned by conversation and message and sorted by sequence, so that a conversation of many rows is folded and
rendered by many tasks; the fold is a stream that holds one message. A rendered message is a row of its own, a piece of the
formatted conversation with its span under the loss mask; the pieces in order are the conversation.

A piece is BEGIN role newline text END. Within texts and roles a backslash is doubled, and one is put behind the first character of
every control string, so that no control string stands in a text and the way back is exact.

Defined cases: null text is empty, null role too; null ids are one conversation and null places come first; messages of one place
follow in the order of their names; conversations without messages are not there; repeated rows of a table are messages of their own;
a message of any length is a row; an empty log gives empty tables. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import common

EVENTS = ("conv_id", "place", "message", "seq", "kind", "role", "text")
#: Code points of a streamed delta, and of the draft that a log of finished turns has before an edit.
DELTA, DRAFT = 512, 48


@dataclass(frozen=True)
class Template:
    """How turns are marked. Control strings are longer than a character and hold no backslash."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    #: Control strings of common templates.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)

    @cached_property
    def _risky(self) -> re.Pattern:
        return re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]))

    def escaped(self, text: str) -> str:
        return self._risky.sub(r"\g<0>\\", text)

    def rendered(self, role: str, text: str) -> tuple[str, int | None, int | None]:
        """(piece, start and end of what is under the loss mask, or nulls)."""
        head = self.begin + self.escaped(role).replace("\n", "\\\n") + "\n"
        body = self.escaped(text)
        span = (len(head), len(head) + len(body)) if role in self.learned else (None, None)
        return head + body + self.end, *span

    def parsed(self, piece: str) -> tuple[str, str]:
        """(role, text) of a piece; ValueError if it is none."""
        head = _HEAD.match(piece, len(self.begin))
        if not piece.startswith(self.begin) or not piece.endswith(self.end) or not head or head.end() > len(piece) - len(self.end):
            raise ValueError("not a rendered message")
        return unescaped(head[1]), unescaped(piece[head.end() : len(piece) - len(self.end)])


_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def log(turns: DataFrame) -> DataFrame:
    """The log that a server would have of finished turns (conv_id, turn, role, text): learned roles are streamed, given up after a
    draft and regenerated; others are sent as a draft and edited. Rows that repeat a turn are ordered by role and text."""
    text = F.coalesce("text", F.lit(""))
    draft = F.left(text, F.lit(DRAFT))
    event = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("text"))
    deltas = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("text")))
    streamed = F.concat(F.array(event("open", F.lit(None).cast("string")), event("delta", draft), event("regenerate", F.lit(None).cast("string"))), deltas)
    typed = F.array(event("open", F.lit(None).cast("string")), event("delta", draft), event("edit", text))
    name = F.concat_ws(":", F.coalesce("role", F.lit("")), F.md5(text.cast("binary")), F.monotonically_increasing_id().cast("string"))
    # Named below the generator: above it, every event would have a number of its own.
    named = turns.select("conv_id", F.col("turn").alias("place"), name.alias("message"), "role", "text")
    rows = named.select("conv_id", "place", "message", "role", F.posexplode(F.when(F.col("role").isin(*Template().learned), streamed).otherwise(typed)).alias("i", "e"))
    return rows.select("conv_id", "place", "message", (F.coalesce("place", F.lit(0)) * (1 << 32) + F.col("i")).alias("seq"), "e.kind", "role", "e.text")


def render(events: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, place, message, formatted, loss_start, loss_end): the messages of a log, rendered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        role, parts, alive = "", [], False

        def made(rows: list[tuple]) -> pa.RecordBatch:
            conv, place, message, piece, start, end = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(conv, kinds[0]), pa.array(place, kinds[1]), pa.array(message, pa.string()), pa.array(piece, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["conv_id", "place", "message", "formatted", "loss_start", "loss_end"])

        rows: list[tuple] = []
        kinds = None
        for batch in batches:
            kinds = batch.schema.types
            for conv, place, message, _, kind, speaker, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, place, message):
                    if alive:
                        rows.append((*key, *template.rendered(role, "".join(parts))))
                    key, role, parts, alive = (conv, place, message), "", [], False
                if kind == "open":
                    role, parts, alive = speaker or "", [], True
                elif kind == "delta" and alive:
                    parts.append(text or "")
                elif kind == "edit" and alive:
                    parts = [text or ""]
                elif kind == "regenerate" and alive:
                    parts = []
                elif kind == "delete":
                    alive = False
            if rows:
                yield made(rows)
                rows = []
        if alive:
            yield made([(*key, *template.rendered(role, "".join(parts)))])

    ordered = events.select(*EVENTS).repartition("conv_id", "message").sortWithinPartitions("conv_id", "place", "message", "seq")
    kind = {f.name: f.dataType.simpleString() for f in events.schema}
    return ordered.mapInArrow(run, f"conv_id {kind['conv_id']}, place {kind['place']}, message string, formatted string, loss_start int, loss_end int")


def read_back(rendered: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of rendered messages, from pieces and mask alone.

    A digest of a whole conversation is made in its order, so a conversation is one stream, of which a message is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind = None
        now: list | None = None  # conversation, turns, digest, characters under the mask, their digest, characters

        def done(rows: list[list]) -> pa.RecordBatch:
            conv, n, turns, chars, loss, size = zip(*rows, strict=True)
            columns = [pa.array(conv, kind), pa.array(n, pa.int64()), pa.array([t.hexdigest() for t in turns]), pa.array(chars, pa.int64()), pa.array([x.hexdigest() for x in loss]), pa.array(size, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.schema.types[0]
            rows = []
            for conv, piece, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if now is None or now[0] != conv:
                    rows += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = template.parsed(piece)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[5] += len(piece)
                if start is not None:
                    own = unescaped(piece[start:end])
                    now[3] += len(own)
                    now[4].update(own.encode())
            if rows:
                yield done(rows)
        if now:
            yield done([now])

    kind = rendered.schema["conv_id"].dataType.simpleString()
    ordered = rendered.select("conv_id", "place", "message", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "place", "message")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = "</s>[INST] ok [/INST]"


def planted(turns: DataFrame) -> DataFrame:
    """turns with conversation -1, whose texts are control strings."""
    row = lambda turn, role: F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PLANTED).alias("text"))
    own = turns.sparkSession.range(1).select(F.explode(F.array(row(0, "user"), row(1, "assistant"))).alias("x")).select("x.*")
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """render() of finished turns, written to the shared folder."""
    return common.written(render(log(turns), template), "rendered")


def _escaped(c: str, template: Template = Template()) -> str:  # noqa: B008
    out = f"replace({c}, '\\', '\\\\')"
    for control in template.controls:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


_T = Template()
#: DuckDB SQL for read_back() of the table conversations with planted(); the control strings of the default template never overlap.
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
o AS (SELECT *, {len(_T.begin) + 1 + len(_T.end)} + length(replace({_escaped("role")}, chr(10), '\\' || chr(10))) + length({_escaped("text")}) AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
