"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last WINDOW bytes hits a pattern, so that documents with a
common passage share the chunks inside it, wherever the passage stands. A task encodes a chunk once as long as it
remembers it: new chunks for a while, those that came again for longer. Only the ids between its first and last seam (an ASCII letter followed by
a space) are taken; a join is repaired by encoding what lies between two chunks' seams together with the word
beside it on either side, and it stands if those words come out with the ids that they have in their chunks. If
they don't, the window widens over both chunks and at last over the whole text so far, until both encodings agree.

The ids equal those of the tokenizers library for the same vocabulary (add_special_tokens=False);
the vocabulary is read from a path on every worker and never trained.

Defined cases: null and empty texts give no ids; the end-of-text mark inside a text is its special id,
as in the library; repeated rows get equal ids, each its own; a text of any length is one row, encoded in chunks; an
empty table gives an empty one; columns other than doc_id and text are dropped by digests() and kept by encode()
unless they carry the names ids or decoded, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from cloakframe.llm import common

WINDOW, MEAN_CHUNK = 16, 1024
#: Bytes of new and of repeated chunks that a task remembers: they decide what is encoded again, never the ids.
NEW_BYTES, REPEATED_BYTES = 8 << 20, 16 << 20
END_OF_TEXT = "<|endoftext|>"
#: Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def is_letter(byte: int) -> bool:
    return 65 <= byte & 0xDF <= 90


Entry = tuple[np.ndarray, str, bytes]


def seam(raw: bytes, at: int) -> int:
    """The first place from `at` on with a space behind an ASCII letter; -1 if there is none."""
    at = raw.find(b" ", at)
    while at > 0 and not is_letter(raw[at - 1]):
        at = raw.find(b" ", at + 1)
    return at


def last_seam(raw: bytes, before: int) -> int:
    """The last such place before `before`; 0 or less if there is none."""
    at = raw.rfind(b" ", 0, before)
    while at > 0 and not is_letter(raw[at - 1]):
        at = raw.rfind(b" ", 0, at)
    return at


class Piece:
    """What lies between two seams: its bytes, its entry, and the words (bytes, ids) at its ends."""

    __slots__ = ("entry", "first", "last")

    def __init__(self, entry: Entry, first: tuple[bytes, list[int]], last: tuple[bytes, list[int]]) -> None:
        self.entry, self.first, self.last = entry, first, last

    @property
    def raw(self) -> bytes:
        return self.entry[2]


EDGE: tuple[bytes, list[int]] = (b"", [])


class Memory:
    """Chunks in the order of their use; the oldest go beyond `limit` bytes."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held = limit, 0
        self.chunks: dict[bytes, tuple[bytes, Piece | None, bytes]] = {}

    def take(self, raw: bytes) -> tuple[bytes, Piece | None, bytes] | None:
        found = self.chunks.pop(raw, None)
        if found is not None:
            self.held -= 8 * len(raw) + 500
        return found

    def put(self, raw: bytes, found: tuple[bytes, Piece | None, bytes]) -> None:
        self.chunks[raw] = found
        self.held += 8 * len(raw) + 500
        while self.held > self.limit:
            self.take(next(iter(self.chunks)))


class Codec:
    """Encoder and decoder of one vocabulary; keeps the chunks that repeat."""

    def __init__(self, path: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.pieces = [b""] * (self.end + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.pieces[self.end] = END_OF_TEXT.encode()
        self.names = [str(i) for i in range(self.end + 1)]
        self.new, self.repeated = Memory(NEW_BYTES), Memory(REPEATED_BYTES)
        self.hits = self.misses = self.widened = 0

    def plain(self, text: bytes) -> list[int]:
        """Ids of a text from its beginning or a seam to a seam or its end."""
        whole = text.decode()
        if END_OF_TEXT not in whole:
            return self.encoding.encode_ordinary(whole)
        out: list[int] = []
        for i, part in enumerate(whole.split(END_OF_TEXT)):
            if i:
                out.append(self.end)
            out += self.encoding.encode_ordinary(part)
        return out

    def entry(self, ids: list[int]) -> Entry:
        """Ids with their decimal form and their bytes."""
        return np.array(ids, np.uint16 if self.end < 1 << 16 else np.uint32), ",".join(map(self.names.__getitem__, ids)), b"".join(map(self.pieces.__getitem__, ids))

    def guard(self, raw: bytes, ids: list[int], at: int) -> tuple[bytes, list[int]]:
        """The word of `raw` before (at < 0) or from its end to the seam nearest to it, with its own ids; EDGE if
        the ids have no border there."""
        if at == 0:
            stop = seam(raw, 1)
            size, n = (stop if stop > 0 else len(raw)), 0
            for i in ids:
                if size <= 0:
                    break
                size, n = size - len(self.pieces[i]), n + 1
            return (raw[: stop if stop > 0 else len(raw)], ids[:n]) if size == 0 else EDGE
        begin = last_seam(raw, len(raw))
        size, n = len(raw) - max(begin, 0), 0
        for i in reversed(ids):
            if size <= 0:
                break
            size, n = size - len(self.pieces[i]), n + 1
        return (raw[max(begin, 0) :], ids[len(ids) - n :]) if size == 0 else EDGE

    def chunk(self, raw: bytes) -> tuple[bytes, Piece | None, bytes]:
        """(head, piece, tail) of a chunk; without two seams all of it is head."""
        found = self.repeated.take(raw) or self.new.take(raw)
        if found is not None:
            self.hits += 1
            self.repeated.put(raw, found)
            return found
        self.misses += 1
        first, last = seam(raw, 1), last_seam(raw, len(raw))
        if 0 < first < last:
            ids = self.plain(raw[first:last])
            found = raw[:first], Piece(self.entry(ids), self.guard(raw[first:last], ids, 0), self.guard(raw[first:last], ids, -1)), raw[last:]
        else:
            found = raw, None, b""
        self.new.put(raw, found)
        return found

    def join(self, done: list[Piece], between: bytes, piece: Piece | None) -> bytes:
        """Append what lies between the last of `done` and `piece`, and that; returns what is left open."""
        left, right = done[-1].last if done else EDGE, piece.first if piece else EDGE
        ids = self.plain(left[0] + between + right[0])
        n, m = len(left[1]), len(ids) - len(right[1])
        if n <= m and ids[:n] == left[1] and ids[m:] == right[1] and (not done or n) and (not piece or right[1]):
            if m > n:
                done.append(Piece(self.entry(ids[n:m]), EDGE, EDGE))
            if piece:
                done.append(piece)
            return b""
        # The words beside the join don't come out as in their chunks: the whole text up to the next one's last word.
        self.widened += 1
        text = b"".join(p.raw for p in done) + between + (piece.raw if piece else b"")
        ids = self.plain(text)
        if piece and not (piece.last[1] and ids[-len(piece.last[1]) :] == piece.last[1]):
            done.clear()
            return text
        done[:] = [Piece(self.entry(ids), EDGE, piece.last if piece else EDGE)]
        return b""

    def entries(self, text: bytes, cuts: list[int]) -> Iterator[Entry]:
        """Entries whose ids, one after another, are the text's."""
        done: list[Piece] = []
        open_, start = b"", 0
        for cut in [*cuts, len(text)]:
            head, piece, tail = self.chunk(text[start:cut])
            start = cut
            open_ += head
            if piece is not None:
                open_ = self.join(done, open_, piece) + tail
        if open_:
            self.join(done, open_, None)
        return (p.entry for p in done)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def cut_points(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """For each text of a block, the chunk borders inside it."""
    cuts = np.zeros(0, np.int64)
    if len(data) > WINDOW:
        prefix = common.prefix_hash(data)
        _, down = common.powers(len(prefix))
        rolled = (prefix[WINDOW:] - prefix[:-WINDOW]) * down[: len(prefix) - WINDOW]
        cuts = np.flatnonzero(rolled >> np.uint64(64 - MEAN_CHUNK.bit_length() + 1) == 0) + WINDOW
        cuts = cuts[cuts < len(data)]
        cuts = cuts[data[cuts] & 0xC0 != 0x80]
    at = np.searchsorted(cuts, offsets)
    for i in range(len(offsets) - 1):
        own = cuts[at[i] : at[i + 1]] - offsets[i]
        yield own[own >= WINDOW].tolist()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(batch: pa.RecordBatch, path: str) -> Iterator[list[tuple[np.ndarray, str, bytes]]]:
    use = codec(path)
    for _, data, offsets in common.blocks(batch):
        raw = data.tobytes()
        for i, cuts in enumerate(cut_points(data, offsets)):
            yield list(use.entries(raw[offsets[i] : offsets[i + 1]], cuts))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids (array of int) and decoded (the text that the ids decode to)."""
    path = path or default_vocabulary()
    docs = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_encoded(batch, path))
            ids = pa.array([np.concatenate([x[0] for x in r]).astype(np.int32) if r else np.zeros(0, np.int32) for r in rows], pa.list_(pa.int32()))
            decoded = pa.array([b"".join(x[2] for x in r).decode("utf-8", "replace") for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, decoded], [*batch.schema.names, "ids", "decoded"])

    schema = f"{docs.limit(0)._jdf.schema().toDDL()}, ids array<int>, decoded string"
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for row in _encoded(batch, path):
                n.append(sum(len(x[0]) for x in row))
                ids_sha.append(hashlib.sha256(",".join(x[1] for x in row).encode()).hexdigest())
                decoded = b"".join(x[2] for x in row)
                decoded_sha.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
