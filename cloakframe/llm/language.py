"""Language identification with language-bitmask n-gram filters.

Each language's frequent byte n-grams go into one bit-sliced Bloom filter: a slot holds a mask with
one bit a language, and the conjunction of an n-gram's slots is the mask of all languages that have
it. A text counts the bits of its n-grams by language, takes off the false positives that the fill
of each language's slice predicts, and the largest count decides.

The filters are learned from a bounded sample of each language of the training fold: documents in the order of a hash
of id and text, at most SAMPLE, up to the one that brings their texts to SAMPLE_BYTES. Languages are dealt over tasks,
and a task sends no more than the MOST n-grams that the filter takes.

Defined cases: `und` with score 0 for null texts and texts without a letter, and where nothing was
learned; a text with a letter but shorter than an n-gram, or without a known n-gram, has score 0 and the first
language in code-point order, to which ties go as well; repeated rows get equal results, each its own; a text of any
length is one row; an empty table gives an empty one; more than 64 languages take several planes of masks, more than LANGUAGES are an error; null languages
are never learned; columns that are not asked for are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm import common

SAMPLE, SAMPLE_BYTES = 600, 4 << 20
GRAM = 5
SLOTS = 1 << 19
#: Share of a language's n-gram mass that its filter holds, and the most n-grams it holds.
MASS, MOST = 0.95, 40_000
UNKNOWN = "und"
#: More languages are an error: every 64 of them take a plane of 4 MB in each task.
LANGUAGES = 2048

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x09, 0x0E)]] = 0x20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's n-grams, and each text's range; shorter texts have none."""
    n = max(len(data) - GRAM + 1, 0)
    folded = _FOLD[data].astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for j in range(GRAM):
        packed |= folded[j : j + n] << np.uint64(8 * j)
    inside = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n) >= GRAM
    count = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    return common.mix(packed[inside]), np.concatenate([[0], np.cumsum(count)])


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(SLOTS.bit_length() - 1)
    return (hashes >> (np.uint64(64) - bits)).astype(np.int64), (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def frequent(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n-grams of a language that its filter holds, given their numbers: the most frequent first."""
    order = np.lexsort((hashes, -n))
    return hashes[order[: min(MOST, int(np.searchsorted(np.cumsum(n[order]), MASS * n.sum())) + 1)]]


def build(held: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, planes of slot masks, false-positive rate of each language) of each language's n-grams."""
    names = sorted(held)
    planes = np.zeros((max(1, -(-len(names) // 64)), SLOTS), np.uint64)
    rates = np.zeros(len(names))
    for i, name in enumerate(names):
        bit = np.uint64(1 << (i % 64))
        for at in slots(held[name]):
            planes[i // 64][at] |= bit
        fill = np.count_nonzero(planes[i // 64] & bit) / SLOTS
        rates[i] = fill * fill
    if len(names) <= 8:
        planes = planes.astype(np.uint8)
    return names, planes, rates


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text): the documents to learn from.

    A share by hash leaves about four times the sample of each language, whatever its size, and a rank by the same
    hash makes the bound exact."""
    known = docs.where(~common.held_out() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", common.whole_text()).alias("h"))
    sizes = common.written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if sizes.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    some = known.join(F.broadcast(sizes), "lang").where(place < F.lit(4.0 * SAMPLE) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h", "text")
    few = some.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= SAMPLE)
    before = F.sum(F.octet_length(common.whole_text())).over(Window.partitionBy("lang").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1))
    return few.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < SAMPLE_BYTES).select("lang", "text")


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Learn the filters from the sample. The driver gets MOST n-grams of each language at most."""

    def chosen(lang: str, found: list[np.ndarray]) -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([frequent(hashes, n).tobytes()])], ["lang", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found = None, []
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, data, offsets in common.blocks(batch):
                hashes, at = grams(data, offsets)
                for i, lang in enumerate(langs[rows]):
                    if lang != current and found:
                        yield chosen(current, found)
                        found = []
                    current = lang
                    found.append(hashes[at[i] : at[i + 1]])
        if found:
            yield chosen(current, found)

    dealt = sample(docs).repartition(common.partitions(docs.sparkSession), "lang").sortWithinPartitions("lang")
    rows = dealt.mapInArrow(count, "lang string, hashes binary").collect()
    return build({r["lang"]: np.frombuffer(bytes(r["hashes"]), np.uint64) for r in rows})


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    names, planes, rates = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((planes, rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, rates = shared.value
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            for rows, data, offsets in common.blocks(batch, limit=1 << 20):
                hashes, at = grams(data, offsets)
                first, second = slots(hashes)
                n = np.diff(at)
                counts = np.zeros((len(n), max(len(names), 1)))
                full = np.flatnonzero(n)
                for p, plane in enumerate(planes):
                    mask = plane[first] & plane[second]
                    for i in range(p * 64, min(len(names), p * 64 + 64)):
                        if len(full):
                            bit = (mask >> mask.dtype.type(i - p * 64)) & mask.dtype.type(1)
                            counts[full, i] = np.add.reduceat(bit, at[full], dtype=np.int64)
                if names:
                    counts = np.maximum(counts - n[:, None] * rates, 0) / (1 - rates)
                best = counts.argmax(axis=1)
                total = counts.sum(axis=1)
                own = counts[np.arange(len(n)), best]
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                texts = batch.column(1).slice(rows.start, len(n))
                for i in range(len(n)):
                    ok = bool(names) and (has[i] or any(map(str.isalpha, texts[i].as_py() or "")))
                    pred.append(names[best[i]] if ok else UNKNOWN)
                    score.append(float(own[i] / total[i]) if ok and total[i] else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", common.held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
