"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its hashed words, pairs of neighbouring words, and n-grams
of three and four characters (code points); a softmax over two classes reads it. Vectors and softmax are trained
together by stochastic gradient descent in numpy, in one task, on a bounded, documented sample: labelled documents
of the training fold in the order of the hash of their id, at most SAMPLE of them, up to the one that brings their
texts to SAMPLE_BYTES. Scoring reads every whole text.

As the output is linear in the average, a trained vector only enters through its product with the
difference of the softmax's rows, so tasks carry one number for each hashed feature.

Defined cases: null and empty texts have no feature and get the score of the bias; labels that
repeat count by their best mark, null labels not at all; of an id with several rows the least text is learned from,
and every row is scored; equal texts have equal scores; a text of any length is one row; without labels of both
classes every score is the share of good labels (0.5 without labels); an empty table gives an empty one. score()
replaces a column of that name; filter_good() keeps every column as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm import common

BUCKETS = 1 << 17
DIMENSIONS = 8
SAMPLE, SAMPLE_BYTES = 3000, 48 << 20
#: At least so many passes and steps of gradient descent.
EPOCHS, STEPS, RATE = 4, 12_000, 4.0
THRESHOLD = 0.7
#: The pair of any word with itself: what repeats a word is told by that, whichever word it is.
AGAIN = np.uint64(0x9E3779B97F4A7C15)
#: The column that score() writes while it works.
SCORE = "__quality_score"


def _slot(hashes: np.ndarray) -> np.ndarray:
    """Feature numbers of 32-bit hashes."""
    mixed = (hashes ^ hashes >> np.uint32(15)) * np.uint32(0x85EBCA6B)
    return (mixed ^ mixed >> np.uint32(13)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each kind: feature numbers of a block's texts, one after another, and each text's range among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offsets]
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(points))
    padded = np.concatenate([points, np.zeros(4, np.uint32)])
    n = len(points)
    three = padded[:n] * np.uint32(0x9E3779B1) + padded[1 : n + 1] * np.uint32(0xC2B2AE3D) + padded[2 : n + 2] * np.uint32(0x27D4EB2F)
    four = three + padded[3 : n + 3] * np.uint32(0x165667B1) + np.uint32(0x5BD1E995)
    out = []
    for width, grams in ((3, three), (4, four)):
        out.append((_slot(grams[left >= width]), np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - width + 1, 0))])))
    starts, ends, words_at = common.word_spans(data, offsets)
    words = common.span_hash(common.prefix_hash(data), starts, ends)
    out.append((_slot((words >> np.uint64(32)).astype(np.uint32)), words_at))
    pairs = common.mix(words[:-1] * np.uint64(3) + words[1:])
    per = np.diff(words_at)
    inside = np.ones(max(len(words) - 1, 0), bool)
    inside[words_at[1:-1][(words_at[1:-1] > 0) & (words_at[1:-1] < len(words))] - 1] = False
    pairs = np.where(words[1:] == words[:-1], AGAIN, pairs)
    out.append((_slot((pairs[inside] >> np.uint64(32)).astype(np.uint32)), np.concatenate([[0], np.cumsum(np.maximum(per - 1, 0))])))
    return out


def train(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, float]:
    """A number for each feature and the bias; the score is the logistic of bias plus mean."""
    good = sum(labels)
    if not 0 < good < len(labels):
        share = np.clip(good / len(labels), 0.01, 0.99) if labels else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(7)
    docs = []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        found, count = np.unique(np.concatenate([f for f, _ in features(data, np.array([0, len(data)]))]), return_counts=True)
        docs.append((found, (count / max(count.sum(), 1)).astype(np.float32)))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(docs)))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            found, share = docs[i]
            hidden = share @ vectors[found]
            logits = softmax @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ softmax
            softmax -= rate * 0.1 * np.outer(p, hidden)
            bias -= rate * np.float32(0.02) * p
            vectors[found] -= rate * share[:, None] * back[None, :]
    return vectors @ (softmax[1] - softmax[0]), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sample: rows (doc_id, text, label) of the training fold; the ids are few and broadcast."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sized = docs.where(~common.held_out()).select("doc_id", F.octet_length(common.whole_text()).alias("bytes"))
    ids = sized.join(known, "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("bytes").alias("bytes"))
    few = ids.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(SAMPLE)
    # At most SAMPLE rows: a window over them is small.
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("_before", before).where(F.col("_before") < SAMPLE_BYTES).select("doc_id", "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # An id may have any number of rows; one text of each is learned from.
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), (F.max("quality") > 0).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train in one task over the bounded sample; the model has BUCKETS numbers and a bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i if i is not None else -1, y, (t or "").encode()) for b in batches for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        rows.sort()
        numbers, bias = train([r[2] for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([numbers.astype(np.float32).tobytes()]), pa.array([bias])], ["numbers", "bias"])

    model = training_rows(docs, labels).repartition(1).mapInArrow(run, "numbers binary, bias double").first()
    if model is None:  # no labelled row reached the task
        return train([], [])
    return np.frombuffer(bytes(model["numbers"]), np.float32), model["bias"]


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with SCORE in (0, 1); a text's score depends on the text alone."""
    numbers, bias = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            scores = []
            for _, data, offsets in common.blocks(batch, limit=1 << 20):
                sums, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
                for found, at in features(data, offsets):
                    full = np.flatnonzero(np.diff(at))
                    if len(full):
                        sums[full] += np.add.reduceat(weights[found], at[full], dtype=np.float64)
                        n += np.diff(at)
                scores.append(1 / (1 + np.exp(-(bias + sums / np.maximum(n, 1)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names, SCORE])

    return docs.mapInArrow(run, f"{docs.limit(0)._jdf.schema().toDDL()}, {SCORE} double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score in (0, 1)."""
    return _scored(docs.drop("score"), labels).withColumnRenamed(SCORE, "score")


def filter_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least `threshold`."""
    return _scored(docs, labels).where(F.col(SCORE) >= threshold).drop(SCORE)
