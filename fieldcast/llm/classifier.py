"""Supervised subword embeddings: a quality classifier.

Each word, each run of three or four bytes inside a word (its bordering blank
included) and each word said twice in a row is hashed to a learned vector. A
document is the mean of its vectors; a softmax over two classes follows. Numpy
stochastic gradient descent trains it on at most ``per_class`` labelled
documents of each class, the first by a hash of the id: the one bounded sample,
a parameter. Since softmax over a mean is linear in the vectors, scoring needs
only each feature's own difference of class scores, one number per bucket; that
table is what goes to the workers, and its size is fixed by ``buckets``.

Scores depend on the text alone. Null and empty texts score by the bias. A row
per input row; duplicate labels of an id count as often as they stand, labels
that are null or belong to no document are left out. With no label of a class
every document scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._bytes import (U64, _tables, byte_values, mix, powers, spans, text_bytes,
                                  text_chunks)
from fieldcast.llm._ship import shipped
from fieldcast.llm._text import free_name

BUCKETS = 1 << 18
PER_CLASS = 1500
THRESHOLD = 0.7


def feature_ids(col: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature of every row."""
    raw, at = text_bytes(col)
    _, inside = _tables(False)
    starts, ends, _ = spans(raw, at, inside)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    value = byte_values(5)[raw]
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(value * powers(len(raw)), out=total[1:])
    word = mix((total[ends] - total[starts])
               * powers(len(raw) + 1, pow(0x5851F42D4C957F2D, -1, 1 << 64))[starts])
    word_row = row_of[starts]
    again = np.flatnonzero((word[1:] == word[:-1]) & (word_row[1:] == word_row[:-1]))
    ids, rows = [word, np.full(len(again), U64(1) << U64(63))], [word_row, word_row[again]]
    blank = ~inside[raw]
    for n in (3, 4):
        if len(raw) < n:
            continue
        m = len(raw) - n + 1
        h = np.full(m, U64(n))
        for j in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + value[j:j + m]
        ok = row_of[:m] == row_of[n - 1:]
        for j in range(1, n - 1):  # a blank only at the borders
            ok &= ~blank[j:j + m]
        keep = np.flatnonzero(ok)
        ids.append(mix(h[keep]))
        rows.append(row_of[keep])
    return (np.concatenate(ids) >> U64(20)) % U64(buckets), np.concatenate(rows)


class Model:
    """One number per bucket and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, col: pa.Array) -> np.ndarray:
        ids, rows = feature_ids(col, len(self.weights))
        total = np.bincount(rows, self.weights[ids], len(col))
        mean = total / np.maximum(np.bincount(rows, minlength=len(col)), 1)
        return 1 / (1 + np.exp(-(mean + self.bias)))


def train(texts: list[str | None], labels: list[int], buckets: int = BUCKETS, dim: int = 8,
          epochs: int = 12, rate: float = 4.0, seed: int = 7) -> Model:
    """Fits vectors and softmax by stochastic gradient descent, a document a step."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(buckets, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    docs = []
    for t in texts:
        ids, n = np.unique(feature_ids(pa.array([t], pa.string()), buckets)[0], return_counts=True)
        docs.append((ids.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)))
    weight = len(y) / (2 * np.bincount(y, minlength=2))  # classes count alike
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            own = vectors[ids]
            mean = share @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = (p * weight[y[i]] * step).astype(np.float32)
            back = out @ g
            out -= np.clip(np.outer(mean, g), -1, 1)
            bias -= 0.02 * g
            vectors[ids] = own - share[:, None] * back
    diff = out[:, 1] - out[:, 0]
    return Model(vectors @ diff, float(bias[1] - bias[0]))


def held_out(doc_id) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **options) -> Model:
    """The model of ``labels.quality``, from rows that are not held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(
        ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("_y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("_y = 0").orderBy(*order).limit(per_class).unionByName(
        known.where("_y = 1").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "_y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sample = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("_y", "ascending")])
        model = train(sample["text"].to_pylist(), sample["_y"].to_pylist(), **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()]), pa.array([model.bias])],
                                         names=["weights", "bias"])

    # the sample is bounded, so a task holds it; the driver gets the numbers only
    got = shipped(rows).repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    if got is None:
        return train([], [], **options)
    return Model(np.frombuffer(got["weights"], np.float32), got["bias"])


def with_scores(docs: DataFrame, model: Model, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(sent.value.scores(part.column("text")))],
                names=[*part.schema.names, name])

    return shipped(docs).mapInArrow(score, docs.withColumn(name, F.lit(0.0)).schema)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = with_scores(docs.select("doc_id", "text"), fit(docs, labels, **options), "score")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame, at: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier calls good more likely than not."""
    name = free_name(docs, "score")
    return with_scores(docs, fit(docs, labels, **options), name).where(F.col(name) >= at).drop(name)
