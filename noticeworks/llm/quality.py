"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each word owns a sparse random index vector, drawn from its hash. The vector of a word is the sum of the
index vectors of its neighbours over the training sample, so words used alike look alike, and a share of its
own; the random directions stay in place whatever the corpus. Words beyond the most frequent of the sample
have their own index vector alone, and every word's shape (case, digits, symbols at both ends) has one too.
A document is the mean of both over all its words, read by a two-layer network whose probabilities are
calibrated with one temperature.

Only fitting is bounded (``Params.sample`` labelled rows, ``Params.words`` words with neighbours); scoring
reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, by_bytes, documents, in_arrow, mix64, text_or_empty, words_of


#: Rows of a step: counts of words by row are dense.
ROWS = 256
#: Share of its own index vector in a word's vector.
OWN = 0.5
#: Parts of the labelled sample, which is bounded; each sends one matrix of word vectors to the driver.
PARTS = 16
#: Scores from here on are taken for label 1.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Params:
    sample: int = 16_000  # labelled rows that the model is fitted on, the first by a hash of doc_id
    words: int = 4_096  # words with a vector of their own: the most frequent in the sample
    dims: int = 64
    nonzero: int = 6  # entries of an index vector that aren't 0
    shapes: int = 2_048
    hidden: int = 32
    epochs: int = 40
    seed: int = 7


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def index_vectors(hashes: np.ndarray, p: Params) -> np.ndarray:
    """Sparse random vectors of hashes: some entries 1 or -1."""
    out = np.zeros((len(hashes), p.dims), np.float32)
    rows = np.arange(len(hashes))
    with np.errstate(over="ignore"):
        for k in range(p.nonzero):
            h = mix64(hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
            np.add.at(out, (rows, (h % np.uint64(p.dims)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out


def index_sums(hashes: np.ndarray, doc: np.ndarray, n: int, p: Params) -> np.ndarray:
    """Of each of ``n`` documents, the sum of the index vectors of its words."""
    out = np.zeros(n * p.dims)
    with np.errstate(over="ignore"):
        for k in range(p.nonzero):
            h = mix64(hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
            out += np.bincount(doc * p.dims + (h % np.uint64(p.dims)).astype(np.int64), weights=np.where(h >> np.uint64(63), 1.0, -1.0), minlength=n * p.dims)
    return out.reshape(n, p.dims).astype(np.float32)


def tokens(texts: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, their shapes, and the first word of each row."""
    hashes, offsets, starts, ends = words_of(texts, NON_SPACE, LOWER)
    if not len(starts):
        return hashes, np.empty(0, np.int64), offsets
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    shape = _SHAPE[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]]
    size = ends - starts
    code = np.minimum(size, 15).astype(np.uint64)
    for k in (0, 1):
        code = code * np.uint64(256) + np.where(size > k, shape[np.minimum(starts + k, len(shape) - 1)], 0)
    for k in (1, 2, 3):
        code = code * np.uint64(256) + np.where(size >= k, shape[ends - np.minimum(k, size)], 0)
    with np.errstate(over="ignore"):
        return hashes, (mix64(code) % np.uint64(p.shapes)).astype(np.int64), offsets


@dataclass
class Model:
    params: Params
    known: np.ndarray  # hashes of the words with a vector, in order
    vectors: np.ndarray  # theirs, and a last row of 0
    shape_vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def pooled(self, texts: pa.Array) -> np.ndarray:
        p, n = self.params, len(texts)
        hashes, shape, offsets = tokens(texts, p)
        counts = np.diff(offsets)
        doc = np.repeat(np.arange(n), counts)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1) if len(self.known) else np.zeros(len(hashes), np.int64)
        known = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        word = np.where(known, at, len(self.known))
        width = len(self.vectors)
        size = np.maximum(counts, 1)[:, None].astype(np.float32)
        a = np.bincount(doc * width + word, minlength=n * width).reshape(n, width).astype(np.float32) @ self.vectors
        a += index_sums(hashes[~known], doc[~known], n, p) * np.float32(OWN / p.nonzero**0.5)
        b = np.bincount(doc * p.shapes + shape, minlength=n * p.shapes).reshape(n, p.shapes).astype(np.float32) @ self.shape_vectors
        return np.concatenate([a / size, b / size, np.log1p(counts)[:, None].astype(np.float32)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)) / self.temperature, -60, 60)))


def _texts(batches: Iterator[pa.RecordBatch], column: str = "t", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for b in by_bytes(batches, column, most, ROWS):
        yield b, b.column(b.schema.get_field_index(column))


def labelled(docs: DataFrame, labels: DataFrame, train: F.Column, p: Params, label: str = "quality") -> DataFrame:
    """``(id, t, y)`` of the sample: labelled rows that may be learnt from, the first by a hash of their id."""
    y = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")).where(train)
    y = y.orderBy(F.xxhash64("id"), "id").limit(p.sample)
    # at most Params.sample pairs of an id and a label
    return docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("t")).join(F.broadcast(y), "id")


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, p: Params = Params()) -> Model:
    """A model of ``labels.quality``, learnt from rows where ``train`` (an expression on ``id``) holds.

    Without any labelled row, or with one class only, the model gives that class's share (0.5 without any).
    """
    sample = labelled(docs, labels, train, p).repartition(PARTS, "id").persist()
    try:

        def count(batches):
            for _, t in _texts(batches):
                h, n = np.unique(tokens(t, p)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        top = sample.transform(in_arrow, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 5").orderBy(F.desc("n"), "h").limit(p.words)
        known = np.sort(np.array([r.h for r in top.select("h").toLocalIterator()], np.int64).view(np.uint64))

        def contexts(batches):
            total = np.zeros((len(known), p.dims), np.float64)
            for _, t in _texts(batches):
                hashes, _, offsets = tokens(t, p)
                if len(hashes) < 2 or not len(known):
                    continue
                uniq, inverse = np.unique(hashes, return_inverse=True)
                vec = index_vectors(uniq, p)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                own = known[at] == hashes
                within = np.ones(len(hashes) - 1, bool)
                inner = offsets[1:-1]
                within[inner[(inner > 0) & (inner < len(hashes))] - 1] = False
                for me, other, shift in ((np.arange(len(hashes) - 1), np.arange(1, len(hashes)), 1), (np.arange(1, len(hashes)), np.arange(len(hashes) - 1), -1)):
                    pick = within & own[me]
                    flat = at[me[pick]] * len(uniq) + inverse[other[pick]]
                    pairs, n = np.unique(flat, return_counts=True)
                    # a neighbour before and one behind turn the index vector in different ways
                    np.add.at(total, pairs // len(uniq), np.roll(vec, shift, 1)[pairs % len(uniq)] * n[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        total = np.zeros((len(known), p.dims))
        for r in sample.transform(in_arrow, contexts, "v binary").toLocalIterator():
            total += np.frombuffer(r.v).reshape(total.shape)
        total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
        vectors = np.concatenate([total, np.zeros((1, p.dims))]).astype(np.float32)
        own = np.concatenate([index_vectors(known, p), np.zeros((1, p.dims), np.float32)]) / np.sqrt(p.nonzero)
        shapes = index_vectors(mix64(np.arange(1, p.shapes + 1, dtype=np.uint64)), p)
        width = 2 * p.dims + 1
        model = Model(p, known, (vectors + OWN * own).astype(np.float32), shapes, np.zeros(width, np.float32), np.ones(width, np.float32), (np.zeros((width, p.hidden)), np.zeros(p.hidden), np.zeros(p.hidden), 0.0), 1.0)

        def features(batches):
            for b, t in _texts(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x in model.pooled(t)], pa.binary())], ["id", "y", "x"])

        kind = sample.schema["id"].dataType.simpleString()
        rows = sample.select("id", "t", "y").transform(in_arrow, features, f"id {kind}, y int, x binary").toPandas().sort_values("id", kind="stable")
    finally:
        sample.unpersist()
    y = rows.y.to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        model.weights = (*model.weights[:3], float(np.log((share + 1e-4) / (1 - share + 1e-4))))
        return model
    x = np.frombuffer(b"".join(rows.x), np.float32).reshape(len(y), width).astype(np.float64)
    _train(model, x, y, p)
    return model


def _train(model: Model, x: np.ndarray, y: np.ndarray, p: Params) -> None:
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 6], order[len(y) // 6 :]
    model.mean, model.scale = x[learn].mean(0), x[learn].std(0) + 1e-6
    z = (x - model.mean) / model.scale
    w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], p.hidden)), np.zeros(p.hidden), rng.normal(0, p.hidden**-0.5, p.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in w], [np.zeros_like(q) for q in w], 0
    for _ in range(p.epochs):
        rng.shuffle(learn)
        for i in range(0, len(learn), 256):
            k = learn[i : i + 256]
            h = np.tanh(z[k] @ w[0] + w[1])
            out = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -60, 60)))
            d = (out - y[k]) / len(k)
            dh = d[:, None] * w[2] * (1 - h * h)
            grads = [z[k].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            step += 1
            for q, g, a, b in zip(w, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 3e-3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model.weights = (w[0], w[1], w[2], float(w[3][0]))
    logits, yh = model.logits(x[held]), y[held]
    if len(yh):
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(yh > 0, -1, 1) * logits / t).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, score)``: the probability of label 1, from the whole text alone.

    Null and empty texts get the score of a document without words. Repeated rows give equal scores,
    null ids stay null, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size bound by Params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in _texts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(t).astype(np.float64))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t")).transform(in_arrow, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose score is THRESHOLD or more, with all their columns; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text, 1 << 20, ROWS):
            t = b.column(at)
            yield b.filter(pa.array(shared.value.scores(t.fill_null("") if t.null_count else t) >= THRESHOLD))

    return docs.transform(in_arrow, run, docs.schema)


def _fold(column: str):
    return F.crc32(F.col(column).cast("string")) % 5



def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _fold("id") != 0)
    out = score(docs, model)
    return out.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
