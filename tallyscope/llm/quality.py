"""Quality scores from random-indexing word vectors and a small network.

Every token place (tokens are case-kept runs of letters and digits, or of other
marks, hashed to ``BUCKETS`` places) has a fixed sparse random index vector.  A
place's word vector is the sum, over the whole corpus, of the index vectors of
the tokens beside it.  These sums are whole numbers, so partial sums of tasks
add up to the same vectors in any order.  The corpus statistic is an aggregate
of at most ``BUCKETS`` rows per task, and the finished vectors, a table of fixed
size (``BUCKETS`` * ``DIMS`` numbers, 1 MB), go to the tasks by a broadcast of
that size.

A document is the mean and the spread of its tokens' vectors.  A two-layer
network is fitted on a bounded sample of labelled documents in one task, and a
temperature is fitted on rows held back from it, which calibrates its
probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import fields
from tallyscope.llm.labelled import SAMPLE_ROWS, training_rows
from tallyscope.llm.textbytes import BLANKS, LETTERS, Hasher, blocks, buffer_of, mixed, runs

BUCKETS = 1 << 13
DIMS = 32
MARKS = 4
HIDDEN = 32
EXTRA = 2


def token_places(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, bounds) of every token in order."""
    raw, offsets = buffer_of(texts)
    t = runs(np.where(BLANKS[raw], 0, np.where(LETTERS[raw], 1, 2)).astype(np.uint8), offsets)
    return (Hasher(raw)(t.start, t.end) % np.uint64(buckets)).astype(np.int64), t.text, t.bounds


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS, marks: int = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the ``marks`` non-zero entries of each place's index vector."""
    h = mixed(np.arange(1, buckets * marks + 1, dtype=np.uint64)).reshape(buckets, marks)
    return ((h >> np.uint64(8)) % np.uint64(dims)).astype(np.int64), np.where(h & np.uint64(1), 1, -1)


def word_vectors(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Unit word vectors (buckets, dims) from all documents; places never seen are zero."""
    names = [f"c{i}" for i in range(dims)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, sign = index_vectors(buckets, dims)
        sums = np.zeros(buckets * dims)
        for batch in batches:
            for part in blocks(batch, 0):
                place, text, _ = token_places(part.column(0), buckets)
                beside = np.flatnonzero(text[1:] == text[:-1])
                for at, by in ((place[beside], place[beside + 1]), (place[beside + 1], place[beside])):
                    for m in range(dim.shape[1]):
                        sums += np.bincount(at * dims + dim[by, m], weights=sign[by, m], minlength=buckets * dims)
        table = sums.reshape(buckets, dims).astype(np.int64)
        seen = np.flatnonzero(np.abs(table).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(table[seen, i]) for i in range(dims)]], ["place", *names])

    sums = fields(docs, text_col).mapInArrow(gather, ", ".join(f"{n} long" for n in ["place", *names]))
    rows = sums.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = np.zeros((buckets, dims))
    for r in rows:
        out[r["place"]] = r[1:]
    out = np.sign(out) * np.log1p(np.abs(out))
    out -= out[np.abs(out).sum(1) > 0].mean(0) if rows else 0
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm > 0, out / np.maximum(norm, 1e-12), 0).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * dims + EXTRA): mean and spread of the token vectors, length and share of repeated neighbours."""
    place, text, bounds = token_places(texts, len(vectors))
    n, dims = len(bounds) - 1, vectors.shape[1]
    count = np.maximum(np.diff(bounds), 1).astype(np.float32)[:, None]
    out = np.zeros((n, 2 * dims + EXTRA), np.float32)
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if a < b:
            places, times = np.unique(place[a:b], return_counts=True)
            v, t = vectors[places], times.astype(np.float32)
            out[i, :dims], out[i, dims : 2 * dims] = t @ v, t @ (v * v)
    out[:, : 2 * dims] /= count
    out[:, dims : 2 * dims] = np.sqrt(np.maximum(out[:, dims : 2 * dims] - out[:, :dims] ** 2, 0))
    out[:, 2 * dims] = np.log1p(np.diff(bounds))
    same = (text[1:] == text[:-1]) & (place[1:] == place[:-1])
    out[:, 2 * dims + 1] = np.bincount(text[1:][same], minlength=n)[:n] / count[:, 0]
    return out


@dataclass
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the logit."""

    shift: np.ndarray
    scale: np.ndarray
    layers: list = field(default_factory=list)
    bias: float = 0.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.bias)
        a, b, c, d = self.layers
        return np.tanh((x - self.shift) / self.scale @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, batch: int = 128, seed: int = 5) -> Network:
    """Adam on log loss, in seeded order; every fifth row is kept back for the temperature.

    One class alone gives its constant score.
    """
    n, pos = len(y), float(y.sum())
    if not n or not 0 < pos < n:
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), bias=float(np.log((pos + 0.5) / (n - pos + 0.5))))
    rng = np.random.default_rng(seed)
    held = np.arange(n) % 5 == 4
    net = Network(x.mean(0), x.std(0) + 1e-6)
    z = (x - net.shift) / net.scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.log((pos + 0.5) / (n - pos + 0.5))]
    m, s, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        order = rng.permutation(train)
        for lo in range(0, len(order), batch):
            i = order[lo : lo + batch]
            h = np.tanh(z[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -35, 35))) - y[i]) / len(i)
            back = e[:, None] * p[2] * (1 - h * h)
            grads = [z[i].T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], e.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * np.square(g)
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    net.layers = p
    logit, target = net.logits(x[held]), y[held]
    best = [(np.logaddexp(0, np.where(target > 0, -logit, logit) / t).sum(), t) for t in np.geomspace(0.25, 8, 61)] if held.any() else []
    net.temperature = float(min(best)[1]) if best else 1.0
    return net


def quality_scores(
    docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, dims: int = DIMS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """(doc_id, score) of every row.

    Word vectors come from all documents, labels only from ``usable`` rows.
    Document vectors are written once to the shared folder: the fit reads the
    sampled ones, the scores all of them.  NULL and empty texts are the vector
    of a text without tokens.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col, buckets, dims))
    width = 2 * dims + EXTRA

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                x = pooled(part.column(1), vectors.value)
                raw = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), raw], ["doc_id", "vector"])

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), width)

    points = checkpointed(fields(docs, id_col, text_col).mapInArrow(pool, "doc_id long, vector binary"))
    sample = F.broadcast(training_rows(labels, label_col, usable, sample_rows, id_col))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([*batches] or [pa.RecordBatch.from_pydict({"label": pa.array([], pa.float64()), "vector": pa.array([], pa.binary())})])
        raw, y = t.column("vector").to_pylist(), np.array(t.column("label").to_pylist(), float)
        order = sorted(range(len(raw)), key=lambda i: (raw[i], y[i]))
        spread = np.random.default_rng(3).permutation(len(order))
        order = [order[i] for i in spread]
        x = np.frombuffer(b"".join(raw[i] for i in order), np.float32).reshape(len(order), width).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_network(x, y[order]))], pa.binary())], ["model"])

    row = points.join(sample, "doc_id").select("label", "vector").repartition(1).mapInArrow(fit, "model binary").first()
    model = spark.sparkContext.broadcast(pickle.loads(row["model"]) if row else fit_network(np.zeros((0, width)), np.zeros(0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.value.scores(matrix(batch.column(1)).astype(float)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["doc_id", "score"])

    return points.mapInArrow(score, "doc_id long, score double")
