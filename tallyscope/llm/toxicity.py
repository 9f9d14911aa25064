"""Toxicity by a factorization machine over hashed terms.

The score of a text with terms T is

    w0 + sum w_i + sum_{i<j} <v_i, v_j>      over the terms of T,

so two terms can mean more together than each alone.  Terms are ASCII
lower-cased words and their first five bytes, hashed to ``BUCKETS`` places.

The machine is fitted on a bounded sample of labelled rows in one task (the
bound is ``sample_rows``); places whose presence does not tell the classes apart
there (chi-square below ``CHI``) are left out.  The model has at most
``BUCKETS`` * (rank + 1) numbers, about 2 MB at the defaults, and goes to the
scoring tasks by a broadcast of that size.  Scoring reads every text once, as a
whole, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyscope.llm.common import fields
from tallyscope.llm.labelled import SAMPLE_ROWS, training_rows
from tallyscope.llm.textbytes import LETTERS, LOWER, Hasher, blocks, buffer_of, runs

BUCKETS = 1 << 16
RANK = 8
PREFIX = 5
CHI = 10.0


def term_places(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(places, bounds): the distinct term places of each text, one after the other."""
    raw, offsets = buffer_of(texts)
    data = LOWER[raw]
    t = runs(LETTERS[data].astype(np.uint8), offsets)
    hashes = Hasher(data)
    word = hashes(t.start, t.end) % np.uint64(buckets)
    long = t.end - t.start > PREFIX
    head = hashes(t.start[long], t.start[long] + PREFIX) % np.uint64(buckets)
    pair = np.concatenate([t.text * buckets + word.astype(np.int64), t.text[long] * buckets + head.astype(np.int64)])
    pair = np.unique(pair)
    return pair % buckets, np.searchsorted(pair, np.arange(len(offsets)) * buckets)


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; 0 for an empty range."""
    upto = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


@dataclass
class Machine:
    """Model: ``slot`` maps a place to a row of ``w`` and ``v`` (0 is the row of left-out places, all zero)."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        at = self.slot[places]
        kept = at > 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        at, bounds = at[kept], upto[bounds]
        sums = totals(self.v[at], bounds)
        squares = totals((self.v[at] ** 2).sum(1), bounds)
        return self.w0 + totals(self.w[at], bounds) + 0.5 * ((sums**2).sum(1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_machine(
    places: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = 30, rate: float = 0.3,
    decay: float = 1e-5, chi: float = CHI, batch: int = 256, seed: int = 11,
) -> Machine:
    """Logistic loss, AdaGrad, in seeded order.  One class alone gives its constant score."""
    n, pos = len(labels), float(labels.sum())
    slot = np.zeros(buckets, np.int32)
    prior = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if not n or not 0 < pos < n:
        return Machine(slot, prior, np.zeros(1), np.zeros((1, rank)))
    flat, rows = np.concatenate(places), np.repeat(np.arange(n), [len(p) for p in places])
    df = np.bincount(flat, minlength=buckets).astype(float)
    both = np.bincount(flat, weights=labels[rows], minlength=buckets)
    expect = df * pos / n
    spread = expect * (1 - pos / n) * (1 - df / n)
    telling = np.flatnonzero((df >= 3) & (np.where(spread > 0, (both - expect) ** 2 / np.maximum(spread, 1e-9), 0) >= chi))
    slot[telling] = np.arange(1, len(telling) + 1)
    lists = [s[s > 0] for s in (slot[p] for p in places)]
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(len(telling) + 1), rng.normal(0, 0.02, (len(telling) + 1, rank)), prior
    v[0] = 0
    gw, gv, g0 = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            some = order[lo : lo + batch]
            sizes = [len(lists[i]) for i in some]
            at, row = np.concatenate([lists[i] for i in some]), np.repeat(np.arange(len(some)), sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            sums = totals(v[at], bounds)
            margin = w0 + totals(w[at], bounds) + 0.5 * ((sums**2).sum(1) - totals((v[at] ** 2).sum(1), bounds))
            error = (sigmoid(margin) - labels[some]) / len(some)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, weights=error[row], minlength=len(used)) + decay * w[used]
            dv = error[row][:, None] * (sums[row] - v[at])
            dv = np.stack([np.bincount(back, weights=dv[:, f], minlength=len(used)) for f in range(rank)], 1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += error.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            w0 -= rate * error.sum() / np.sqrt(g0)
    return Machine(slot, float(w0), w, v)


def learn(
    docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, rank: int = RANK,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Machine:
    """The machine, fitted in one task on at most ``sample_rows`` labelled documents."""
    sample = F.broadcast(training_rows(labels, label_col, usable, sample_rows, id_col))
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(sample, "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                places, bounds = term_places(part.column(2), buckets)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "label", "places"])

    def fit(frames):
        rows = sorted((r for f in frames for r in zip(f["doc_id"], f["label"], f["places"], strict=True)), key=lambda r: (r[0], len(r[2])))
        import pandas as pd

        m = fit_machine([np.asarray(r[2], np.int64) for r in rows], np.array([r[1] for r in rows], float), buckets, rank)
        return iter([pd.DataFrame({"slot": [m.slot.tobytes()], "w0": [m.w0], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})])

    hashed = found.select("doc_id", "label", "text").mapInArrow(terms, "doc_id long, label double, places array<int>")
    row = hashed.repartition(1).mapInPandas(fit, "slot binary, w0 double, w binary, v binary").first()
    if row is None:
        return fit_machine([], np.zeros(0), buckets, rank)
    w = np.frombuffer(row["w"])
    return Machine(np.frombuffer(row["slot"], np.int32), row["w0"], w, np.frombuffer(row["v"]).reshape(len(w), -1))


def score_texts(docs: DataFrame, machine: Machine, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; NULL and empty texts get the score of a text without terms."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                places, bounds = term_places(part.column(1), buckets)
                score = sigmoid(shared.value.margins(places, bounds))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return fields(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id").mapInArrow(run, "doc_id long, score double")


def with_scores(docs: DataFrame, machine: Machine, buckets: int = BUCKETS, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score column behind its own, in one pass and without a shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, at):
                places, bounds = term_places(part.column(at), buckets)
                score = pa.array(sigmoid(shared.value.margins(places, bounds)))
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)
