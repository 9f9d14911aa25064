"""Principal components of sparse counts, never made dense.

Block subspace iteration with implicit centring.  With the feature means m and
an orthonormal block Q of directions,

    P = X Q - 1 (mᵀ Q)        one aggregate over the stored cells by observation
    Y = Xᵀ P                  one aggregate over the stored cells by feature

and Y is the covariance times Q (times n - 1): the columns of P sum to zero, so
centring X once more changes nothing.  Only block × block matrices reach the
driver.  The Rayleigh-Ritz step turns P's covariance into the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.operators.gram import gram_summaries


@dataclass(frozen=True)
class Components:
    """``scores(obs_id, pc)``, ``loadings(feature_id, loading)``, the variance of each component and of the table; ``rounds`` run."""

    scores: DataFrame
    loadings: DataFrame
    variances: list[float]
    total_variance: float
    rounds: int


def _turned(rows: DataFrame, id_col: str, names: list[str], turn: np.ndarray) -> DataFrame:
    """Columns of ``rows`` times a small matrix, as columns again."""
    sent = rows.sparkSession.sparkContext.broadcast(turn)
    width = turn.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame(f[names].to_numpy(float) @ sent.value, columns=[f"c{i}" for i in range(width)])
            out.insert(0, id_col, f[id_col].to_numpy())
            yield out

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, *names).mapInPandas(run, ", ".join([f"`{id_col}` {kind}", *[f"c{i} double" for i in range(width)]]))


# Up to so many features the block holds all directions, and one round is exact.
WHOLE = 128


def sparse_pca(cells: DataFrame, obs: DataFrame, k: int, extra: int = 10, rtol: float = 1e-8, max_rounds: int = 60, seed: int = 0, whole: int = WHOLE) -> Components:
    """The first k principal components of ``cells(obs_id, feature_id, value)`` over the rows of ``obs``; absent cells are zero.

    ``extra`` more directions are carried along, which speeds up convergence;
    with up to ``whole`` features all directions are.
    Rounds end when no wanted variance moves by more than ``rtol`` of the
    largest; RuntimeError after ``max_rounds``.  Fewer than k components are
    returned where the table has a smaller rank.  Signs are such that the
    largest loading of a component is positive.  Needs two observations.
    """
    spark = cells.sparkSession
    rows = obs.select("obs_id").distinct()
    stored = checkpointed(cells.where(F.col("value") != 0).select("obs_id", "feature_id", F.col("value").cast("double").alias("x")).join(rows, "obs_id", "left_semi"))
    n = rows.count()
    if n < 2:
        raise ValueError("components need two observations")
    x = F.col("x")
    means = checkpointed(stored.groupBy("feature_id").agg((F.sum("x") / n).alias("mean"), F.sum(x * x).alias("_q")))
    square = F.sum(F.col("_q") - n * F.col("mean") * F.col("mean")) / (n - 1)
    features, total = means.agg(F.count(F.lit(1)), F.coalesce(square, F.lit(0.0))).first()
    width = features if features <= whole else min(features, k + extra)
    # a start that depends on feature ids alone
    draw = lambda i: F.pmod(F.xxhash64("feature_id", F.lit(seed), F.lit(i)), F.lit(1 << 30)).cast("double") / float(1 << 29) - 1.0
    block = means.select("feature_id", *[draw(i).alias(f"c{i}") for i in range(width)])
    before = None
    for step in range(1, max_rounds + 1):
        names = [c for c in block.columns if c.startswith("c")]
        block = checkpointed(_turned(block, "feature_id", names, _orthonormal(block, names)))
        names = [c for c in block.columns if c.startswith("c")]
        if not names:
            empty = rows.select("obs_id", F.array().cast("array<double>").alias("pc"))
            return Components(empty, means.select("feature_id", F.array().cast("array<double>").alias("loading")), [], total, step)
        centre = block.join(means, "feature_id").agg(*[F.sum(F.col("mean") * F.col(c)).alias(c) for c in names]).first()
        sums = stored.join(block, "feature_id").groupBy("obs_id").agg(*[F.sum(x * F.col(c)).alias(c) for c in names])
        placed = rows.join(sums, "obs_id", "left").fillna(0.0, names)
        placed = checkpointed(placed.select("obs_id", *[(F.col(c) - F.lit(centre[c])).alias(c) for c in names]))
        spread = gram_summaries(placed, F.array(*names)).first()
        values, turn = np.linalg.eigh(np.array(spread["comoment"]).reshape(len(names), len(names)) / (n - 1))
        values, turn = values[::-1], turn[:, ::-1]
        now = np.maximum(values[:k], 0.0)
        if len(names) >= features or (before is not None and len(before) == len(now) and np.abs(now - before).max(initial=0.0) <= rtol * now.max(initial=0.0)):
            break
        before = now
        block = checkpointed(stored.join(placed, "obs_id").groupBy("feature_id").agg(*[F.sum(x * F.col(c)).alias(c) for c in names]))
    else:
        raise RuntimeError("the components did not settle")
    turn = turn[:, : len(now)]
    loadings = checkpointed(_turned(block, "feature_id", names, turn))
    wanted = [f"c{i}" for i in range(len(now))]
    lead = loadings.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in wanted]).first()
    sign = np.array([1.0 if lead[c] >= 0 else -1.0 for c in wanted])
    flipped = lambda df, key, name: df.select(key, F.array(*[F.col(c) * float(s) for c, s in zip(wanted, sign, strict=True)]).alias(name))
    scores = _turned(placed, "obs_id", names, turn)
    return Components(flipped(scores, "obs_id", "pc"), flipped(loadings, "feature_id", "loading"), now.tolist(), float(total), step)


def _orthonormal(block: DataFrame, names: list[str]) -> np.ndarray:
    """The matrix that makes the columns orthonormal, without directions that are no more than rounding."""
    g = gram_summaries(block, F.array(*names)).first() if names else None
    if g is None:
        return np.zeros((len(names), 0))
    mean = np.array(g["mean"])
    square = np.array(g["comoment"]).reshape(len(names), len(names)) + g["n"] * np.outer(mean, mean)
    values, turn = np.linalg.eigh(square)
    kept = values > 1e-13 * values.max(initial=0.0)
    return turn[:, kept] / np.sqrt(values[kept])
