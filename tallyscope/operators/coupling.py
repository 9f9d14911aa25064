"""What scores need of a coupling: one row per moving and per reference observation.

``marginals`` reduces a long coupling (ref_idx, mov_idx, mass).  Where the mass is
a function of the distance, ``radius_marginals`` never forms the long table: a
pair of blocks is reduced in its task to sums and best partners, so the output is
at most a row per observation and block pair, not one per pair within the radius.

Both give (side, idx, total, best, choice, true_mass, sx, sy): the mass of the row
or column, its largest mass and the partner that has it (ties to the lowest
index), and for moving rows the mass on the true partner and the sums of mass
times reference coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.operators.neighbors import BLOCK_ROWS, blocked
from tallyscope.operators.pairpass import again, distance_rows

CLOSE = 1e-9
# much is done once per piece here, so that larger pieces pay
CELLS = 1 << 20
COLUMNS = ("side", "idx", "total", "best", "choice", "true_mass", "sx", "sy")


def _merged(parts: DataFrame) -> DataFrame:
    first = F.min(F.struct((-F.col("best")).alias("m"), F.col("choice").alias("o")))
    return checkpointed(parts.groupBy("side", "idx").agg(
        F.sum("total").alias("total"), first.alias("_b"), *[F.sum(c).alias(c) for c in ("true_mass", "sx", "sy")]
    ).select("side", "idx", "total", (-F.col("_b.m")).alias("best"), F.col("_b.o").alias("choice"), "true_mass", "sx", "sy"))


def marginals(coupling: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """The summary of a long coupling; ``truth`` is (mov_idx, ref_idx).  Without coordinates sx and sy are NULL."""
    none = F.lit(None).cast("double")
    known = coupling.select("ref_idx", "mov_idx", "mass", none.alias("_none"))
    if truth is not None:
        known = known.join(truth.select("mov_idx", F.col("ref_idx").alias("_true")), "mov_idx", "left")
        known = known.withColumn("_t", F.when(F.col("ref_idx") == F.col("_true"), F.col("mass")).otherwise(0.0))
    side = lambda name, own, other, true: known.select(
        F.lit(name).alias("side"), F.col(own).alias("idx"), F.col("mass").alias("total"), F.col("mass").alias("best"), F.col(other).alias("choice"),
        F.col(true).alias("true_mass"), F.col("_none").alias("sx"), F.col("_none").alias("sy"),
    )
    return _merged(side("mov", "mov_idx", "ref_idx", "_none" if truth is None else "_t").unionByName(side("ref", "ref_idx", "mov_idx", "_none")))


def _block(radius: float, mass: Callable[[np.ndarray], np.ndarray]):
    def weigh(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = np.sqrt(d2)
        near = gap < radius
        w = np.zeros(d2.shape)
        w[near] = mass(gap[near])
        return near, w, np.where(near, w, -np.inf)

    def reduce(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # in the order of ids, so that the first of equal masses is that of the lowest
        a, b = a.sort_values("id"), b.sort_values("id")
        mov, ref, out = *(x["id"].to_numpy(dtype=object if x["id"].dtype.kind not in "iuf" else None) for x in (a, b)), []
        at = b[["_rx", "_ry"]].to_numpy(dtype=float)
        true = np.where(a["_has"].to_numpy(), pd.Index(ref).get_indexer(a["_true"]), -1)
        total, best, choice, met = np.zeros(len(ref)), np.full(len(ref), -np.inf), np.zeros(len(ref), dtype=int), np.zeros(len(ref), dtype=bool)
        x, y = (np.stack(f["vec"].to_numpy()).astype(float) for f in (a, b))
        for part, d2 in distance_rows(x, y, CELLS):
            again(d2, x[part], y, np.abs(d2 - radius * radius) <= CLOSE * radius * radius)
            # pairs beyond the radius are no partners, even of mass 0
            near, w, top = weigh(d2)
            # of nearly equal masses the exact ones decide
            lead = top.max(axis=1, keepdims=True), np.maximum(top.max(axis=0), best)
            tied = near & ((top >= lead[0] - CLOSE * np.abs(lead[0])) | (top >= lead[1] - CLOSE * np.abs(lead[1])))
            again(d2, x[part], y, tied)
            top[tied] = w[tied] = mass(np.sqrt(d2[tied]))
            own, t = near.any(axis=1), true[part]
            won = top.argmax(axis=1)
            rows = np.arange(len(w))
            whole = (np.full(len(w), "mov"), mov[part], w.sum(axis=1), top[rows, won], ref[won], np.where(t >= 0, w[rows, t], 0.0), w @ at[:, 0], w @ at[:, 1])
            out.append([c[own] for c in whole])
            total += w.sum(axis=0)
            met |= near.any(axis=0)
            lead = top.max(axis=0)
            ahead = lead > best
            best[ahead], choice[ahead] = lead[ahead], part.start + top.argmax(axis=0)[ahead]
        none = np.full(len(ref), np.nan)
        out.append([c[met] for c in (np.full(len(ref), "ref"), ref, total, best, mov[choice], none, none, none)])
        # columns are put together before the frame is made: frames put together would hold strings in chunks
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(COLUMNS, zip(*out, strict=True), strict=True)})

    return reduce


def radius_marginals(
    mov: DataFrame, ref: DataFrame, radius: float, mass: Callable[[np.ndarray], np.ndarray], truth: DataFrame | None = None,
    id_col: str = "obs_id", vec: str = "vec", dims: Sequence[str] = ("x", "y"), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The summary of the coupling ``mass(distance)`` over all pairs closer than ``radius``.

    ``mass`` takes and returns an array; the result must be finite and not negative.
    Rows without a vector take no part, nor do rows without a partner; ids of
    both sides are of one type and unique.  All block pairs are visited, so the
    work is that of all pairs, while output and memory per task are bounded.
    """
    x, y = (F.col(d).cast("double") for d in dims)
    right = ref.where(F.col(vec).isNotNull()).select(id_col, vec, x.alias("_rx"), y.alias("_ry"))
    left = mov.where(F.col(vec).isNotNull()).select(id_col, vec)
    if truth is None:
        left = left.withColumns({"_true": F.col(id_col), "_has": F.lit(False)})
    else:
        true = truth.select(F.col("mov_idx").alias(id_col), F.col("ref_idx").alias("_true"))
        # no NULL reaches pandas, where it would turn large integers into doubles
        left = left.join(true, id_col, "left").withColumns({"_has": F.col("_true").isNotNull(), "_true": F.coalesce("_true", id_col)})
    kind = ref.schema[id_col].dataType.simpleString()
    schema = f"side string, idx {kind}, total double, best double, choice {kind}, true_mass double, sx double, sy double"
    parts = blocked(left, right, _block(radius, mass), schema, (), id_col, vec, ["_true", "_has"], ["_rx", "_ry"], block_rows)
    nan_free = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("true_mass", "sx", "sy")]
    wrong = F.isnan("total") | (F.abs("total") == float("inf")) | (F.col("best") < 0)
    ok = F.when(wrong, F.raise_error("coupling mass must be finite and non-negative").cast("boolean")).otherwise(True)
    return _merged(parts.where(ok).select("side", "idx", "total", "best", "choice", *nan_free))
