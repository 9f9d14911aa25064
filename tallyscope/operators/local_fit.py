"""Local quadratic regression at every point, without all pairs.

A tricube weight is a polynomial of degree nine in the gap on either side of the
point, so the weighted sums of a fit are combinations of plain moments of the
points in its window.  Points are numbered in order of x; moments are kept per
dyadic block of positions, and a window is at most two blocks per level on
either side.  That is n log n rows for n fits.  A block lies on one side of the
point and inside the window, so its moments, shifted to the point and scaled by
the bandwidth, stay small and nothing cancels as it would with running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.ordered import positions, running_totals
from tallyscope.functions.session import checkpointed

# (1 - u^3)^3 = 1 - 3 u^3 + 3 u^6 - u^9
TRICUBE = ((0, 1.0), (3, -3.0), (6, 3.0), (9, -1.0))
N_PLAIN, N_WITH_Y = 14, 12  # degrees 9 + 4 of the weights alone, 9 + 2 with y
SUMS = [f"s{i}" for i in range(5)] + [f"t{i}" for i in range(3)]
SOLID = 1e-10  # below this determinant (per cube of the total weight) the fit is the weighted mean


def _windows(placed: DataFrame, n: int, k: int) -> DataFrame:
    """(pos, x, first, last, h): positions of the k nearest points in x, and the gap to the farthest.

    The window of k positions moves on from ``l`` where x passes the middle of the
    points ``l`` and ``l + k``, so its start is the number of such middles below x.
    """
    at = placed.select(F.col("pos").alias("_at"), F.col("x").alias("_x"))
    ahead = at.withColumn("_at", F.col("_at") - k)
    middles = at.join(ahead.withColumnRenamed("_x", "_y"), "_at").select(((F.col("_x") + F.col("_y")) / 2).alias("v"), F.lit(1).alias("m"))
    marks = middles.unionByName(placed.select(F.col("x").alias("v"), F.lit(0).alias("m"))).groupBy("v").agg(F.sum("m").alias("m"))
    below = running_totals(marks, (), "v", ["m"]).select(F.col("v").alias("x"), (F.col("cum_m") - F.col("m")).alias("first"))
    w = placed.select("pos", "x").join(below, "x").withColumn("last", F.col("first") + k - 1)
    w = w.join(at.select(F.col("_at").alias("first"), F.col("_x").alias("_lo")), "first")
    w = w.join(at.select(F.col("_at").alias("last"), F.col("_x").alias("_hi")), "last")
    return w.select("pos", "x", "first", "last", F.greatest(F.col("x") - F.col("_lo"), F.col("_hi") - F.col("x"), F.lit(1e-9)).alias("h"))


def _halved(position: Column, times: Column) -> Column:
    return F.call_function("shiftright", position, times)


def _cover(start: Column, end: Column, level: Column) -> Column:
    """Blocks of one level in the dyadic cover of the positions from ``start`` to before ``end``."""
    lo = _halved(start + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
    hi = _halved(end, level)
    left = F.when((lo < hi) & (lo % 2 == 1), lo)
    right = F.when((lo < hi) & (hi % 2 == 1), hi - 1)
    return F.array(left, right)


def _pieces(windows: DataFrame, levels: int) -> DataFrame:
    """(pos, x, h, side, level, block): the cover of the window left (itself included) and right of every point."""
    one = F.lit(1).cast("long")
    left = F.struct(F.lit(-1.0).alias("side"), F.col("first").alias("a"), (F.least("pos", "last") + one).alias("b"))
    right = F.struct(F.lit(1.0).alias("side"), F.greatest(F.col("pos") + one, F.col("first")).alias("a"), (F.col("last") + one).alias("b"))
    sides = windows.select("pos", "x", "h", F.inline(F.array(left, right))).where("a < b")
    spread = sides.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    spread = spread.select("pos", "x", "h", "side", "level", F.explode(_cover(F.col("a"), F.col("b"), F.col("level"))).alias("block"))
    return spread.where(F.col("block").isNotNull())


def _blocks(placed: DataFrame, levels: int) -> DataFrame:
    """(level, block, c, m0…, q0…): moments of x - c and of (x - c)·y, where c is the block's least x."""
    rows = placed.select("x", "y", "pos", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    rows = rows.select("x", "y", "level", _halved(F.col("pos"), F.col("level")).alias("block"))
    keys = ["level", "block"]
    d = F.col("x") - F.col("c")
    return rows.join(rows.groupBy(*keys).agg(F.min("x").alias("c")), keys).groupBy(*keys, "c").agg(
        *[F.sum(F.pow(d, F.lit(i))).alias(f"m{i}") for i in range(N_PLAIN)],
        *[F.sum(F.pow(d, F.lit(i)) * F.col("y")).alias(f"q{i}") for i in range(N_WITH_Y)],
    )


def _shifted(moments: np.ndarray, by: np.ndarray, scale: np.ndarray) -> list[np.ndarray]:
    """Moments about c as moments of (x - x0) / h, given (c - x0) / h and h."""
    n = moments.shape[1]
    own = [moments[:, j] / scale**j for j in range(n)]
    powers = [by**j for j in range(n)]
    return [sum(comb(m, j) * powers[m - j] * own[j] for j in range(m + 1)) for m in range(n)]


def _weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What one block adds to the sums of one fit."""
    plain, with_y = [f"m{i}" for i in range(N_PLAIN)], [f"q{i}" for i in range(N_WITH_Y)]
    for b in batches:
        h, side = b["h"].to_numpy(), b["side"].to_numpy()
        gap = (b["c"].to_numpy() - b["x"].to_numpy()) / h
        m, q = _shifted(b[plain].to_numpy(), gap, h), _shifted(b[with_y].to_numpy(), gap, h)
        out = {"pos": b["pos"]}
        for names, t in ((SUMS[:5], m), (SUMS[5:], q)):
            for i, name in enumerate(names):
                out[name] = sum(a * side**p * t[i + p] for p, a in TRICUBE)
        yield pd.DataFrame(out)


def local_quadratic(points: DataFrame, span: float = 0.3, x: str = "x", y: str = "y", id_col: str = "feature_id") -> DataFrame:
    """(id, fitted): at every point the value of its own tricube-weighted quadratic fit.

    A fit takes the ceil(span·n) nearest points in x; the bandwidth is the gap to
    the farthest of them.  Where fewer than three distinct x carry weight, the
    fit is the weighted mean.  Ids must be unique.  Rows with a NULL, NaN or
    infinite x or y take no part and are not returned; an empty table gives an
    empty result.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(ok("x") & ok("y"))
    placed = checkpointed(positions(rows.withColumn("_o", F.struct("x", "id")), (), "_o").drop("_o"))
    n = placed.count()
    k = min(n, max(1, int(np.ceil(n * span))))
    levels = max(1, k.bit_length())
    parts = _pieces(_windows(placed, n, k), levels).join(_blocks(placed, levels), ["level", "block"])
    wanted = parts.select("pos", "x", "h", "side", "c", *[f"m{i}" for i in range(N_PLAIN)], *[f"q{i}" for i in range(N_WITH_Y)])
    sums = wanted.mapInPandas(_weighted, "pos long, " + ", ".join(f"{s} double" for s in SUMS)).groupBy("pos").agg(*[F.sum(s).alias(s) for s in SUMS])
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(s) for s in SUMS)
    whole = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    level = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    value = F.when(whole > SOLID * s0 * s0 * s0, level / whole).otherwise(t0 / s0)
    return sums.select("pos", value.alias("fitted")).join(placed.select("pos", F.col("id").alias(id_col)), "pos").select(id_col, "fitted")
