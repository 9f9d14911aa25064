"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Iterable[str]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NULL for NaN and infinities: undefined is always NULL inside the library."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL where the denominator is zero or NULL."""
    num, den = col(num), col(den)
    return F.when(den != 0, num / den)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson over pairs that are both finite.

    Fewer than two pairs or a constant side give NULL.  Built from central
    moments, which merge stably across partitions.
    """
    x, y = finite(x), finite(y)
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    scale = F.stddev_pop(xs) * F.stddev_pop(ys)
    r = F.covar_pop(xs, ys) / scale
    return F.when((F.count(xs) >= 2) & (scale > 0), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def pearson_from_sums(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson from raw sums over ``n`` cells of which absent ones are zero.

    A variance below 1e-12 of its second moment is rounding noise and counts
    as constant, giving NULL.
    """
    n, sx, sy, sxx, syy, sxy = (col(c).cast("double") for c in (n, sx, sy, sxx, syy, sxy))
    vx, vy, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    ok = (n >= 2) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
    return F.when(ok, F.greatest(F.least(cov / F.sqrt(vx * vy), F.lit(1.0)), F.lit(-1.0)))


def plogp(p: Column, base2: bool = True) -> Column:
    """p·log p with 0·log 0 = 0."""
    return F.when(p > 0, p * (F.log2(p) if base2 else F.log(p))).otherwise(0.0)


def attach(df: DataFrame, stats: DataFrame, by: Keys, how: str = "inner") -> DataFrame:
    """Bring per-group figures to the rows of ``df``.

    With no keys ``stats`` is the single row of a global aggregate, so the
    broadcast has a fixed size; with keys Spark picks the join.
    """
    by = list(by)
    if by:
        return df.join(stats, by, how)
    return df.crossJoin(F.broadcast(stats))


NO_KEY = "_k"


def attach_keyed(df: DataFrame, stats: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """``attach`` where an absent key was replaced by the constant ``NO_KEY``.

    ``stats`` then has one row or none, which is sent along instead of joining
    on the constant.
    """
    keys = list(keys)
    if keys != [NO_KEY]:
        return df.join(stats, keys, how)
    return df.join(F.broadcast(stats.drop(NO_KEY)), F.lit(True), how)


def squared_distance(a: Iterable[Column], b: Iterable[Column]) -> Column:
    total = None
    for x, y in zip(a, b, strict=True):
        term = (x - y) * (x - y)
        total = term if total is None else total + term
    return total
