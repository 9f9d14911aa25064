"""Exact ordered statistics that never put a large group into one task.

A plain ``sum() over (partition by key order by v)`` sends every row of a key
to one task, which is fatal when a third of a huge table shares one key.  Here
rows are dealt by ranges of (key, value), so a large key spans many ranges and
small keys share one.  Ranges are summed apart, and one row per key and range
carries the offsets.  The same plan runs at every size; the ranged rows are
written once, so that a range and its number belong together whatever is
computed again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed


def compress(df: DataFrame, by: Sequence[str], value: str, weights: Mapping[str, object] | None = None) -> DataFrame:
    """One row per (by, value) with summed weights (default: a row count ``n``)."""
    weights = weights or {"n": F.count(F.lit(1))}
    aggs = [(F.sum(w) if isinstance(w, str) else w).alias(name) for name, w in weights.items()]
    # -0.0 and 0.0 are one value; group keys are normalised by Spark itself.
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)


def running_totals(
    df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], split_rows: int | None = None
) -> DataFrame:
    """Add ``cum_<s>``, ``total_<s>`` for each ``s`` and ``next_<order>``.

    ``df`` must hold one row per (by, order).  ``cum`` includes the row itself;
    ``next`` is the following value of the key, NULL at its end.  ``split_rows``
    sets the rows of a range; by default Spark's shuffle partitions do.
    """
    by = list(by)
    ends = [F.col(c) for c in (*by, order)]
    dealt = df.repartitionByRange(*ends) if split_rows is None else df.repartitionByRange(max(1, math.ceil(df.count() / split_rows)), *ends)
    ranged = checkpointed(dealt.withColumn("_p", F.spark_partition_id()))
    inner = Window.partitionBy(*by, "_p")
    run = inner.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "*", *[F.sum(s).over(run).alias(f"_run_{s}") for s in sums], F.lead(order).over(inner.orderBy(order)).alias("_next")
    )
    # one row per key and range from here on
    parts = ranged.groupBy(*by, "_p").agg(F.min(order).alias("_first"), *[F.sum(s).alias(f"_s_{s}") for s in sums])
    across = Window.partitionBy(*by).orderBy("_p")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_p").alias("_part"), F.lead("_first").over(across).alias("_following"),
        *[F.sum(f"_s_{s}").over(before).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(Window.partitionBy(*by)).alias(f"_all_{s}") for s in sums],
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_p") == F.col("_part"))
    return local.join(parts, same).select(
        *df.columns,
        *[(F.col(f"_run_{s}") + F.coalesce(F.col(f"_off_{s}"), F.lit(0))).alias(f"cum_{s}") for s in sums],
        *[F.col(f"_all_{s}").alias(f"total_{s}") for s in sums],
        F.coalesce("_next", "_following").alias(f"next_{order}"),
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
    weight: str | None = None, split_rows: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles (the numpy default), exact at any group size.

    ``weight`` is an optional integer multiplicity of the row.  Groups without
    a non-NULL value do not appear.
    """
    c = compress(df, by, value, {"_w": F.sum(weight) if weight else F.count(F.lit(1))})
    t = running_totals(c, by, value, ["_w"], split_rows)
    first, last, total = F.col("cum__w") - F.col("_w"), F.col("cum__w"), F.col("total__w")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (total - 1)
        lo = F.floor(pos)
        hi = F.least(lo + 1, total - 1)
        v_lo = F.max(F.when((first <= lo) & (lo < last), F.col(value)))
        v_hi = F.max(F.when((first <= hi) & (hi < last), F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(name))
    return t.groupBy(*by).agg(*aggs) if by else t.agg(*aggs)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, split_rows: int | None = None) -> DataFrame:
    """Per distinct value: multiplicity ``n``, average rank ``avg_rank``, group size ``total_n``."""
    t = running_totals(compress(df, by, value), by, value, ["n"], split_rows)
    return t.select(
        *by, value, "n", "total_n",
        (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"),
    )


def positions(df: DataFrame, by: Sequence[str], order: str, name: str = "pos", split_rows: int | None = None) -> DataFrame:
    """0-based position by a unique ``order`` column, without a one-task sort."""
    t = running_totals(df.withColumn("_one", F.lit(1)), by, order, ["_one"], split_rows)
    return t.select(*df.columns, (F.col("cum__one") - 1).cast("long").alias(name))
