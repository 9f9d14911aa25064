"""Exact k-nearest neighbours for coordinates (2-D / 3-D) and for vectors.

Coordinates go through ranges of a Morton curve (``tallyscope.operators.morton``).

Vectors: k nearest go through rings around pivots (``tallyscope.operators.metric``).
Sums and counts over all distances have to look at all pairs, but nothing
forces a job to *emit* them.  ``blocked`` cuts both sides into bounded blocks,
and a task reduces a block pair to sums or counts per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.exprs import attach, attach_keyed
from tallyscope.functions.ordered import exact_quantiles
from tallyscope.functions.session import checkpointed
from tallyscope.operators.metric import knn_vectors  # noqa: F401
from tallyscope.operators.morton import nearest
from tallyscope.operators.pairpass import BLOCK_ROWS as PAIR_ROWS
from tallyscope.operators.pairpass import SAMPLE_ROWS, again, dealt, distance_rows, pair_statistics

BLOCK_ROWS = 4096


def knn(
    points: DataFrame, k: int, dims: Sequence[str] = ("x", "y"), by: Sequence[str] = (), id_col: str = "obs_id",
    including_self: bool = False, strict: bool = True,
) -> DataFrame:
    """Exact k-NN graph without self edges; ``including_self`` counts self as one of k.

    A group with too few rows for k neighbours is an error, unless ``strict`` is
    off; its lists are short then.
    """
    return nearest(points, points, k - 1 if including_self else k, dims, by, id_col, same=True, strict=strict)


def knn_transfer(
    query: DataFrame, ref: DataFrame, k: int = 1, dims: Sequence[str] = ("x", "y"), by: Sequence[str] = (), id_col: str = "obs_id", strict: bool = True,
) -> DataFrame:
    """The k nearest ``ref`` rows of every query row; a group with fewer is an error unless ``strict`` is off."""
    return nearest(query, ref, k, dims, by, id_col, strict=strict)


# --- vectors -----------------------------------------------------------------

def _in_blocks(df: DataFrame, keys: Sequence[str], id_col: str, vec: str, extra: Sequence[str], block_rows: int, side: str):
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(f"_n{side}"))
    # fresh aliases: both sides may stem from one frame
    rows = attach_keyed(df.select(
        *[F.col(k).alias(k) for k in keys], F.col(id_col).alias("id"), F.transform(vec, lambda v: v.cast("double")).alias("vec"), *[F.col(c).alias(c) for c in extra]
    ), sizes, keys)
    block = F.pmod(F.xxhash64("id"), F.col(f"_n{side}")).cast("int")
    return rows.withColumn(f"_b{side}", block).drop(f"_n{side}"), sizes


def blocked(
    left: DataFrame, right: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    by: Sequence[str] = (), id_col: str = "obs_id", vec: str = "vec", left_extra: Sequence[str] = (),
    right_extra: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Reduce every pair of row blocks with ``fn`` and union the partial results.

    A task holds two blocks of about ``block_rows`` vectors whatever the size
    of the group.  ``fn`` must return partials per row, never pairs.
    """
    keys, added = list(by), not by
    if added:
        left, right, keys = left.withColumn("_k", F.lit(0)), right.withColumn("_k", F.lit(0)), ["_k"]
    lrows, lsize = _in_blocks(left, keys, id_col, vec, left_extra, block_rows, "l")
    rrows, rsize = _in_blocks(right, keys, id_col, vec, right_extra, block_rows, "r")
    lrows = attach_keyed(lrows, rsize, keys).withColumn("_br", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nr")
    rrows = attach_keyed(rrows, lsize, keys).withColumn("_bl", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))).drop("_nl")
    pair = [*keys, "_bl", "_br"]
    key_fields = T.StructType([f for f in lrows.schema.fields if f.name in by])
    n_keys = len(key_fields)

    def reduce_pair(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({f: [] for f in names}, dtype=object)
        out = fn(a, b)
        for i in range(n_keys):
            out.insert(i, key_fields[i].name, key[i])
        return out[names]

    full = T.StructType([*key_fields.fields, *T._parse_datatype_string(schema).fields])
    names = full.names
    return dealt(lrows, pair).groupBy(*pair).cogroup(dealt(rrows, pair).groupBy(*pair)).applyInPandas(reduce_pair, full)


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def within_radius(
    query: DataFrame, ref: DataFrame, radius: float, by: Sequence[str] = (), id_col: str = "obs_id", vec: str = "vec",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(by…, src, dst, d2) of all pairs closer than ``radius``: the support of a coupling."""

    def close(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, others, out = a["id"].to_numpy(), b["id"].to_numpy(), []
        x, y = (np.stack(f["vec"].to_numpy()).astype(float) for f in (a, b))
        for part, d2 in distance_rows(x, y):
            again(d2, x[part], y, d2 <= radius * radius * (1 + 1e-9))
            i, j = np.nonzero(np.sqrt(d2) < radius)
            out.append(pd.DataFrame({"src": ids[part][i], "dst": others[j], "d2": d2[i, j]}))
        return pd.concat(out)

    schema = f"src {_id_type(query, id_col)}, dst {_id_type(ref, id_col)}, d2 double"
    return blocked(query, ref, close, schema, by, id_col, vec, block_rows=block_rows).select(*by, "src", "dst", "d2")


def _vector_rows(df: DataFrame, by: Sequence[str], id_col: str, vec: str, *more) -> tuple[DataFrame, list[str]]:
    """(keys…, id, v, …) as ``pairpass`` takes them; without ``by`` all rows are one group."""
    keys = list(by) or ["_k"]
    df = df if by else df.withColumn("_k", F.lit(0))
    return df.select(*keys, F.col(id_col).alias("id"), F.transform(vec, lambda v: v.cast("double")).alias("v"), *more), keys


def silhouette_rows(df: DataFrame, label: str, by: Sequence[str] = (), id_col: str = "obs_id", vec: str = "vec", block_rows: int = PAIR_ROWS) -> DataFrame:
    """Exact Euclidean silhouette per row; a singleton cluster scores 0.  Rows without a label take no part."""
    rows, keys = _vector_rows(df, by, id_col, vec, F.col(label).cast("string").alias("_label"))
    scored = pair_statistics(rows.where("_label is not null"), keys, ["_label"], block_rows=block_rows)["_label"]
    return scored.select(*by, F.col("id").alias(id_col), F.col("_named").cast(df.schema[label].dataType).alias(label), "silhouette")


def silhouette(df: DataFrame, label: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Mean silhouette per group; NULL with fewer than two labels."""
    return silhouette_rows(df, label, by, **kw).groupBy(*by).agg(F.avg("silhouette").alias("silhouette"))


def pair_distance(a: str, b: str):
    """Euclidean distance of two array columns."""
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v))


def paired_retrieval(ref: DataFrame, query: DataFrame, by: Sequence[str] = (), id_col: str = "obs_id", vec: str = "vec", block_rows: int = PAIR_ROWS) -> DataFrame:
    """Per query: is the same-id reference the nearest, and at which rank.

    The tolerance is 1e-12 + 1e-9·max(1, nearest distance).  Queries without a
    partner are left out.
    """
    keys = [*by, id_col]
    asks = query.join(ref.select(*keys, F.col(vec).alias("_p")), keys).withColumn("_paired", pair_distance("_p", vec))
    side = lambda df, name, paired: df.select(
        *by, F.concat(F.lit(name), F.col(id_col).cast("string")).alias("_id"), vec, F.lit(name == "q").alias("_asks"), F.lit(name == "r").alias("_answers"), paired.alias("_paired")
    )
    both = side(asks, "q", F.col("_paired")).unionByName(side(ref, "r", F.lit(None).cast("double")))
    rows, group = _vector_rows(both, by, "_id", vec, "_asks", "_answers", "_paired")
    found = pair_statistics(rows, group, retrieval=True, block_rows=block_rows)["retrieval"]
    return found.select(*by, F.substring("id", 2, 1 << 30).cast(query.schema[id_col].dataType).alias(id_col), "paired_distance", "top1", "rank")


def retrieval_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.col("top1").cast("double")).alias("top1_rate")
    )
    return attach(s, exact_quantiles(rows, by, "rank", {"median_rank": 0.5}), by)


def mmd2_rbf(
    df: DataFrame, batch: str, first, second, by: Sequence[str] = (), id_col: str = "obs_id", vec: str = "vec", block_rows: int = PAIR_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Biased RBF-MMD² over all rows, with the median positive distance as bandwidth.

    The median is exact: one pass counts distances by the slots of a sampled
    bracket, the next looks at the values of the slots that hold it and sums
    the kernel.  NULL if a batch is empty.
    """
    used = df.where(F.col(batch).isin(first, second))
    rows, keys = _vector_rows(used, by, id_col, vec, (F.col(batch) == F.lit(first)).alias("_first"))
    return pair_statistics(rows, keys, mmd=True, block_rows=block_rows, sample_rows=sample_rows)["mmd"].select(*by, "mmd2", "bandwidth")


# rows of a range of drawn partners
DRAWN_ROWS = 2048
LEFT_STEP, DRAW_STEP = 7919, 104_729


class Draws:
    """The rule that pairs row i of n with row i + 1 + (i · 7919 + t · 104729 + seed) mod (n − 1), modulo n, for t below ``draws``.

    Counted in steps of 104729 modulo n − 1 the partners of a row follow each other, but for those
    beyond the end of the table, which begin a second run.  Ranges of positions in that
    order so hold nearly all partners of a row in two of them.
    """

    def __init__(self, n: int, draws: int, seed: int = 0, block_rows: int = DRAWN_ROWS) -> None:
        self.n, self.seed, self.block_rows = n, seed, block_rows
        self.cycles = math.gcd(DRAW_STEP, n - 1)
        self.length = (n - 1) // self.cycles
        self.inverse = pow(DRAW_STEP // self.cycles, -1, self.length)
        # later draws repeat the first ones
        self.draws = min(draws, self.length)

    def partner(self, pos, t, mod: Callable):
        return mod(pos + 1 + mod(pos * LEFT_STEP + t * DRAW_STEP + self.seed, self.n - 1), self.n)

    def range_of(self, pos) -> Column:
        p = F.pmod(pos, F.lit(self.n - 1))
        cycle = F.pmod(p, F.lit(self.cycles))
        place = F.pmod(((p - cycle) / self.cycles).cast("long") * self.inverse, F.lit(self.length))
        return F.floor((cycle * self.length + place) / self.block_rows)

    def ranges(self, pos) -> Column:
        """The ranges that hold partners of a row."""
        t = F.sequence(F.lit(0).cast("long"), F.lit(self.draws - 1).cast("long"))
        return F.array_distinct(F.transform(t, lambda i: self.range_of(self.partner(pos, i, lambda a, b: F.pmod(a, F.lit(b))))))

    def drawn_by(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Does row i draw row j?"""
        gap = np.mod(np.mod(j - i - 1, self.n) - i * LEFT_STEP - self.seed, self.n - 1)
        return (gap % self.cycles == 0) & (gap // self.cycles * self.inverse % self.length < self.draws)

    def pairs(self, i: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in i, index in ``held``) of the drawn pairs whose partner is held; a pair that both ends draw belongs to its smaller position."""
        order = np.argsort(held)
        rows, cols = [np.zeros(0, int)], [np.zeros(0, int)]
        for t in range(self.draws if len(held) else 0):
            q = self.partner(i, t, np.mod)
            at = order[np.minimum(np.searchsorted(held, q, sorter=order), len(held) - 1)]
            row = np.flatnonzero((held[at] == q) & ((i < q) | ~self.drawn_by(q, i)))
            rows.append(row)
            cols.append(at[row])
        return np.concatenate(rows), np.concatenate(cols)


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions × rows, lengths); a missing vector has length -1."""
    size = np.array([-1 if v is None else len(v) for v in vectors], int)
    out = np.zeros((max(size.max(initial=0), 0), len(size)))
    for i, v in enumerate(vectors):
        if size[i] > 0:
            out[: size[i], i] = np.asarray(v, float)
    return out, size


def _chosen_distances(a: pd.Series, b: pd.Series, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of chosen pairs, summed dimension by dimension; NaN between vectors of different length."""
    (x, m), (y, n) = _matrix(a), _matrix(b)
    d2 = np.where((m[row] == n[col]) & (m[row] >= 0), 0.0, np.nan)
    for u, v in zip(x, y, strict=False):
        gap = u[row] - v[col]
        d2 += gap * gap
    return np.sqrt(d2)


def drawn_distances(placed: DataFrame, rule: Draws, left: str, right: str) -> DataFrame:
    """(_dl, _dr) of every drawn pair of ``placed(pos, left, right)``, once: a row is sent to the ranges of its partners, not to each of them."""
    asks = placed.select(F.explode(rule.ranges(F.col("pos"))).alias("_r"), "pos", left, right)
    held = placed.select(*[F.col(c).alias(c) for c in ("pos", left, right)]).withColumn("_r", rule.range_of(F.col("pos"))).select("_r", "pos", left, right)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        row, col = rule.pairs(a["pos"].to_numpy(), b["pos"].to_numpy())
        return pd.DataFrame({"_dl": _chosen_distances(a[left], b[left], row, col), "_dr": _chosen_distances(a[right], b[right], row, col)})

    return dealt(asks, ["_r"]).groupBy("_r").cogroup(dealt(held, ["_r"]).groupBy("_r")).applyInPandas(meet, "_dl double, _dr double")


def distance_spearman(
    df: DataFrame, left: str, right: str, draws: int, id_col: str = "obs_id", seed: int = 0
) -> DataFrame:
    """Spearman of pairwise distances in two embeddings of the same rows, over drawn pairs.

    Row i of n (by id, from 0) is paired with the rows i + 1 + (i · 7919 + t ·
    104729 + seed) mod (n − 1), modulo n, for t below ``draws``; a pair drawn
    twice counts once.  The number of pairs so grows with the rows, never with
    their square; a row travels about three times, whatever the draws, and the distances are written once.
    """
    from tallyscope.functions.ordered import positions
    from tallyscope.operators.correlation import spearman

    placed = checkpointed(positions(df.select(F.col(id_col).alias("_id"), F.col(left).alias("_l"), F.col(right).alias("_r_")), (), "_id", "pos"))
    n = placed.count()
    d = checkpointed(drawn_distances(placed, Draws(n, draws, seed), "_l", "_r_")) if n > 1 else placed.sparkSession.createDataFrame([], "_dl double, _dr double")
    return spearman(d, "_dl", "_dr", (), "distance_spearman")
