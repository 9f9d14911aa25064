"""How often each of n donors is drawn, without a row per draw.

A uniform multinomial is split by binomials over a tree of donor positions: the
draws of a range fall to its left half with the half's share.  Ranges without
draws are left alone, and ranges of ``SEGMENT`` positions are dealt out to tasks
and filled there.  Every split is keyed by (group, seed, range), so a partition
that is computed again gives the same numbers, and so does any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 4096
ROWS_OUT = 1 << 16


def _dice(key: int, node: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([key, node], dtype=np.int64).view(np.uint64)))


def _halves(key: int, n: int, draws: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, draws) of the segments that get draws."""
    open_ = [(0, -(-n // SEGMENT), 1, draws)]  # ranges of whole segments, with their number in the tree
    while open_:
        a, b, node, c = open_.pop()
        if c == 0:
            continue
        lo, hi = a * SEGMENT, min(b * SEGMENT, n)
        if b - a == 1:
            yield lo, hi, c
            continue
        mid = (a + b) // 2
        left = int(_dice(key, node).binomial(c, (mid * SEGMENT - lo) / (hi - lo)))
        open_ += [(mid, b, 2 * node + 1, c - left), (a, mid, 2 * node, left)]


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for key, n, draws in zip(b["_key"], b["_n"], b["_draws"], strict=True):
            rows: list[tuple[int, int, int, int]] = []
            for part in _halves(key, n, draws):
                rows.append((key, *part))
                if len(rows) == ROWS_OUT:
                    yield pd.DataFrame(rows, columns=["_key", "_lo", "_hi", "_c"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["_key", "_lo", "_hi", "_c"])


def _filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts, held = [], 0
        for key, lo, hi, c in zip(b["_key"], b["_lo"], b["_hi"], b["_c"], strict=True):
            # numbers below zero are segments, so no number of the tree is used twice
            m = _dice(key, -1 - lo).multinomial(c, np.full(hi - lo, 1.0 / (hi - lo)))
            at = np.flatnonzero(m)
            parts.append((np.full(len(at), key), lo + at, m[at]))
            held += len(at)
            if held >= ROWS_OUT:
                yield pd.DataFrame(dict(zip(("_key", "idx", "times"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
                parts, held = [], 0
        if parts:
            yield pd.DataFrame(dict(zip(("_key", "idx", "times"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def multiplicities(groups: DataFrame, keys: Sequence[str], donors: str = "n_donors", draws: str = "n_draws", seed: int = 0) -> DataFrame:
    """(keys…, idx, times): how often position ``idx`` in 0 … donors - 1 comes up in ``draws`` uniform draws.

    ``groups`` has one row per ``keys``.  The times of a group add up to its
    draws; positions that are never drawn have no row.  Groups without draws or
    donors (zero, negative or NULL) have none either.  The work is that of the
    positions drawn, not of the draws, which may be up to 2^62.  Repeatable for
    one seed and one release of numpy.
    """
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    absent = [F.col(k).isNull() for k in keys]
    asked = groups.where((F.col(donors) > 0) & (F.col(draws) > 0)).select(
        *keys, F.xxhash64(F.lit(seed), *named, *absent).alias("_key"), F.col(donors).cast("long").alias("_n"), F.col(draws).cast("long").alias("_draws")
    )
    # groups that share a hash also share their draws only if their sizes agree, so sizes are part of it
    asked = asked.withColumn("_key", F.xxhash64("_key", "_n", "_draws"))
    segments = asked.select("_key", "_n", "_draws").distinct().mapInPandas(_segments, "_key long, _lo long, _hi long, _c long")
    times = segments.repartition("_key", "_lo").mapInPandas(_filled, "_key long, idx long, times long")
    return asked.select(*keys, "_key").join(times, "_key").select(*keys, "idx", "times")
