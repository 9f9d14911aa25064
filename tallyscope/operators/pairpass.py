"""One pass over all pairs of vectors of a group that feeds several reducers.

Rows are cut into blocks of bounded size by the hash of their id; each pair of
blocks meets once, in one task, and a distance serves both of its ends.  Each
reducer turns the distances into sums, counts or minima of rows or groups, so
pairs never leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.exprs import attach_keyed
from tallyscope.functions.session import checkpointed

# many rows are cut into few large blocks, since each pair of blocks has a row per row and label; some rows into MANY blocks, so that all cores have work
BLOCK_ROWS = 12288
LEAST_ROWS, MANY = 1024, 10
# block pairs are dealt to more tasks than cores, which evens out what hashing deals unevenly
TASKS = 64
SAMPLE_ROWS = 1024
BINS = 4096
TERMS = 4
# distances at a time: 2 MB, which stay in a core's cache
CELLS = 1 << 18
FEW_DIMS = 8
# an inner product of 64 dimensions errs by less than 1e-14 of both squares
CANCEL = 0.05


def differences(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the rows ``i`` of x to the rows ``j`` of y, dimension by dimension."""
    d2 = np.zeros(len(i))
    for c in range(x.shape[1]):
        gap = x[i, c] - y[j, c]
        d2 += gap * gap
    return d2


def again(d2: np.ndarray, x: np.ndarray, y: np.ndarray, which: np.ndarray) -> None:
    """Puts the distances of ``which`` from differences in place, so that equal rows tie whatever their block."""
    i, j = np.nonzero(which)
    d2[i, j] = differences(x, y, i, j)


def distance_rows(x: np.ndarray, y: np.ndarray, cells: int = CELLS) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of some rows of x to all rows of y, some ``cells`` at a time.

    Of many dimensions, they come from inner products; where these cancel, again
    from differences, so that equal rows have distance 0.  The relative error is some
    1e-14.  The same rows in the same order give the same distances.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    direct = x.shape[1] <= FEW_DIMS or not np.isfinite(xx.sum() + yy.sum())
    rows = max(8, cells // max(1, len(y)))
    if not direct:
        # both squares are part of the product
        left, right = np.column_stack([x * -2.0, xx, np.ones(len(x))]), np.vstack([y.T, np.ones(len(y)), yy])
        most = yy.max(initial=0.0)
    for start in range(0, len(x), rows):
        part, near = x[start : start + rows], None
        if not direct:
            d2 = left[start : start + rows] @ right
            some = np.flatnonzero(d2.min(1, initial=np.inf) <= CANCEL * (xx[start : start + rows] + most))
            i, j = np.nonzero(d2[some] <= CANCEL * (xx[start + some, None] + most))
            near = some[i] * len(y) + j
            near = near[d2.flat[near] <= CANCEL * (xx[start + some[i]] + yy[j])]
        if near is None or len(near) > d2.size // 8:
            d2 = np.zeros((len(part), len(y)))
            for j in range(x.shape[1]):
                gap = part[:, j, None] - y[None, :, j]
                d2 += gap * gap
        elif len(near):
            d2.flat[near] = differences(part, y, *np.divmod(near, len(y)))
        yield slice(start, start + len(part)), d2


def _span(mask: np.ndarray) -> slice | np.ndarray:
    """The places of a mask as a slice where they follow each other, which takes no copy."""
    at = np.flatnonzero(mask)
    return slice(at[0], at[-1] + 1) if len(at) and at[-1] - at[0] + 1 == len(at) else mask


def _square(limit: np.ndarray | float) -> np.ndarray:
    """The least double whose root is not below ``limit``: a distance is below it exactly where its square is below this."""
    limit = np.asarray(limit, float)
    out = np.where(limit > 0, limit * limit, np.where(np.isnan(limit), np.nan, 0.0))
    with np.errstate(over="ignore"):
        for _ in range(4):
            out = np.where(np.sqrt(out) < limit, np.nextafter(out, np.inf), out)
        for _ in range(4):
            less = np.nextafter(out, -np.inf)
            out = np.where((limit > 0) & (less >= 0) & (np.sqrt(np.maximum(less, 0.0)) >= limit), less, out)
    return out


class Reducer:
    """Takes the distances of a block pair; ``twice`` says that the blocks differ, so that both sides count.

    Returns columns of (_id, _tag, _own, _slot, _x, _n) or of (_id, _own, _tags, _xs, _ns), which hold a row's
    figures of all labels; those left out are NULL.
    """

    columns: Sequence[str] = ()
    rooted = False

    def start(self, a: pd.DataFrame, b: pd.DataFrame, twice: bool) -> None:
        raise NotImplementedError

    def see(self, part: slice, d2: np.ndarray, d: np.ndarray | None = None) -> None:
        """Squared distances and, where ``rooted``, their roots, which reducers share."""
        raise NotImplementedError

    def rows(self) -> Iterator[dict]:
        raise NotImplementedError


class LabelSums(Reducer):
    """Sum of distances and number of rows, from every row to every label (itself included); NULL labels take no part."""

    def __init__(self, label: str) -> None:
        self.label, self.columns = label, (label,)

    rooted = True

    def start(self, a, b, twice):
        self.a, self.b, self.twice = a, b, twice
        self.ca, self.na = pd.factorize(a[self.label])
        self.cb, self.nb = pd.factorize(b[self.label])
        self.ha, self.hb = (np.eye(len(n) + 1)[c][:, : len(n)] for c, n in ((self.ca, self.na), (self.cb, self.nb)))
        self.sa, self.sb = np.zeros((len(a), len(self.nb))), np.zeros((len(b), len(self.na)))

    def see(self, part, d2, d=None):
        d = np.sqrt(d2) if d is None else d
        self.sa[part] = d @ self.hb
        if self.twice:
            self.sb += d.T @ self.ha[part]

    def rows(self):
        sides = [(self.a, self.ca, self.na, self.sa, self.nb, self.hb)] + ([(self.b, self.cb, self.nb, self.sb, self.na, self.ha)] if self.twice else [])
        for frame, own, mine, sums, names, hot in sides:
            some = np.flatnonzero(own >= 0)
            m, n = len(some), len(names)
            if m and n:
                text, tags, counts = np.array([str(x) for x in mine], object), [str(x) for x in names], hot.sum(0).astype(np.int64)
                yield {"_id": frame["id"].to_numpy()[some], "_own": text[own[some]], "_tags": [tags] * m, "_xs": list(sums[some]), "_ns": [counts] * m}


class Nearest(Reducer):
    """The smallest distance of every asking row to an answering row."""

    columns = ("_asks", "_answers")

    def start(self, a, b, twice):
        self.sides = [(a, a["_asks"].to_numpy(bool), b["_answers"].to_numpy(bool), np.full(len(a), np.inf))]
        if twice:
            self.sides.append((b, b["_asks"].to_numpy(bool), a["_answers"].to_numpy(bool), np.full(len(b), np.inf)))

    def met(self, part):
        """What asks and what answers in the piece, for either side; NULL where nothing does."""
        (_, asks, answers, _), *other = self.sides
        yield (_span(asks[part]), _span(answers)) if asks[part].any() and answers.any() else None
        for _, asks, answers, _ in other:
            yield (_span(answers[part]), _span(asks)) if asks.any() and answers[part].any() else None

    def see(self, part, d2, d=None):
        for axis, (found, (*_, low)) in enumerate(zip(self.met(part), self.sides, strict=True)):
            if found:
                least = _picked(d2, *found).min(1 - axis)
                own, at = (low[part], found[0]) if axis == 0 else (low, found[1])
                own[at] = np.minimum(own[at], least)

    def rows(self):
        for frame, asks, _, low in self.sides:
            some = asks & np.isfinite(low)
            yield {"_id": frame["id"].to_numpy()[some], "_x": np.sqrt(low[some])}


class Closer(Nearest):
    """How many answering rows are nearer to an asking row than its ``_cut``."""

    columns = ("_asks", "_answers", "_cut")

    def start(self, a, b, twice):
        super().start(a, b, twice)
        self.cuts = [_square(f["_cut"].to_numpy(float)) for f in (a, b)]
        self.counts = [np.zeros(len(f), np.int64) for f in (a, b)]

    def see(self, part, d2, d=None):
        for axis, found in enumerate(self.met(part)):
            if found:
                cut, count, at = (self.cuts[0][part], self.counts[0][part], found[0]) if axis == 0 else (self.cuts[1], self.counts[1], found[1])
                count[at] += np.count_nonzero(_picked(d2, *found) < (cut[at][:, None] if axis == 0 else cut[at][None, :]), axis=1 - axis)

    def rows(self):
        for (frame, asks, _, _), n in zip(self.sides, self.counts, strict=False):
            yield {"_id": frame["id"].to_numpy()[asks], "_n": n[asks]}


def _slots(d: np.ndarray, low: float, high: float) -> np.ndarray:
    """-1 below the bracket, BINS above it; never falling where d rises."""
    if not high > low:
        return np.where(d < low, -1, np.where(d > high, BINS, 0))
    return np.where(d < low, -1, np.where(d > high, BINS, np.clip(np.floor((d - low) / (high - low) * BINS), 0, BINS - 1))).astype(np.int64)


def _picked(d2: np.ndarray, rows: slice | np.ndarray, columns: slice | np.ndarray) -> np.ndarray:
    return d2[rows][:, columns]


class Histogram(Reducer):
    """Positive distances of ordered pairs of rows in use, counted by slots of the group's bracket."""

    columns = ("_first", "_low", "_high")

    def start(self, a, b, twice):
        self.low, self.high, self.times = float(a["_low"].iloc[0]), float(a["_high"].iloc[0]), 2 if twice else 1
        # squares of the bracket; a distance of 0 is in no slot
        self.from_, self.upto = max(_square(self.low), np.nextafter(0.0, 1.0)), _square(np.nextafter(self.high, np.inf))
        self.ua, self.ub = (f["_first"].notna().to_numpy() for f in (a, b))
        self.counts = np.zeros(BINS + 2, np.int64)

    def see(self, part, d2, d=None):
        d2 = _picked(d2, _span(self.ua[part]), _span(self.ub))
        under, over = d2 < self.from_, d2 >= self.upto
        inside = np.sqrt(d2[~(under | over)])
        if self.high > self.low:
            # as ``_slots`` has them
            slots = np.minimum(((inside - self.low) / (self.high - self.low) * BINS).astype(np.int64), BINS - 1)
        else:
            slots = _slots(inside, self.low, self.high)
        self.counts += self.times * np.bincount(slots + 1, minlength=BINS + 2)
        below = np.count_nonzero(under)
        if below:
            self.counts[0] += self.times * np.count_nonzero(d2[under] > 0)
        self.counts[-1] += self.times * (d2.size - below - len(inside))

    def rows(self):
        some = np.flatnonzero(self.counts)
        yield {"_slot": some - 1, "_n": self.counts[some]}


class KernelSums(Reducer):
    """The distances inside the slots that hold the median, and Gaussian kernel sums near the width ``_width``.

    The width itself is known only after the pass, so the sums are those of
    (-d2)^j / j! times the kernel at ``_width``: a short power series in the
    small difference of 1 / (2 width^2).
    """

    columns = ("_first", "_low", "_high", "_slots", "_width")

    def start(self, a, b, twice):
        self.low, self.high, self.twice = float(a["_low"].iloc[0]), float(a["_high"].iloc[0]), twice
        self.slots = np.asarray(a["_slots"].iloc[0] if a["_slots"].iloc[0] is not None else [], np.int64)
        # a little more than the slots, which are looked at one by one
        step = max(self.high - self.low, 0.0) / BINS
        self.from_, self.upto = (self.low + (self.slots.min() - 1) * step, self.low + (self.slots.max() + 2) * step) if len(self.slots) else (np.inf, -np.inf)
        self.from_, self.upto = max(_square(self.from_), np.nextafter(0.0, 1.0)), _square(np.nextafter(self.upto, np.inf))
        self.scale = 1.0 / (2.0 * float(a["_width"].iloc[0]) ** 2)
        self.ua, self.ub = (f["_first"].notna().to_numpy() for f in (a, b))
        self.fa, self.fb = ((f["_first"] == True).to_numpy(bool) for f in (a, b))  # noqa: E712
        self.values: dict[float, int] = {}
        self.sums = np.zeros((3, TERMS))

    def see(self, part, d2, d=None):
        times, ua, fa = 2 if self.twice else 1, self.ua[part], self.fa[part]
        used = _picked(d2, _span(ua), _span(self.ub))
        d = np.sqrt(used[(used >= self.from_) & (used < self.upto)])
        for v, n in zip(*np.unique(d[np.isin(_slots(d, self.low, self.high), self.slots)], return_counts=True), strict=True):
            self.values[float(v)] = self.values.get(float(v), 0) + times * int(n)
        k = d2 * -self.scale
        np.exp(k, out=k)
        sides, fb, gb = np.stack([fa, ua & ~fa]).astype(float), self.fb, self.ub & ~self.fb
        for j in range(TERMS):
            if j:
                k *= d2
            rows = sides @ k * ((-1.0) ** j / math.factorial(j))
            self.sums[0, j] += times * rows[0][fb].sum()
            self.sums[1, j] += times * rows[1][gb].sum()
            self.sums[2, j] += rows[0][gb].sum() + (rows[1][fb].sum() if self.twice else 0.0)

    def rows(self):
        yield {"_tag": ["value"] * len(self.values), "_x": np.array(list(self.values), float), "_n": np.array(list(self.values.values()), np.int64)}
        yield {"_tag": [f"k{i}" for i in range(3) for _ in range(TERMS)], "_slot": np.tile(np.arange(TERMS), 3), "_x": self.sums.ravel()}


def ordered(f: pd.DataFrame) -> pd.DataFrame:
    """By what answers and what is first, so that each is one span, then by id: the same order in every pass."""
    sides = [f[c].map({True: 0, False: 1}).fillna(2).to_numpy(int) for c in ("_answers", "_first") if c in f]
    f = f.sort_values("id", kind="stable") if not sides else f.assign(_side=sum(3**i * c for i, c in enumerate(sides))).sort_values(["_side", "id"], kind="stable")
    return f.drop(columns="_side", errors="ignore")


def see_all(reducers: Sequence[Reducer], part: slice, d2: np.ndarray) -> None:
    d = np.sqrt(d2) if any(r.rooted for r in reducers) else None
    for r in reducers:
        r.see(part, d2, d)


def dealt(df: DataFrame, pair: Sequence[str]) -> DataFrame:
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *pair)


def pair_pass(rows: DataFrame, reducers: Sequence[Reducer], keys: Sequence[str], block_rows: int = BLOCK_ROWS, visits=None) -> DataFrame:
    """(keys…, _r, _id, _tag, _own, _slot, _x, _n): what the reducers made of ``rows(keys…, id, v, columns…)``, ``_r`` their number.

    Labels come back as text.  Written, since several results are read from it; rows of labels are unfolded when read.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for r in reducers for c in r.columns))
    n = F.count(F.lit(1))
    few = min(block_rows, LEAST_ROWS)
    sizes = rows.groupBy(*keys).agg(F.greatest(F.ceil(n / block_rows), F.least(F.ceil(n / few), F.lit(MANY))).cast("int").alias("_m"))
    slim = attach_keyed(rows.select(*keys, "id", "v", *columns), sizes, keys).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
    left = slim.withColumn("_to", F.explode(F.sequence(F.col("_b"), F.col("_m") - 1))).withColumnRenamed("_b", "_from").drop("_m")
    # a block meets itself from the left alone; fresh names, as both sides stem from one frame
    right = slim.where("_b > 0").select(*[F.col(c).alias(c) for c in slim.columns])
    right = right.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).withColumnRenamed("_b", "_to").drop("_m").select(*left.columns)
    fields = [f for f in rows.schema.fields if f.name in keys]
    id_type = rows.schema["id"].dataType.simpleString()
    out_schema = T.StructType([*fields, *T._parse_datatype_string(f"_r int, _id {id_type}, _tag string, _own string, _slot bigint, _x double, _n bigint, _tags array<string>, _xs array<double>, _ns array<bigint>").fields])
    names = out_schema.names

    def reduce_pair(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        twice = key[-2] != key[-1]
        if not len(a) or (twice and not len(b)):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        # rows come in any order, and both passes must see the same distances
        a, b = ordered(a), ordered(b)
        if not twice:
            b = a
        if visits is not None:
            visits.add(1)
        for r in reducers:
            r.start(a, b, twice)
        for part, d2 in distance_rows(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())):
            see_all(reducers, part, d2)
        out = []
        for i, r in enumerate(reducers):
            for piece in r.rows():
                f = pd.DataFrame({n: piece[n] for n in piece}).assign(_r=i, **{c: None for c in ("_tags", "_xs", "_ns") if c not in piece})
                out.append(f.reindex(columns=names[len(fields):]).astype({"_slot": "Int64", "_n": "Int64"}))
        frame = pd.concat(out, ignore_index=True).astype({"_tag": object, "_own": object})
        for i, f in enumerate(fields):
            frame.insert(i, f.name, key[i])
        return frame[names]

    pair = [*keys, "_from", "_to"]
    out = checkpointed(dealt(left, pair).groupBy(*pair).cogroup(dealt(right, pair).groupBy(*pair)).applyInPandas(reduce_pair, out_schema))
    # a row per label only here: it would cost more than its distances on the way out of the task
    one = F.array(F.struct(F.col("_tag").alias("_tags"), F.col("_x").alias("_xs"), F.col("_n").alias("_ns")))
    out = out.withColumn("_e", F.explode(F.when(F.col("_xs").isNotNull(), F.arrays_zip("_tags", "_xs", "_ns")).otherwise(one)))
    return out.select(*keys, "_r", "_id", F.col("_e._tags").alias("_tag"), "_own", "_slot", F.col("_e._xs").alias("_x"), F.col("_e._ns").alias("_n"))


def silhouettes(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, id, _named: the label as text, silhouette) from the rows of ``LabelSums``; a singleton label scores 0."""
    s = sums.groupBy(*keys, "_id", "_own", "_tag").agg(F.sum("_x").alias("total"), F.sum("_n").alias("n"))
    own = F.col("_own") == F.col("_tag")
    g = s.groupBy(*keys, F.col("_id").alias("id"), F.col("_own").alias("_named")).agg(
        F.max(F.when(own, F.col("n"))).alias("_n"),
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("_a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("_b"),
    )
    top = F.greatest("_a", "_b")
    score = F.when((F.col("_n") == 1) | (top == 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / top)
    return g.select(*keys, "id", "_named", score.alias("silhouette"))


def tolerance(nearest: str):
    """1e-12 + 1e-9 · max(1, nearest distance)."""
    return 1e-12 + 1e-9 * F.greatest(F.lit(1.0), F.abs(nearest))


def bracketed(rows: DataFrame, keys: Sequence[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(keys…, _low, _high): a bracket of the median positive distance of rows with ``_first``, from a sample by hash.

    The bracket is a guess that saves passes; what lies outside it is counted all
    the same, so a wrong one costs a pass and no exactness.
    """
    fields = [f for f in rows.schema.fields if f.name in keys]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("id", F.lit(7)), "id"))
    few = rows.where("_first is not null").select(*keys, "id", "v").withColumn("_i", order).where(F.col("_i") <= sample_rows)

    def guess(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f["v"].to_numpy())
        d = np.concatenate([np.sqrt(d2[d2 > 0]) for _, d2 in distance_rows(x, x)])
        spread = 2.5 / math.sqrt(len(x)) if len(x) >= sample_rows else 0.0
        low = np.quantile(d, max(0.0, 0.5 - spread), method="lower") if len(d) else 1.0
        high = np.quantile(d, min(1.0, 0.5 + spread), method="higher") if len(d) else 1.0
        return pd.DataFrame([(*key[: len(fields)], float(low) * (1 - 1e-12), float(high) * (1 + 1e-12))], columns=[*[g.name for g in fields], "_low", "_high"])

    schema = T.StructType([*fields, *T._parse_datatype_string("_low double, _high double").fields])
    return few.groupBy(*keys).applyInPandas(guess, schema)


def median_slots(histogram: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, _low, _high, _at, _slots, _missed): the slots of both middle places, and whether one is outside the bracket.

    ``_at`` are the middle places counted from the first of these slots.
    """
    keys = list(keys)
    counts = histogram.groupBy(*keys, "_slot").agg(F.sum("_n").alias("n"))
    # one row per slot: BINS + 2 of them at most
    upto = counts.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("_slot"))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    places = upto.withColumn("at", F.explode(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2))))
    found = places.where((F.col("cum") > F.col("at")) & (F.col("cum") - F.col("n") <= F.col("at")))
    sums = found.groupBy(*keys).agg(
        F.collect_set("_slot").alias("_slots"), F.min(F.col("cum") - F.col("n")).alias("_before"), F.sort_array(F.collect_list("at")).alias("_places"), F.min("_slot").alias("_s"), F.max("_slot").alias("_t"),
    )
    # where the middle places are in two slots, what lies between them is empty
    missed = (F.col("_s") < 0) | (F.col("_t") >= BINS)
    out = attach_keyed(brackets, sums, keys, "left")
    return out.select(
        *keys, "_low", "_high", F.transform("_places", lambda p: p - F.col("_before")).alias("_at"), F.col("_slots"), F.coalesce(missed, F.lit(False)).alias("_missed"),
        F.coalesce(F.col("_s") < 0, F.lit(False)).alias("_under"), F.coalesce(F.col("_t") >= BINS, F.lit(False)).alias("_over"), "_s", "_t",
    )


def with_width(slots: DataFrame) -> DataFrame:
    """``_width``: the middle of what is known of the median; 1 where no distance is positive."""
    step = (F.col("_high") - F.col("_low")) / BINS
    middle = F.col("_low") + (F.col("_s") + F.col("_t") + 1) / 2 * step
    return slots.withColumn("_width", F.coalesce(F.greatest(middle, F.lit(1e-12)), F.lit(1.0)))


def mmd_from(kernel: DataFrame, slots: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, mmd2, bandwidth) from the rows of ``KernelSums`` and (keys…, n_first, n_second)."""
    keys = list(keys)
    values = kernel.where("_tag = 'value'").groupBy(*keys, "_x").agg(F.sum("_n").alias("n"))
    upto = values.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("_x")))
    placed = attach_keyed(upto, slots.select(*keys, F.explode("_at").alias("at")), keys).where((F.col("cum") > F.col("at")) & (F.col("cum") - F.col("n") <= F.col("at")))
    median = placed.groupBy(*keys).agg(F.avg("_x").alias("_median"))
    sums = kernel.where("_tag <> 'value'").groupBy(*keys, "_tag", F.col("_slot").alias("j")).agg(F.sum("_x").alias("x"))
    known = attach_keyed(attach_keyed(slots, median, keys, "left"), counts, keys)
    known = known.withColumn("bandwidth", F.greatest(F.coalesce("_median", F.lit(1.0)), F.lit(1e-12)))
    power = F.pow(1.0 / (2.0 * F.col("bandwidth") * F.col("bandwidth")) - 1.0 / (2.0 * F.col("_width") * F.col("_width")), F.col("j").cast("double"))
    part = lambda tag: F.sum(F.when(F.col("_tag") == tag, F.col("x") * F.when(F.col("j") == 0, 1.0).otherwise(power)))
    g = attach_keyed(sums, known, keys).groupBy(*keys, "bandwidth", "n_first", "n_second").agg(part("k0").alias("s11"), part("k1").alias("s22"), part("k2").alias("s12"))
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    value = F.greatest(F.col("s11") / (n1 * n1) + F.col("s22") / (n2 * n2) - 2.0 * F.col("s12") / (n1 * n2), F.lit(0.0))
    return g.select(*keys, F.when((n1 > 0) & (n2 > 0), value).alias("mmd2"), "bandwidth")


def pair_statistics(
    rows: DataFrame, keys: Sequence[str], labels: Sequence[str] = (), retrieval: bool = False, mmd: bool = False, block_rows: int = BLOCK_ROWS, visits=None, sample_rows: int = SAMPLE_ROWS,
) -> dict[str, DataFrame]:
    """All statistics asked for in at most two passes over the pairs of ``rows(keys…, id, v, …)``.

    * ``labels``: text columns; the result of that name is (keys…, id, _named, silhouette).  One pass.
    * ``retrieval``: with ``_asks``, ``_answers`` and the distance ``_paired`` of an
      asking row to its partner, the result ``retrieval`` is (keys…, id, paired_distance, top1, rank).
    * ``mmd``: with ``_first`` (NULL: not in use), the result ``mmd`` is (keys…, mmd2, bandwidth); the median
      distance is exact.  A third pass is needed only where the sampled bracket misses it.
    """
    keys = list(keys)
    one, brackets = [LabelSums(c) for c in labels], None
    first_rows = rows
    if mmd:
        brackets = checkpointed(bracketed(rows, keys, sample_rows))
        first_rows = attach_keyed(rows, brackets, keys, "left").fillna(1.0, ["_low", "_high"])
    first = pair_pass(first_rows, one + [Nearest()] * retrieval + [Histogram()] * mmd, keys, block_rows, visits)
    out = {c: silhouettes(first.where(F.col("_r") == i), keys) for i, c in enumerate(labels)}
    if not retrieval and not mmd:
        return out
    second_rows, two, slots, asked = rows, [], None, None
    if retrieval:
        least = first.where(F.col("_r") == len(one)).groupBy(*keys, F.col("_id").alias("id")).agg(F.min("_x").alias("_min"))
        asked = checkpointed(rows.where("_asks").select(*keys, "id", "_paired").join(least, [*keys, "id"]))
        second_rows = second_rows.join(asked.select(*keys, "id", (F.col("_paired") - tolerance("_min")).alias("_cut")), [*keys, "id"], "left")
        two.append(Closer())
    if mmd:
        slots = checkpointed(median_slots(first.where(F.col("_r") == len(one) + retrieval), brackets, keys))
        if slots.where("_missed").limit(1).count():
            norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
            far = rows.groupBy(*keys).agg((2 * F.max(norm) + 1e-9).alias("_far"))
            low = F.when(F.col("_under"), 0.0).otherwise(F.when(F.col("_over"), F.col("_high")).otherwise(F.col("_low")))
            high = F.when(F.col("_over"), F.col("_far")).otherwise(F.when(F.col("_under"), F.col("_low")).otherwise(F.col("_high")))
            brackets = checkpointed(attach_keyed(slots, far, keys).select(*keys, low.alias("_low"), high.alias("_high")))
            again = attach_keyed(rows, brackets, keys, "left").fillna(1.0, ["_low", "_high"])
            slots = checkpointed(median_slots(pair_pass(again, [Histogram()], keys, block_rows, visits), brackets, keys))
        slots = checkpointed(with_width(slots))
        second_rows = attach_keyed(second_rows, slots.select(*keys, "_low", "_high", "_slots", "_width"), keys, "left").fillna(1.0, ["_low", "_high", "_width"])
        two.append(KernelSums())
    second = pair_pass(second_rows, two, keys, block_rows, visits)
    if retrieval:
        closer = second.where("_r = 0").groupBy(*keys, F.col("_id").alias("id")).agg((F.sum("_n") + 1).alias("rank"))
        out["retrieval"] = asked.join(closer, [*keys, "id"]).select(
            *keys, "id", F.col("_paired").alias("paired_distance"), (F.col("_paired") <= F.col("_min") + tolerance("_min")).alias("top1"), "rank"
        )
    if mmd:
        counts = rows.groupBy(*keys).agg(F.count_if(F.col("_first")).alias("n_first"), F.count_if(~F.col("_first")).alias("n_second"))
        out["mmd"] = mmd_from(second.where(F.col("_r") == int(retrieval)), slots, counts, keys)
    return out
