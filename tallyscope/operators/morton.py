"""Exact nearest neighbours over ranges of a Morton curve.

1. Rows at one location become one row with the few smallest ids that can be
   chosen there.
2. Locations are dealt by ranges of (group, Morton code): a crowded region gets
   as many ranges as it has rows, and small groups share one.
3. A task searches its range through leaves of consecutive codes and their
   bounding boxes.  Groups that lie inside one range are done with that.
4. A location of a group that spans ranges is open while the box of another
   range is nearer than its k-th neighbour so far.  Only such locations, at the
   rims, are asked again: each goes to the nearest boxes, and of those ranges only
   the halo, the cells that an asking ball can reach, is sent along.  What
   comes back shrinks the ball; rounds go on until no box is in reach.

The curve only decides what lies together; distances and boxes are those of the
coordinates, so the result is exact for any layout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach_keyed
from tallyscope.functions.session import checkpointed

CHUNK = 1 << 15
# At most so many ranges: their boxes (and halo cells, 1024 flags each) are what the driver holds and sends out.
MOST_CHUNKS = 1 << 16
LEAF = 64
HALO = 1024
# A range is an uneven shape: it is described by the boxes of so many runs of its codes.
RUNS = 16
ASK_BLOCK = 1 << 17


def _bits(n: int) -> int:
    return min(31, 62 // n)


def morton_code(cells: Sequence[Column]) -> Column:
    """The bits of whole numbers, interleaved."""
    n, out = len(cells), None
    for i, c in enumerate(cells):
        if n == 2:
            # fixed values: masks that keep ever smaller runs of bits apart
            for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
                c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask))
            c = F.shiftleft(c, i)
        elif n > 2:
            bits = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * n + i) for b in range(_bits(n))]
            c = sum(bits[1:], bits[0])
        out = c if out is None else out.bitwiseOR(c)
    return out


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box, never above that to a point inside it."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - p, p - high[None, :, d]), 0.0)
        out += gap * gap
    return out


def leaf_search(queries: np.ndarray, points: np.ndarray, ranks: np.ndarray, need: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, places, squared distances): each query's ``need`` nearest points within its ``bound``, ties by rank.

    ``points`` lie in curve order, so that runs of them are small boxes; queries
    in curve order share what they look at.
    """
    starts = np.arange(0, len(points), LEAF)
    low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
    ends = np.append(starts[1:], len(points))
    sizes, out_n, out_i, out_d = ends - starts, [], [], []

    def inside(leaves: np.ndarray) -> np.ndarray:
        n = sizes[leaves]
        return np.repeat(starts[leaves] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())

    def squares(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(at)))
        for d in range(q.shape[1]):
            gap = q[:, d, None] - points[at][None, :, d]
            out += gap * gap
        return out

    for lo in range(0, len(queries), LEAF):
        q, radius = queries[lo : lo + LEAF], bound[lo : lo + LEAF].copy()
        gaps = box_gaps(q, low, high)
        nearest = np.unique(gaps.argmin(1))
        if sizes[nearest].sum() < need:
            near = np.argsort(gaps.min(0), kind="stable")
            nearest = near[: np.searchsorted(np.cumsum(sizes[near]), need) + 1]
        at = inside(nearest)
        if len(at) >= need:
            radius = np.minimum(radius, np.partition(squares(q, at), need - 1, axis=1)[:, need - 1])
        at = inside(np.flatnonzero((gaps <= radius[:, None]).any(0)))
        d2 = squares(q, at)
        if len(at) > need:
            radius = np.minimum(radius, np.partition(d2, need - 1, axis=1)[:, need - 1])
        row, col = np.nonzero(d2 <= radius[:, None])
        order = np.lexsort((ranks[at[col]], d2[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < need], col[place < need]
        out_n.append(np.bincount(row, minlength=len(q)))
        out_i.append(at[col])
        out_d.append(d2[row, col])
    counts = np.concatenate(out_n) if out_n else np.zeros(0, np.int64)
    return np.append(0, np.cumsum(counts)), np.concatenate(out_i or [np.zeros(0, np.int64)]), np.concatenate(out_d or [np.zeros(0)])


def _expanded(dsts: pa.Array, need: int) -> tuple[np.ndarray, pa.Array]:
    """(row of each candidate, ids): at most ``need`` per row."""
    n = np.minimum(np.array([len(x) if x is not None else 0 for x in dsts.to_pylist()], np.int64), need)
    begin = np.asarray(dsts.offsets)[: len(n)].astype(np.int64)
    at = np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    return np.repeat(np.arange(len(n)), n), dsts.values.take(pa.array(at))


def _ranks(ids: pa.Array) -> np.ndarray:
    values = ids.to_numpy(zero_copy_only=False)
    return np.unique(values, return_inverse=True)[1] if len(values) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class _Boxes:
    """The pieces of a group in curve order: number, range and first code of each, the boxes of its runs, where these begin, and the box of all."""

    piece: np.ndarray
    range: np.ndarray
    first: np.ndarray
    run_low: np.ndarray
    run_high: np.ndarray
    runs: np.ndarray
    low: np.ndarray
    high: np.ndarray


class _Search:
    """The steps of one search; ``keys`` and ``dims`` name columns of all tables it makes."""

    def __init__(self, locations: DataFrame, keys: list[str], dims: list[str], need: int, chunks: int) -> None:
        self.locations, self.keys, self.dims, self.need, self.chunks = locations, keys, dims, need, chunks
        self.place = [*keys, *dims]
        self.key_ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in locations.schema.fields if f.name in keys]
        dst = locations.schema["_dsts"].dataType.simpleString()
        src = locations.schema["_srcs"].dataType.simpleString()
        self.state = [*self.key_ddl, *[f"`{d}` double" for d in dims], "_code long", f"_srcs {src}", f"_near_ids {dst}", "_near_d2 array<double>", "_p int", "_seen int"]

    def ranged(self) -> DataFrame:
        """Lists of each range (``_kind`` 0) and its boxes of groups that may span ranges (``_kind`` 1)."""
        order = [*self.keys, "_code"]
        loc = self.locations.select(*self.place, "_code", "_dsts", "_srcs")
        dealt = loc.repartitionByRange(self.chunks, *order) if self.chunks > 1 else loc.repartition(1)
        n_keys, n_dims, need, several = len(self.keys), len(self.dims), self.need, self.chunks > 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            column = [table.column(i).chunk(0) for i in range(table.num_columns)]
            keys = list(zip(*[c.to_pylist() for c in column[:n_keys]], strict=True))
            points = np.stack([c.to_numpy() for c in column[n_keys : n_keys + n_dims]], 1)
            code, srcs = column[n_keys + n_dims].to_numpy(), column[-1]
            row, ids = _expanded(column[-2], need)
            asking = np.array([bool(x) for x in srcs.to_pylist()])
            ranks = _ranks(ids)
            cuts = [0, *[i for i in range(1, n) if keys[i] != keys[i - 1]], n]
            number = TaskContext.get().partitionId()
            whole, boxes = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = slice(*np.searchsorted(row, [a, b]))
                q = a + np.flatnonzero(asking[a:b])
                edge = several and (a == 0 or b == n)
                if some.stop > some.start:
                    own = points[row[some]]
                    offsets, at, d2 = leaf_search(points[q], own, ranks[some], need, np.full(len(q), np.inf))
                    if edge:
                        runs = np.unique(np.linspace(0, len(own), min(RUNS, len(own)), endpoint=False).astype(int))
                        boxes.append((a, np.minimum.reduceat(own, runs).ravel(), np.maximum.reduceat(own, runs).ravel(), int(code[a])))
                else:
                    offsets, at, d2 = np.zeros(len(q) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
                whole.append((q, offsets, at + some.start, d2, edge))
            q = np.concatenate([w[0] for w in whole])
            counts = np.concatenate([np.diff(w[1]) for w in whole])
            offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            at, d2 = np.concatenate([w[2] for w in whole]), np.concatenate([w[3] for w in whole])
            edge = np.repeat([w[4] for w in whole], [len(w[0]) for w in whole])
            take = pa.array(q)
            rows = [c.take(take) for c in column[: n_keys + n_dims + 1]] + [srcs.take(take)]
            rows += [pa.ListArray.from_arrays(offsets, ids.take(pa.array(at))), pa.ListArray.from_arrays(offsets, pa.array(d2))]
            rows += [pa.array(np.full(len(q), number, np.int32)), pa.array(np.zeros(len(q), np.int32)), pa.array(np.zeros(len(q), np.int32)), pa.array(edge)]
            rows += [pa.nulls(len(q), t) for t in (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=names)
            if boxes:
                at, low, high, first = zip(*boxes, strict=True)
                take, m = pa.array(at), len(at)
                rows = [c.take(take) for c in column[:n_keys]] + [pa.nulls(m, c.type) for c in column[n_keys : n_keys + n_dims + 1]] + [pa.nulls(m, srcs.type)]
                rows += [pa.nulls(m, pa.list_(ids.type)), pa.nulls(m, pa.list_(pa.float64())), pa.array([number] * m, pa.int32()), pa.nulls(m, pa.int32()), pa.array([1] * m, pa.int32()), pa.array([True] * m)]
                rows += [pa.array([x.tolist() for x in v]) for v in (low, high)] + [pa.array(first, pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=names)

        ddl = [*self.state, "_kind int", "_edge boolean", "_low array<double>", "_high array<double>", "_from long"]
        names = [d.split(" ")[0].strip("`") for d in ddl]
        return dealt.sortWithinPartitions(*order).mapInArrow(run, ", ".join(ddl))

    def boxes(self, found: DataFrame) -> dict[tuple, _Boxes]:
        """The pieces of every group that touches an end of a range: its part of each range."""
        groups: dict[tuple, list] = {}
        rows = found.where("_kind = 1").select(*self.keys, "_p", "_low", "_high", "_from").collect()
        for r in sorted(rows, key=lambda r: (r["_p"], r["_from"])):
            groups.setdefault(tuple(r[: len(self.keys)]), []).append(r)
        out, number, d = {}, 0, len(self.dims)
        for key, g in groups.items():
            low, high = ([np.array(r[c]).reshape(-1, d) for r in g] for c in ("_low", "_high"))
            runs = np.append(0, np.cumsum([len(x) for x in low])[:-1])
            out[key] = _Boxes(
                np.arange(number, number + len(g)), np.array([r["_p"] for r in g]), np.array([r["_from"] for r in g]), np.concatenate(low), np.concatenate(high), runs,
                np.stack([x.min(0) for x in low]), np.stack([x.max(0) for x in high]),
            )
            number += len(g)
        return out

    def asked(self, state: DataFrame, sent, visits: int) -> DataFrame:
        """``state`` with the next pieces that each location must visit, and the cells of them that its ball reaches."""
        n_keys, n_dims, need = len(self.keys), len(self.dims), self.need
        axis = _axis(n_dims)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes = sent.value
            for b in batches:
                keys = list(zip(*[b.column(i).to_pylist() for i in range(n_keys)], strict=True))
                points = np.stack([b.column(n_keys + i).to_numpy() for i in range(n_dims)], 1)
                own, seen = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_p", "_seen"))
                lists = b.column(b.schema.get_field_index("_near_d2")).to_pylist()
                radius = np.array([x[need - 1] if len(x) >= need else np.inf for x in lists])
                targets: list[list] = [[] for _ in keys]
                by_key: dict[tuple, list] = {}
                for i, key in enumerate(keys):
                    by_key.setdefault(key, []).append(i)
                for key, rows in by_key.items():
                    if key not in boxes:
                        continue
                    g_ = boxes[key]
                    pieces, low, high = g_.piece, g_.low, g_.high
                    for lo in range(0, len(rows), 256):
                        some = np.array(rows[lo : lo + 256])
                        gaps = np.minimum.reduceat(box_gaps(points[some], g_.run_low, g_.run_high), g_.runs, axis=1)
                        gaps[own[some][:, None] == g_.range[None, :]] = np.nan
                        for i, g in zip(some.tolist(), gaps, strict=True):
                            hit = np.flatnonzero(g <= radius[i])
                            # what was visited had smaller gaps than the ball then had, so it comes first in the same order
                            hit = hit[np.lexsort((hit, g[hit]))][seen[i] : seen[i] + visits]
                            reach = math.sqrt(radius[i]) * (1 + 1e-9) if np.isfinite(radius[i]) else np.inf
                            first = _cells(points[i] - reach, low[hit], high[hit], axis)
                            last = _cells(points[i] + reach, low[hit], high[hit], axis)
                            targets[i] = [{"piece": int(p), "first": f.tolist(), "last": z.tolist(), "r2": float(radius[i])} for p, f, z in zip(pieces[hit], first, last, strict=True)]
                kind = pa.list_(pa.struct([("piece", pa.int32()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("r2", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(targets, kind)], names=[*b.schema.names, "_to_visit"])

        return state.mapInArrow(run, ", ".join([*self.state, "_to_visit array<struct<piece: int, first: array<int>, last: array<int>, r2: double>>"]))

    def halo(self, sent, cells: DataFrame) -> DataFrame:
        """Candidates in the cells that some ball reaches: (piece, dims…, _code, _dsts)."""
        n_keys, n_dims = len(self.keys), len(self.dims)
        axis = _axis(n_dims)
        reached: dict[int, np.ndarray] = {r["piece"]: np.array(r["cells"]) for r in cells.groupBy("piece").agg(F.collect_set("cell").alias("cells")).collect()}
        marks = cells.sparkSession.sparkContext.broadcast({p: np.isin(np.arange(axis**n_dims), c) for p, c in reached.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes, wanted = sent.value, marks.value
            for b in batches:
                keys = list(zip(*[b.column(i).to_pylist() for i in range(n_keys)], strict=True))
                points = np.stack([b.column(n_keys + i).to_numpy() for i in range(n_dims)], 1)
                code = b.column(n_keys + n_dims).to_numpy()
                piece, kept = np.full(len(keys), -1, np.int32), np.zeros(len(keys), bool)
                by_key: dict[tuple, list] = {}
                for i, key in enumerate(keys):
                    if key in boxes:
                        by_key.setdefault(key, []).append(i)
                for key, rows in by_key.items():
                    pieces, low, high = boxes[key].piece, boxes[key].low, boxes[key].high
                    rows = np.array(rows)
                    at = np.maximum(np.searchsorted(boxes[key].first, code[rows], "right") - 1, 0)
                    piece[rows] = pieces[at]
                    for j in np.unique(at):
                        mark = wanted.get(int(pieces[j]))
                        if mark is not None:
                            mine = rows[at == j]
                            kept[mine] = mark[(_cells(points[mine], low[j], high[j], axis) * axis ** np.arange(n_dims)).sum(1)]
                take = pa.array(np.flatnonzero(kept))
                columns = [pa.array(piece).take(take), *[b.column(n_keys + i).take(take) for i in range(n_dims + 2)]]
                yield pa.RecordBatch.from_arrays(columns, names=["piece", *[b.schema.names[n_keys + i] for i in range(n_dims + 2)]])

        loc = self.locations.where("_dsts is not null").select(*self.place, "_code", "_dsts")
        dst = self.locations.schema["_dsts"].dataType.simpleString()
        return loc.mapInArrow(run, ", ".join(["piece int", *[f"`{d}` double" for d in self.dims], "_code long", f"_dsts {dst}"]))

    def visited(self, asks: DataFrame, halo: DataFrame) -> DataFrame:
        """(keys…, dims…, _near_ids, _near_d2): what each asking location finds in a piece."""
        dims, need, place = self.dims, self.need, self.place
        # a piece that very many ask is visited in blocks of them
        blocks = checkpointed(asks.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / ASK_BLOCK).cast("int").alias("_blocks")))
        left = asks.join(blocks, "piece").withColumn("_block", F.pmod(F.xxhash64(*dims), F.col("_blocks")).cast("int")).drop("_blocks")
        right = halo.join(blocks, "piece").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

        def visit(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*place, "_near_ids", "_near_d2"]})
            a, b = a.sort_values("_code", kind="stable"), b.sort_values("_code", kind="stable")
            row, ids = _expanded(pa.array(b["_dsts"].tolist()), need)
            offsets, at, d2 = leaf_search(a[dims].to_numpy(float), b[dims].to_numpy(float)[row], _ranks(ids), need, a["r2"].to_numpy(float))
            names = ids.to_numpy(zero_copy_only=False)
            parts = list(zip(offsets[:-1], offsets[1:], strict=True))
            return a[place].assign(_near_ids=[names[at[x:y]] for x, y in parts], _near_d2=[d2[x:y] for x, y in parts])

        dst = self.locations.schema["_dsts"].dataType.simpleString()
        ddl = ", ".join([*self.key_ddl, *[f"`{d}` double" for d in dims], f"_near_ids {dst}", "_near_d2 array<double>"])
        return left.groupBy("piece", "_block").cogroup(right.groupBy("piece", "_block")).applyInPandas(visit, ddl)

    def lists(self, max_rounds: int = 32) -> DataFrame:
        """(keys…, dims…, _srcs, _near): every asking location's nearest, as structs (d2, dst)."""
        names = [d.split(" ")[0].strip("`") for d in self.state]
        near = F.arrays_zip(F.col("_near_d2").alias("d2"), F.col("_near_ids").alias("dst")).alias("_near")
        found = checkpointed(self.ranged())
        if self.chunks == 1:
            return found.select(*self.place, "_srcs", near)
        spark = found.sparkSession
        sent = spark.sparkContext.broadcast(self.boxes(found))
        done = [found.where("_kind = 0 and not _edge").select(*self.place, "_srcs", near)]
        state, visits = found.where("_kind = 0 and _edge").select(*names), 4
        for _ in range(max_rounds):
            asked = checkpointed(self.asked(state, sent, visits))
            done.append(asked.where("size(_to_visit) = 0").select(*self.place, "_srcs", near))
            open_ = asked.where("size(_to_visit) > 0")
            asks = open_.select(*self.place, "_code", F.explode("_to_visit").alias("_v")).select(*self.place, "_code", "_v.*")
            if asks.isEmpty():
                break
            cell = F.lit(0)
            cells = asks.select("piece", "first", "last")
            for i in range(len(self.dims)):
                cells = cells.withColumn(f"_c{i}", F.explode(F.sequence(F.col("first")[i], F.col("last")[i])))
                cell = cell + F.col(f"_c{i}") * _axis(len(self.dims)) ** i
            cells = cells.select("piece", cell.alias("cell")).distinct()
            hits = self.visited(asks.drop("first", "last"), self.halo(sent, cells))
            merged = open_.select(*names).unionByName(hits, allowMissingColumns=True).withColumn("_pairs", F.arrays_zip(F.col("_near_d2").alias("d2"), F.col("_near_ids").alias("dst")))
            # a location has few visits in a round, and each returns no more than the list holds
            best = F.slice(F.array_sort(F.flatten(F.collect_list("_pairs"))), 1, self.need)
            merged = merged.groupBy(*self.place).agg(
                best.alias("_best"), F.first("_code", True).alias("_code"), F.first("_srcs", True).alias("_srcs"), F.first("_p", True).alias("_p"), F.first("_seen", True).alias("_seen")
            )
            state = merged.select(
                *self.place, "_code", "_srcs", F.transform("_best", lambda x: x["dst"]).alias("_near_ids"), F.transform("_best", lambda x: x["d2"]).alias("_near_d2"),
                "_p", (F.col("_seen") + visits).alias("_seen"),
            )
            visits *= 4
        else:
            raise RuntimeError("the search did not close")
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out


def _axis(n_dims: int) -> int:
    return max(1, int(round(HALO ** (1 / n_dims) - 0.5)))


def _cells(points: np.ndarray, low: np.ndarray, high: np.ndarray, axis: int) -> np.ndarray:
    """Cell numbers along each axis of a box, clipped to it; never falling where a coordinate rises."""
    side = np.where(high > low, high - low, 1.0)
    return np.clip(np.floor((np.clip(points, low, high) - low) / side * axis), 0, axis - 1).astype(np.int32)


def nearest(
    query: DataFrame, ref: DataFrame, k: int, dims: Sequence[str] = ("x", "y"), by: Sequence[str] = (),
    id_col: str = "obs_id", same: bool = False, strict: bool = False, chunk: int = CHUNK,
) -> DataFrame:
    """(by…, src, dst, rank, d2): the k nearest ``ref`` rows of every query row.

    Order is squared distance, then id.  With ``same`` the two tables are one
    and a row is not its own neighbour.  Rows without a coordinate neither ask
    nor answer.  Where a group has fewer than k others its lists are short;
    ``strict`` refuses such a group.  ``chunk`` is the number of locations of a range.
    """
    need, dims = k + 1 if same else k, list(dims)
    keys, added = list(by), not by
    if added:
        query, ref, keys = query.withColumn("_k", F.lit(0)), ref.withColumn("_k", F.lit(0)), ["_k"]
    place = [*keys, *dims]
    whole = lambda df: df.where(" and ".join(f"`{d}` is not null and not isnan(`{d}`)" for d in dims))
    points = lambda df, name: whole(df.select(*keys, *[F.col(d).cast("double").alias(d) for d in dims], F.col(id_col).alias(name)))
    refs, asks = points(ref, "_dst"), points(query, "_src")

    both = refs.select(*place, F.lit(1).alias("_r"))
    if not same:
        both = both.unionByName(asks.select(*place, F.lit(0).alias("_r")))
    box = both.groupBy(*keys).agg(
        *[F.min(d).alias(f"_lo_{d}") for d in dims], F.greatest(F.lit(0.0), *[F.max(d) - F.min(d) for d in dims]).alias("_side"),
        F.sum("_r").alias("_n"), F.count(F.lit(1)).alias("_all"),
    )
    box = checkpointed(box.withColumn("_side", F.when(F.col("_side") > 0, F.col("_side")).otherwise(1.0)))
    rows, least = box.agg(F.coalesce(F.sum("_all"), F.lit(0)), F.min("_n")).first()
    if strict and rows and least < need:
        raise ValueError(f"{k} neighbours asked for, but a group has {least} rows" + (" itself included" if same else ""))

    def few(df: DataFrame, name: str) -> DataFrame:
        """One row per location with its smallest ids, one more than can be chosen."""
        order = F.row_number().over(Window.partitionBy(*place).orderBy(name))
        return df.withColumn("_rn", order).where(F.col("_rn") <= need + 1).groupBy(*place).agg(F.sort_array(F.collect_list(name)).alias(f"{name}s"))

    locations = few(refs, "_dst")
    if same:
        locations = locations.withColumn("_srcs", F.col("_dsts"))
    else:
        parts = locations.withColumn("_srcs", F.lit(None).cast(f"array<{asks.schema['_src'].dataType.simpleString()}>"))
        parts = parts.unionByName(few(asks, "_src").withColumn("_dsts", F.lit(None).cast(locations.schema["_dsts"].dataType)))
        locations = parts.groupBy(*place).agg(F.first("_dsts", True).alias("_dsts"), F.first("_srcs", True).alias("_srcs"))
    located = attach_keyed(locations, box.drop("_n", "_all"), keys)
    scale = F.lit(float(2 ** _bits(len(dims)) - 1))
    cells = [F.floor((F.col(d) - F.col(f"_lo_{d}")) / F.col("_side") * scale).cast("long") for d in dims]
    seen = Observation()
    located = located.select(*place, "_dsts", "_srcs", morton_code(cells).alias("_code")).observe(seen, F.count_if(F.size("_srcs") > need).alias("crowded"))
    located = checkpointed(located)
    chunks = max(1, min(MOST_CHUNKS, math.ceil(rows / chunk)))
    lists = _Search(located, keys, dims, need, chunks).lists()

    plain = lists.where(F.size("_srcs") <= need).select(*keys, F.explode("_srcs").alias("src"), "_near")
    if seen.get["crowded"]:
        # every row of a location with more rows than its list holds
        at = lists.where(F.size("_srcs") > need).select(*place, "_near")
        plain = plain.unionByName(asks.withColumnRenamed("_src", "src").join(at, place).select(*keys, "src", "_near"))
    own = F.slice(F.filter("_near", lambda x: x["dst"] != F.col("src")), 1, k) if same else F.col("_near")
    edges = plain.select(*by, "src", F.posexplode(own).alias("_i", "_e"))
    return edges.select(*by, "src", F.col("_e.dst").alias("dst"), (F.col("_i") + 1).alias("rank"), F.col("_e.d2").alias("d2"))
