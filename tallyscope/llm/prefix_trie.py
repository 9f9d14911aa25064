"""A trie of conversation prefixes, packed as double arrays and merged across shards.

Conversations are cut into levels of 32 turns.  A level's shard is the prefix
before it, known by two sums of 64-bit hashes that running totals give without
walking a conversation in one task.  Equal stretches of turns of a shard are
counted first, so a conversation that a third of all copies repeat is one row.

Stretches are dealt by ranges of (level, prefix, turns): a task holds neighbours
in the order of turns, a large shard spans several tasks and small ones share
one.  A task numbers the turns of a shard densely and packs its trie into BASE
and CHECK: the child of node s by turn c is BASE[s] + c, and CHECK of it is s.
Walking the stretches through the arrays gives every node its members and, from
the leaves up, the sums of its subtree.

Upper nodes that may go on in another task (those on the first or last path of
a shard that its neighbour may share) are merged by their path afterwards.
What lies in later levels is credited to the smallest member of each node, so
running totals from the end of a conversation hand it back to earlier levels,
however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.ordered import positions, running_totals
from tallyscope.functions.session import checkpointed

LEVEL = 32
SHARD_TURNS = 200_000
CHUNK_IDS = 4096
NONE_SHA = hashlib.sha256(b"").hexdigest()

NODE = (
    "node binary, parent binary, level int, start string, depth long, conv_id long, n_convs long, chars long, open boolean, deep boolean, onward boolean, "
    "parent_conv_id long, n_children long, n_leaves long, saved_tokens long, n_end long, stop string, path array<binary>"
)


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, key, chars): the turns of each conversation in order, ``pos`` from 0.

    NULL turns come first; equal turns go by role, then by the hash of their
    text; repeated rows are turns of their own.  NULL role and text are empty.
    ``key`` is the MD5 of role and text, ``chars`` the code points of the text.
    Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    slim = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.char_length(text).cast("long").alias("chars"), key.alias("key"),
        F.struct(F.col(f"`{turn_col}`").alias("t"), role.alias("r"), key.alias("k"), F.monotonically_increasing_id().alias("u")).alias("at"),
    )
    return positions(checkpointed(slim), ["conv_id"], "at").select("conv_id", "pos", "key", "chars")


def branched_turns(numbered: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, depth, key, chars): conversation c begins with the first h turns of conversation c - c % ``every``
    (all, if fewer), and goes on with its own after its first h; h is the crc32 of its number modulo ``heads``."""
    conv = F.col("conv_id")
    h = F.crc32(conv.cast("string").cast("binary")) % heads
    base = conv - conv % every
    first = checkpointed(numbered.where((conv % every == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base"))
    given = first.groupBy("base").agg(F.count(F.lit(1)).alias("given"))
    own = numbered.where(F.col("pos") >= h).withColumn("base", base).join(given, "base", "left")
    own = own.select("conv_id", (F.least(h, F.coalesce("given", F.lit(0))) + F.col("pos") - h + 1).alias("depth"), "key", "chars")
    convs = numbered.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    lent = convs.join(first, "base").where(F.col("pos") < F.col("h")).select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "chars")
    return own.unionByName(lent)


class DoubleArray:
    """BASE and CHECK over dense turn ids; node 0 is the root, free places have CHECK -1."""

    TRIES = 64

    def __init__(self) -> None:
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0], self.free, self.end = 0, 1, 1

    def _grow(self, upto: int) -> None:
        if upto >= len(self.check):
            more = max(upto + 1, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def add(self, node: int, turns: np.ndarray) -> np.ndarray:
        """Places for the children of ``node``: the first base at which all are free, within so many tries, or behind the end."""
        while self.free < self.end and self.check[self.free] != -1:
            self.free += 1
        at = self.free
        for _ in range(self.TRIES):
            base = at - int(turns[0])
            if at >= self.end:
                break
            self._grow(base + int(turns[-1]))
            if (self.check[base + turns] == -1).all():
                break
            at += 1
        else:
            base = self.end - int(turns[0])
        places = base + turns
        self._grow(int(places[-1]))
        self.base[node], self.check[places] = base, node
        self.end = max(self.end, int(places[-1]) + 1)
        return places

    def step(self, nodes: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children by ``turns``; every one must be there."""
        places = self.base[nodes] + turns
        if not (self.check[places] == nodes).all():
            raise AssertionError("a turn has no place in the trie")
        return places


def packed_trie(codes: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The double array of sequences (rows of ``codes``), which must stand in an order that keeps equal prefixes together."""
    trie = DoubleArray()
    nodes = np.zeros(len(codes), np.int64)
    for d in range(codes.shape[1]):
        live = np.flatnonzero(lengths > d)
        key, c = nodes[live], codes[live, d]
        first = np.ones(len(live), bool)
        first[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
        parents, turns = key[first], c[first]
        cuts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(parents)), strict=True):
            trie.add(int(parents[a]), np.sort(turns[a:b]))
        nodes[live] = trie.step(key, c)
    return trie


def shard_nodes(level: int, start: str, rows: list[tuple], left: bool, right: bool) -> list[tuple]:
    """Rows of ``NODE`` of one shard, or a part of it.

    ``rows`` are (keys, chars, members, smallest member, members that end, stop), in order.  ``left`` and ``right``
    say whether the shard may go on before the first and behind the last row.
    """
    ids: dict[bytes, int] = {}
    lengths = np.array([len(r[0]) for r in rows])
    codes = np.zeros((len(rows), int(lengths.max())), np.int64)
    for i, r in enumerate(rows):
        codes[i, : len(r[0])] = [ids.setdefault(k, len(ids)) for k in r[0]]
    trie = packed_trie(codes, lengths)
    size = trie.end
    n_convs, smallest = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    chars, depth, onward, opened = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, bool)
    members, least, ending = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
    turn_key: dict[int, bytes] = {}
    nodes, levels = np.zeros(len(rows), np.int64), []
    for d in range(codes.shape[1]):
        live = np.flatnonzero(lengths > d)
        nodes[live] = trie.step(nodes[live], codes[live, d])
        np.add.at(n_convs, nodes[live], members[live])
        np.minimum.at(smallest, nodes[live], least[live])
        new, one = np.unique(nodes[live], return_index=True)
        levels.append(new)
        depth[new] = d + 1
        for v, i in zip(new.tolist(), live[one].tolist(), strict=True):
            turn_key[v], chars[v] = rows[i][0][d], rows[i][1][d]
        for edge, wanted in ((0, left), (len(rows) - 1, right)):
            if wanted and lengths[edge] > d:
                opened[nodes[edge]] = True
    stop, n_end = {}, np.zeros(size, np.int64)
    for v, r, e, m in zip(nodes.tolist(), rows, ending.tolist(), members.tolist(), strict=True):
        stop[v], n_end[v], onward[v] = r[5], e, m > e
    root = hashlib.blake2b(f"{level}:{start}".encode(), digest_size=16).digest()
    name, path = {0: root}, {0: []}
    children, leaves, saved, deep = (np.zeros(size, np.int64) for _ in range(4))
    for new in levels:
        for v in new.tolist():
            p = int(trie.check[v])
            name[v] = hashlib.blake2b(name[p] + turn_key[v], digest_size=16).digest()
            path[v] = [*path[p], name[v]]
    out = []
    for new in reversed(levels):
        for v in new.tolist():
            p = int(trie.check[v])
            if not opened[v]:
                leaves[v] += not children[v] and not onward[v]
                saved[v] += (n_convs[v] - 1) * chars[v]
                children[p] += 1
                leaves[p] += leaves[v]
                saved[p] += saved[v]
            deep[v] |= onward[v]
            deep[p] |= deep[v]
            known = p and not opened[p]
            out.append((
                name[v], name[p], level, start, level * LEVEL + int(depth[v]), int(smallest[v]), int(n_convs[v]), int(chars[v]), bool(opened[v]), bool(deep[v]), bool(onward[v]),
                int(smallest[p]) if known else None, int(children[v]), int(leaves[v]), int(saved[v]), int(n_end[v]), stop.get(v), path[v] if opened[v] or onward[v] else None,
            ))
    return out


_ARROW = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("level", pa.int32()), ("start", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("chars", pa.int64()), ("open", pa.bool_()), ("deep", pa.bool_()), ("onward", pa.bool_()), ("parent_conv_id", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("n_end", pa.int64()), ("stop", pa.string()), ("path", pa.list_(pa.binary())),
])


def _tries(shard_turns: int):
    """Shards of a sorted partition, in parts of so many turns at most."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, held, left = None, [], 0, True
        for b in batches:
            for level, start, *rest in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if rows and ((level, start) != shard or held >= shard_turns):
                    same = (level, start) == shard
                    yield batch(shard_nodes(*shard, rows, left, same))
                    rows, held, left = [], 0, same
                shard = (level, start)
                rows.append(tuple(rest))
                held += len(rest[0])
        if rows:
            yield batch(shard_nodes(*shard, rows, left, True))

    return run


def ids_sha256(ends: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """(stop, ends_sha256): SHA-256 of the ascending decimal ids of each ``stop``, comma-joined.

    Ids are joined to chunks where they lie, in ranges of (stop, id); one task
    then reads the chunks of a stop in order, holding one at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stops, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, at = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or stops[i] != stops[at] or i - at >= chunk_ids:
                    out.append((stops[at], ids[at], ",".join(map(str, ids[at:i]))))
                    at = i
            if out:
                s, f, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(f, pa.int64()), pa.array(t)], names=["stop", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for stop, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if stop != now or state is None:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = stop, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["stop", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["stop", "ends_sha256"])

    dealt = ends.select("stop", "conv_id").repartitionByRange("stop", "conv_id").sortWithinPartitions("stop", "conv_id")
    pieces = dealt.mapInArrow(chunks, "stop string, first long, ids string")
    return pieces.repartition("stop").sortWithinPartitions("stop", "first").select("stop", "ids").mapInArrow(digests, "stop string, ends_sha256 string")


def prefix_nodes(turns: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``turns(conv_id, depth, key, chars)`` with the members ``convs(conv_id)``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.  ``depth`` counts from 1 without
    gaps; members without turns belong to the root alone.  Without members there
    are no nodes, not even a root.
    """
    spark = turns.sparkSession
    depth, level = F.col("depth"), F.floor((F.col("depth") - 1) / LEVEL).cast("int")
    # a stretch has LEVEL turns at most
    cut = turns.groupBy("conv_id", level.alias("level")).agg(F.sort_array(F.collect_list(F.struct("depth", "key", "chars"))).alias("at"))
    stretch = cut.select("conv_id", "level", F.transform("at", lambda x: x["key"]).alias("keys"), F.transform("at", lambda x: x["chars"]).alias("chars"))
    one, two = (F.xxhash64(F.lit(i), "level", "keys").cast("decimal(20,0)").alias(f"h{i}") for i in (1, 2))
    stretch = checkpointed(stretch.select("*", one, two))
    last = stretch.groupBy("conv_id").agg(F.max("level").alias("last"))
    stretch = stretch.join(last, "conv_id")
    name = lambda a, b: F.concat_ws(":", a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string"))
    alone = stretch.where("last = 0").select("conv_id", "level", "last", "keys", "chars", F.lit("0:0").alias("start"), name(F.col("h1"), F.col("h2")).alias("stop"))
    longer = running_totals(stretch.where("last > 0"), ["conv_id"], "level", ["h1", "h2"])
    longer = longer.select(
        "conv_id", "level", "last", "keys", "chars",
        name(F.col("cum_h1") - F.col("h1"), F.col("cum_h2") - F.col("h2")).alias("start"), name(F.col("cum_h1"), F.col("cum_h2")).alias("stop"),
    )
    stretch = checkpointed(alone.unionByName(longer))
    counted = checkpointed(
        stretch.groupBy("level", "start", "keys").agg(
            F.first("chars").alias("chars"), F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"),
            F.count_if(F.col("level") == F.col("last")).alias("ending"), F.first("stop").alias("stop"),
        )
    )
    dealt = counted.repartitionByRange("level", "start", "keys").sortWithinPartitions("level", "start", "keys")
    nodes = checkpointed(dealt.select("level", "start", "keys", "chars", "members", "least", "ending", "stop").mapInArrow(_tries(shard_turns), NODE))

    # upper nodes that several tasks may share
    whole, parts = nodes.where("not open"), nodes.where("open")
    merged = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("level").alias("level"), F.first("start").alias("start"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.first("chars").alias("chars"), F.lit(True).alias("open"), F.bool_or("deep").alias("deep"), F.bool_or("onward").alias("onward"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.sum("n_end").alias("n_end"), F.max("stop").alias("stop"), F.first("path").alias("path"),
    )
    merged = checkpointed(merged)
    shared = merged.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_shared"))
    merged = merged.join(shared, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_shared", F.lit(0))).drop("_shared")
    both = checkpointed(whole.unionByName(merged))
    top = both.where(depth == F.col("level") * LEVEL + 1)
    next_level = top.where("level > 0").groupBy(F.col("start").alias("stop")).agg(F.count(F.lit(1)).alias("_next"))
    onward = both.where("onward").select("node", "stop").join(next_level, "stop").select("node", "_next")
    both = both.join(onward, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_next", F.lit(0))).drop("_next")
    own, leaf = (F.col("n_convs") - 1) * F.col("chars"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    both = checkpointed(both.withColumn("_own", own).withColumn("_leaf", leaf))

    # what later levels add: credited to smallest members, summed from the end of each conversation
    credit = both.where("level > 0").groupBy("conv_id", "level").agg(F.sum("_own").alias("_own"), F.sum("_leaf").alias("_leaf"))
    steps = stretch.where("level > 0").select("conv_id", "level", "start").join(credit, ["conv_id", "level"], "left")
    steps = running_totals(steps.fillna(0, ["_own", "_leaf"]), ["conv_id"], "level", ["_own", "_leaf"])
    rest = [(F.col(f"total_{c}") - F.col(f"cum_{c}") + F.col(c)).alias(c) for c in ("_own", "_leaf")]
    below = steps.select("start", *rest).groupBy(F.col("start").alias("stop")).agg(F.sum("_own").alias("_own"), F.sum("_leaf").alias("_leaf"))
    later = both.where("onward").select("stop", "path").join(below, "stop").select("path", "_own", "_leaf")
    inner = both.where("open").select("path", (F.col("_own") + F.col("saved_tokens")).alias("_own"), (F.col("_leaf") + F.col("n_leaves")).alias("_leaf"))
    # a path has LEVEL nodes at most
    added = inner.unionByName(later).select(F.explode("path").alias("node"), "_own", "_leaf").groupBy("node").agg(F.sum("_own").alias("_own_added"), F.sum("_leaf").alias("_leaf_added"))
    touched = both.where("open or deep").join(checkpointed(added), "node", "left").fillna(0, ["_own_added", "_leaf_added"])
    kept = lambda c: F.when(F.col("open"), F.lit(0)).otherwise(F.col(c))
    touched = touched.withColumn("saved_tokens", kept("saved_tokens") + F.col("_own_added")).withColumn("n_leaves", kept("n_leaves") + F.col("_leaf_added"))
    final = both.where("not open and not deep").unionByName(touched.drop("_own_added", "_leaf_added"))

    # parents that the task of the node did not know for certain
    members = convs.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct()
    sums = both.agg(F.coalesce(F.sum("_own"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("_leaf"), F.lit(0)).alias("n_leaves"), F.count_if(depth == 1).alias("n_children")).first()
    smallest, total = members.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    known = both.where("open").select(F.col("node").alias("_ref"), F.col("conv_id").alias("_parent"))
    known = known.unionByName(both.where("onward").select(F.col("stop").cast("binary").alias("_ref"), F.col("conv_id").alias("_parent")))
    ref = F.when(depth == F.col("level") * LEVEL + 1, F.col("start").cast("binary")).otherwise(F.col("parent"))
    asked = final.where("parent_conv_id is null and depth > 1").withColumn("_ref", ref).join(known, "_ref", "left").withColumn("parent_conv_id", F.col("_parent")).drop("_ref", "_parent")
    first = final.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long"))
    final = final.where("parent_conv_id is not null").unionByName(asked).unionByName(first)

    ends = stretch.where("level = last").select("stop", "conv_id")
    turnless = members.join(stretch.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit("").alias("stop"), "conv_id")
    digest = checkpointed(ids_sha256(checkpointed(ends.unionByName(turnless))))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = final.where("n_end > 0").join(digest, "stop").select(*columns, "ends_sha256")
    passed = final.where("n_end = 0").select(*columns, F.lit(NONE_SHA).alias("ends_sha256"))
    if smallest is None:
        return ended.unionByName(passed)
    row = (smallest, 0, None, total, sums["n_children"], sums["n_leaves"] if sums["n_children"] else 1, sums["saved_tokens"])
    root = spark.createDataFrame([row], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    none = F.coalesce("ends_sha256", F.lit(NONE_SHA)).alias("ends_sha256")
    root = root.withColumn("stop", F.lit("")).join(digest.where("stop = ''"), "stop", "left").select(*columns, none)
    return ended.unionByName(passed).unionByName(root)
