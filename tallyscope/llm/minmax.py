"""Near-duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, the smallest
and the largest hash, so 80 evaluations make 160 values: 40 bands of four.  Both
ends estimate the Jaccard similarity without bias, and a band of two minima and
two maxima agrees with about its fourth power.  At a similarity of 0.75 a link
is missed by all 40 bands with a probability of about 3e-7.

1. One pass over whole texts gives each document its set size, a 64-bit key of
   the shingle set and its bands.  Equal sets are one node from here on.
2. In each bucket (equal band) the nodes are compared with one centre, the node
   whose buckets hold most rows.  Candidates that cannot reach the threshold by
   their sizes alone fall out.  Confirmed links join nodes to components.
3. The nodes of buckets that still hold several components (texts that share a
   passage, mostly) are joined exactly on the rarest shingles of their full sets.
   So every candidate pair is confirmed or refuted on full sets, or connected
   already, and no group is ever turned into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import free_name
from tallyscope.llm.links import components
from tallyscope.llm.textbytes import BASE, BLANKS, LOWER, Hasher, blocks, buffer_of, mixed, powers, runs

WORDS = 5
BANDS = 40
PER_BAND = 2
THRESHOLD = (75, 100)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of each text.

    Words are ASCII lower-cased runs of bytes other than space and tab to
    carriage return.  A text with fewer words than a shingle is one shingle; one
    without words has none.
    """
    raw, offsets = buffer_of(texts)
    data = LOWER[raw]
    t = runs((~BLANKS[data]).astype(np.uint8), offsets)
    w = Hasher(data)(t.start, t.end)
    counts = np.diff(t.bounds)
    n = len(w)
    weights = powers(BASE, words)
    sums = np.zeros(n, np.uint64)
    for i in range(words):
        sums[: n - i] += w[i:] * weights[i] if n > i else np.uint64(0)
    shingles = mixed(sums)
    place = np.arange(n) - t.bounds[t.text] if n else np.zeros(0, np.int64)
    full = place <= counts[t.text] - words if n else np.zeros(0, bool)
    for d in np.flatnonzero((counts > 0) & (counts < words)):
        a, b = t.bounds[d], t.bounds[d + 1]
        whole = (w[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        shingles[a] = mixed(np.array([whole]))[0]
        full[a] = True
    upto = np.concatenate([[0], np.cumsum(full)])[t.bounds]
    kept, out, bounds = shingles[full], [], [0]
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        s = np.sort(kept[a:b])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        bounds.append(bounds[-1] + len(s))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(bounds)


def signatures(hashes: np.ndarray, bounds: np.ndarray, bands: int = BANDS, per_band: int = PER_BAND) -> np.ndarray:
    """(non-empty texts, bands): band keys from the minima and maxima under bands * per_band permutations."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    keys = np.zeros((len(starts), bands), np.uint64)
    if not len(starts):
        return keys
    rule = mixed(np.arange(1, 2 * bands * per_band + 1, dtype=np.uint64)).reshape(bands, per_band, 2)
    for i in range(bands):
        key = np.full(len(starts), i + 1, np.uint64)
        for j in range(per_band):
            permuted = hashes * (rule[i, j, 0] | np.uint64(1)) + rule[i, j, 1]
            for value in (np.minimum.reduceat(permuted, starts), np.maximum.reduceat(permuted, starts)):
                key = mixed(key * BASE + value)
        keys[:, i] = key
    return keys


def row_key(doc_id: Column, text: Column) -> Column:
    """A key for rows that are equal in id and text."""
    return F.xxhash64(doc_id.cast("string"), text)


def describe(docs: DataFrame, words: int = WORDS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_shingles, node, bands) per row.

    ``row_key`` is a hash of id and text, ``node`` the key of the shingle set,
    NULL without shingles.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                hashes, bounds = shingle_sets(part.column(1), words)
                sizes = np.diff(bounds)
                some = sizes > 0
                starts = bounds[:-1][some]
                node = np.zeros(len(sizes), np.int64)
                if len(starts):
                    node[some] = mixed(np.add.reduceat(mixed(hashes ^ BASE), starts) + sizes[some].astype(np.uint64)).view(np.int64)
                keys = signatures(hashes, bounds, bands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes), pa.array(node, mask=~some), lists],
                    ["doc_id", "row_key", "n_shingles", "node", "bands"],
                )

    return rows.mapInArrow(run, "doc_id long, row_key long, n_shingles long, node long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, shingles) for ``nodes(doc_id, node)``, from the whole text of the named document of each."""
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    wanted = nodes.select(key(F.col("doc_id")).alias("_id")).distinct()
    texts = docs.select(key(F.col(f"`{id_col}`")).alias("_id"), F.col(f"`{text_col}`").alias("text")).join(wanted, "_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0):
                hashes, bounds = shingle_sets(part.column(0), words)
                sizes = np.diff(bounds)
                some = sizes > 0
                if some.any():
                    node = mixed(np.add.reduceat(mixed(hashes ^ BASE), bounds[:-1][some]) + sizes[some].astype(np.uint64)).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(node), lists], ["node", "shingles"])

    made = texts.mapInArrow(run, "node long, shingles array<long>")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets reach the threshold."""
    num, den = threshold
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("_i"), (F.size("_sa") + F.size("_sb")).alias("_n"))
    return joined.where(den * F.col("_i") >= num * (F.col("_n") - F.col("_i"))).select("a", "b")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """All pairs (a, b) of ``nodes(node, n, root)`` with different roots that can reach the threshold.

    Sets of x and y shingles that reach t share at least s = ceil(t (x + y) / (1 + t)),
    so in any common order they meet within the first x - s + 1 shingles of one
    and the first y - s + 1 of the other.  For the smaller set that is a seventh
    of its shingles at t = 0.75.  The order is rarest first, so passages that many
    texts share come last, and shingles of a single node need no row at all.
    """
    num, den = threshold
    listed = nodes.join(sets, "node").select("node", "n", "root", F.explode("shingles").alias("g"))
    shared = checkpointed(listed.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    own = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "g"))
    rows = listed.join(shared, "g").select("g", "node", "n", "root", place.alias("at"))
    rows = checkpointed(rows.where(F.col("at") + F.ceil(F.lit(num) * F.col("n") / den) <= F.col("n") + 1))
    small = rows.where(F.col("at") + F.ceil(F.lit(2 * num) * F.col("n") / (num + den)) <= F.col("n") + 1)
    large = rows.select("g", F.col("node").alias("b"), F.col("n").alias("_bn"), F.col("root").alias("_br"), F.col("at").alias("_bat"))
    least = F.ceil(F.lit(num) * (F.col("n") + F.col("_bn")) / (num + den))
    meet = (
        (small["g"] == large["g"]) & (F.col("root") != F.col("_br"))
        & ((F.col("n") < F.col("_bn")) | ((F.col("n") == F.col("_bn")) & (F.col("node") < F.col("b"))))
        & (F.col("at") + least <= F.col("n") + 1) & (F.col("_bat") + least <= F.col("_bn") + 1)
    )
    return small.join(large, meet).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def link_nodes(docs: DataFrame, sketches: DataFrame, threshold: tuple[int, int] = THRESHOLD, words: int = WORDS,
               id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(node, root) of linked nodes, and the confirmed links (a, b)."""
    num, den = threshold
    classes = sketches.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    rows = classes.select("node", "doc_id", "n", F.explode("bands").alias("band"))
    shared = checkpointed(rows.groupBy("band").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"))
    weight = F.sum("_rows").over(Window.partitionBy("node")).alias("weight")
    rows = checkpointed(rows.join(shared, "band").select("band", "node", "doc_id", "n", weight))
    sets = checkpointed(full_sets(docs, rows.select("node", "doc_id").distinct(), words, id_col, text_col))

    centre = F.max(F.struct("weight", "node", "n"))
    chosen = checkpointed(rows.groupBy("band").agg(centre.alias("c")).select("band", F.col("c.node").alias("_c"), F.col("c.n").alias("_cn")))
    fits = (den * F.least("n", "_cn") >= num * F.greatest("n", "_cn")) & (F.col("node") != F.col("_c"))
    pairs = rows.join(chosen, "band").where(fits).select(F.least("node", "_c").alias("a"), F.greatest("node", "_c").alias("b")).distinct()
    links = checkpointed(confirmed(checkpointed(pairs), sets, threshold))
    roots = components(links)

    marked = rows.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    unsettled = checkpointed(marked.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("band"))
    left = checkpointed(marked.join(unsettled, "band").select("node", "n", "root").distinct())
    more = checkpointed(confirmed(checkpointed(prefix_pairs(left, sets, threshold)), sets, threshold))
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    return roots, links


def near_duplicates(
    docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, words: int = WORDS, bands: int = BANDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, node, row_key) per row.

    ``component_id`` is the smallest doc_id that can be reached over links, the
    row's own included; ``kept`` marks the row that bears it.  NULL and texts
    without words have an empty set and are linked with nothing.  Rows that
    share a text share a component.  A NULL doc_id never names a component that
    has another id; alone it stands for itself.
    """
    sketches = checkpointed(describe(docs, words, bands, id_col, text_col))
    roots, _ = link_nodes(docs, sketches, threshold, words, id_col, text_col)
    classes = checkpointed(sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_first")))
    grouped = classes.join(roots, "node")
    least = checkpointed(grouped.groupBy("root").agg(F.min("_first").alias("_least")))
    linked = grouped.join(least, "root").select("node", "_least")
    names = checkpointed(classes.join(linked, "node", "left").select("node", F.coalesce("_least", "_first").alias("_name")))
    out = sketches.select("doc_id", "row_key", "n_shingles", "node").join(names, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_name"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "node", "row_key")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one that bears its component's id.

    Rows repeated in id and text leave one.  Rows without words stay all.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    flags = found.where("node is not null").groupBy("row_key").agg(F.bool_or("kept").alias("_kept"), (F.count(F.lit(1)) > 1).alias("_again"))
    flags = checkpointed(flags.where("not _kept or _again"))
    key, kept, again = (free_name(docs, n) for n in ("row_key", "_kept", "_again"))
    flags = flags.select(F.col("row_key").alias(key), F.col("_kept").alias(kept), F.col("_again").alias(again))
    marked = docs.withColumn(key, row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))).join(flags, key, "left")
    once = marked.where(F.col(kept).isNull())
    repeated = marked.where(F.col(kept) & F.col(again)).dropDuplicates([key])
    return once.unionByName(repeated).drop(key, kept, again)
