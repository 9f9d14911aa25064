"""Ranked lexical search over a length-stratified index.

The score of a term depends on a document through its occurrences tf and its
length normaliser m alone.  So documents of equal m form a stratum, and inside
a stratum a term's postings are kept by falling tf: the impact of a term is
computed once per (m, tf) and not once per posting.

1. One pass over whole texts counts each document's terms; the counts are
   written once.  Number and length of all documents give every m.
2. Documents are dealt by ranges of m, a large stratum over several ranges, and
   each task writes its strata in pieces of bounded size.
3. For a block of queries, the largest tf of each term bounds the score a piece
   can hold.  The pieces of highest bound are visited first; the k-th best score
   found there is a floor for all others, which are visited only where their
   bound reaches it.  A task returns its k best documents per query.

Terms are known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import fields, small_batches
from tallyscope.llm.textbytes import LETTERS, LOWER, Hasher, blocks, buffer_of, runs

PIECE_DOCS = 2048
PIECE_TERMS = 1 << 19
QUERY_TERMS = 1 << 20
PROBE_PIECES = 4
# Rows of an Arrow batch: of documents, and of pieces.
BATCH_DOCS, BATCH_PIECES = 512, 8

COUNTED = "id long, salt long, n long, terms array<long>, tfs array<int>"
PIECE = "m long, ids array<long>, terms array<long>, tfs array<int>, ends array<int>, places array<int>"
FOUND = "query int, id long, score long"


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms with repeats of each text, bounds, term hashes, occurrences): sorted by hash inside a text."""
    raw, offsets = buffer_of(texts)
    data = LOWER[raw]
    t = runs(LETTERS[data].astype(np.uint8), offsets)
    h = Hasher(data)(t.start, t.end).view(np.int64)
    order = np.lexsort((h, t.text))
    h, text = h[order], t.text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(h)))
    bounds = np.searchsorted(text[at], np.arange(len(offsets)))
    return np.diff(t.bounds), bounds, h[at], times


def counted_terms(rows: DataFrame, id_col: str, text_col: str, only: np.ndarray | None = None) -> DataFrame:
    """(id, salt, n, terms, tfs) of every row; ``salt`` tells equal rows apart.

    ``n`` counts all terms with repeats; ``only``, sorted term hashes, says which
    of them are listed.  Written, so that a row keeps its salt.
    """
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            for b in blocks(batch, 2):
                n, bounds, terms, times = term_counts(b.column(2))
                if wanted is not None:
                    kept = found_in(wanted, terms)[1]
                    bounds, terms, times = np.append(0, np.cumsum(kept))[bounds], terms[kept], times[kept]
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, kind)) for v, kind in ((terms, pa.int64()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *lists], names=["id", "salt", "n", "terms", "tfs"])

    slim = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    with small_batches(rows.sparkSession, BATCH_DOCS):
        return checkpointed(slim.mapInArrow(count, COUNTED))


def found_in(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each term in a sorted vocabulary."""
    if not len(vocabulary):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    return at, vocabulary[at] == terms


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column without NULLs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _pieces(piece_docs: int, piece_terms: int):
    """Strata of a partition that is sorted by m, cut into pieces of so many documents and postings at most."""

    def piece(m: int, ids: list, terms: list, tfs: list) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
        term, tf = np.concatenate(terms), np.concatenate(tfs)
        order = np.lexsort((place, -tf, term))
        term, tf, place = term[order], tf[order], place[order]
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
        at = np.flatnonzero(first)
        columns = [(term[at], pa.int64()), (tf[at], pa.int32()), (np.append(at[1:], len(term)), pa.int32()), (place, pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind)) for v, kind in columns]
        return pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *lists], names=["m", "ids", "terms", "tfs", "ends", "places"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids, terms, tfs, held = None, [], [], [], 0
        for b in batches:
            keys, own = b.column(0).to_numpy(), b.column(1).to_pylist()
            (t, at), (f, _) = flat(b.column(2)), flat(b.column(3))
            for i in range(b.num_rows):
                size = int(at[i + 1] - at[i])
                if ids and (keys[i] != m or len(ids) >= piece_docs or held + size > piece_terms):
                    yield piece(m, ids, terms, tfs)
                    ids, terms, tfs, held = [], [], [], 0
                m = int(keys[i])
                ids.append(own[i])
                terms.append(t[at[i] : at[i + 1]].copy())
                tfs.append(f[at[i] : at[i + 1]].copy())
                held += size
        if ids:
            yield piece(m, ids, terms, tfs)

    return build


@dataclass(frozen=True)
class Index:
    """``pieces(piece, m, ids, terms, tfs, ends, places)`` and the number of documents that hold a term.

    ``terms`` and ``tfs`` name the groups of postings of a piece, by term and falling tf; ``ends`` says where each
    ends in ``places``, which are places in ``ids``.
    """

    pieces: DataFrame
    documents: int


def asked_terms(queries: DataFrame, text_col: str = "text", most: int = QUERY_TERMS) -> np.ndarray | None:
    """The sorted hashes of all terms of ``queries``, None where there are more than ``most``."""
    counted = counted_terms(fields(queries, text_col).distinct().withColumn("_id", F.lit(0)), "_id", text_col)
    rows = counted.select(F.explode("terms").alias("term")).distinct().limit(most + 1).toPandas()
    return None if len(rows) > most else np.sort(rows["term"].to_numpy(np.int64))


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_docs: int = PIECE_DOCS, piece_terms: int = PIECE_TERMS, only: np.ndarray | None = None,
) -> Index:
    """The index of all rows of ``docs`` whose text holds a term.

    ``only`` (from ``asked_terms``) leaves out the postings of terms that no
    query will hold; lengths and normalisers are those of whole texts.

    Every row is a document of its own, repeated ones too; a NULL or empty text
    holds no term.  A document of more than ``piece_terms`` distinct terms is a
    piece of its own.  An empty table gives an empty index.  Other columns of
    ``docs`` are not looked at.
    """
    counted = counted_terms(docs, id_col, text_col, only).where("n > 0")
    row = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one empty table has no length to divide by
    m = F.expr(f"100 - 75 + (75 * n * {row[0]}L) div {max(1, row[1])}L")
    dealt = counted.where(F.size("terms") > 0).withColumn("m", m).repartitionByRange("m", "salt").sortWithinPartitions("m", "salt")
    pieces = dealt.select("m", "id", "terms", "tfs").mapInArrow(_pieces(piece_docs, piece_terms), PIECE)
    with small_batches(docs.sparkSession, BATCH_DOCS):
        return Index(checkpointed(pieces.withColumn("piece", F.monotonically_increasing_id())), row[0])


@dataclass(frozen=True)
class Asked:
    """A block of queries: ``start`` bounds each query's entries, which name places in ``vocabulary``."""

    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    vocabulary: np.ndarray
    floor: np.ndarray


class Piece:
    """A stratum, or a part of one, reduced to the terms that are asked for."""

    def __init__(self, m: int, ids: list, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray, places: np.ndarray, vocabulary: np.ndarray) -> None:
        at, kept = found_in(vocabulary, terms)
        starts = np.append(0, ends[:-1])
        self.ids, self.places, size = ids, places, (ends - starts)[kept]
        unique, back = np.unique(tfs[kept].astype(np.int64), return_inverse=True)
        self.impact = ((1_000_000_000 * unique) // (1000 * unique + 8 * m))[back]
        term, self.group_start, self.group_size = at[kept], starts[kept], size
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.first = np.full(len(vocabulary), -1, np.int64)
        self.first[term[first]] = first
        self.last = np.full(len(vocabulary), -1, np.int64)
        self.last[term[first]] = np.append(first[1:], len(term))
        self.best = np.zeros(len(vocabulary), np.int64)
        self.best[term[first]] = self.impact[first]

    def bounds(self, asked: Asked) -> np.ndarray:
        """The most that each query can score here."""
        return np.add.reduceat(asked.weight * self.best[asked.term], asked.start[:-1])

    def scores(self, asked: Asked, query: int) -> np.ndarray:
        out = np.zeros(len(self.ids), np.int64)
        for e in range(asked.start[query], asked.start[query + 1]):
            a, b = self.first[asked.term[e]], self.last[asked.term[e]]
            if a >= 0:
                size = self.group_size[a:b]
                start = self.group_start[a]
                # a term stands once in a document, so no place repeats
                out[self.places[start : start + size.sum()]] += np.repeat(asked.weight[e] * self.impact[a:b], size)
        return out


def _read(batch: pa.RecordBatch, vocabulary: np.ndarray) -> Iterator[tuple[int, Piece]]:
    """(piece number, Piece) of the rows of ``pieces``."""
    (terms, a), (tfs, _), (ends, _), (places, b) = (flat(batch.column(c)) for c in (3, 4, 5, 6))
    for i in range(batch.num_rows):
        g = slice(a[i], a[i + 1])
        yield batch.column(0)[i].as_py(), Piece(batch.column(1)[i].as_py(), batch.column(2)[i], terms[g], tfs[g], ends[g], places[b[i] : b[i + 1]], vocabulary)


COLUMNS = ("piece", "m", "ids", "terms", "tfs", "ends", "places")


class Best:
    """The k best documents of every query so far; ties go to the smaller id, NULL last."""

    def __init__(self, asked: Asked, k: int) -> None:
        self.k, self.floor, self.held = k, asked.floor.copy(), {}

    def add(self, query: int, scores: np.ndarray, ids: pa.Scalar) -> None:
        some = np.flatnonzero((scores > 0) & (scores >= self.floor[query]))
        if len(some) > self.k:
            low = np.partition(scores[some], len(some) - self.k)[len(some) - self.k]
            some = some[scores[some] >= low]
        if not len(some):
            return
        own = ids.values.take(pa.array(some)).to_pylist()
        rows = self.held.get(query, []) + [(-int(s), d is None, d or 0) for s, d in zip(scores[some], own, strict=True)]
        rows = self.held[query] = sorted(rows)[: self.k]
        if len(rows) == self.k:
            self.floor[query] = max(self.floor[query], -rows[-1][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        out = [(q, None if none else d, -s) for q, rows in self.held.items() for s, none, d in rows]
        if out:
            q, d, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["query", "id", "score"])


def _frequencies(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, p in _read(batch, vocabulary):
                held = np.flatnonzero(p.first >= 0)
                upto = np.append(0, np.cumsum(p.group_size))
                total[held] += upto[p.last[held]] - upto[p.first[held]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[at], pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    return run


def _bounds(sent, probe: int):
    """Each query's pieces of highest bound in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        n = len(asked.start) - 1
        numbers, bounds = np.zeros((0, n), np.int64), np.zeros((0, n), np.int64)
        for batch in batches:
            own = [(number, p.bounds(asked)) for number, p in _read(batch, asked.vocabulary)]
            if own:
                numbers = np.concatenate([numbers, np.repeat(np.array([x[0] for x in own])[:, None], n, 1)])
                bounds = np.concatenate([bounds, np.stack([x[1] for x in own])])
                top = np.argsort(-bounds, axis=0, kind="stable")[:probe]
                numbers, bounds = np.take_along_axis(numbers, top, 0), np.take_along_axis(bounds, top, 0)
        q = np.tile(np.arange(n, dtype=np.int32), len(numbers))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(numbers.ravel(), pa.int64()), pa.array(bounds.ravel(), pa.int64())], names=["query", "piece", "bound"])

    return run


def _visit(sent, k: int, visits=None):
    """Pieces in the order of their highest bound, each for the queries whose floor it can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = Best(asked, k)
        for batch in batches:
            own = [(p, p.bounds(asked)) for _, p in _read(batch, asked.vocabulary)]
            for p, bound in sorted(own, key=lambda x: -x[1].max(initial=0)):
                reached = np.flatnonzero((bound > 0) & (bound >= best.floor))
                if visits is not None:
                    visits.add(len(reached))
                for query in reached:
                    best.add(query, p.scores(asked, query), p.ids)
        yield from best.rows()

    return run


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", query_terms: int = QUERY_TERMS, probe_pieces: int = PROBE_PIECES, visits=None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every query with a score above 0, all if fewer.

    Equal scores go by ascending id, NULL ids last; repeated documents rank one
    behind the other.  Queries repeated in id and text are asked once; an id with
    several texts is asked once for each, with ranks of their own.  A query
    without terms finds nothing.  Queries are taken in blocks of about
    ``query_terms`` distinct terms, which the driver holds and sends out: one block's
    passes over the index follow those of the block before.  Scores are 64-bit
    integers.  ``visits``, an accumulator, counts pieces scored per query.
    """
    spark = index.pieces.sparkSession
    asked = counted_terms(fields(queries, id_col, text_col).distinct(), id_col, text_col).where("n > 0")
    groups = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // query_terms))
    out = None
    with small_batches(spark, BATCH_PIECES):
        for g in range(groups):
            rows = asked.where(F.pmod("salt", F.lit(groups)) == g).orderBy("salt").collect()
            part = checkpointed(_search_block(index, rows, k, probe_pieces, visits)) if rows else None
            out = part if out is None else out if part is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, rank int, doc_id long, score long")
    return out.withColumnRenamed("query_id", id_col)


def _search_block(index: Index, rows: list, k: int, probe_pieces: int, visits) -> DataFrame:
    """The answers to one block of queries, rows (id, terms, tfs)."""
    spark = index.pieces.sparkSession
    pieces = index.pieces.select(*COLUMNS)
    terms, times = (np.concatenate([np.array(r[c], np.int64) for r in rows]) for c in ("terms", "tfs"))
    vocabulary, term = np.unique(terms, return_inverse=True)
    df = pieces.mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    found = df.select("term", weight.alias("w")).toPandas()
    weights = np.zeros(len(vocabulary), np.int64)
    weights[np.searchsorted(vocabulary, found["term"].to_numpy(np.int64))] = found["w"].to_numpy(np.int64)
    start = np.append(0, np.cumsum([len(r["terms"]) for r in rows]))
    block = Asked(start, term, times * weights[term], vocabulary, np.zeros(len(rows), np.int64))

    sent = spark.sparkContext.broadcast(block)
    top = Window.partitionBy("query").orderBy(F.col("bound").desc(), "piece")
    first = pieces.mapInArrow(_bounds(sent, probe_pieces), "query int, piece long, bound long").withColumn("_i", F.row_number().over(top)).where(F.col("_i") <= probe_pieces)
    probed = pieces.join(first.select("piece").distinct(), "piece", "left_semi").select(*COLUMNS).mapInArrow(_visit(sent, k), FOUND)
    down = Window.partitionBy("query").orderBy(F.col("score").desc())
    floors = probed.withColumn("_i", F.row_number().over(down)).where(F.col("_i") == k).select("query", "score").toPandas()
    block.floor[floors["query"].to_numpy(np.int64)] = floors["score"].to_numpy(np.int64)

    sent = spark.sparkContext.broadcast(block)
    names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], "query int, query_id long")
    ranks = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = pieces.mapInArrow(_visit(sent, k, visits), FOUND).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return best.join(names, "query").select("query_id", "rank", F.col("id").alias("doc_id"), "score")
