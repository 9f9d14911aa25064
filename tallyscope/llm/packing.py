"""Hierarchical packing of token streams into several context sizes.

Documents are routed to tiers of context sizes (powers of two).  A document
fills as many windows of the longest tier as it can; what remains goes to the
smallest tier that holds it, one window for each such remainder.  The gaps
behind the remainders are filled from shorter tiers, longest windows first: the
shortest remainders, just as many as the gaps need, give up their own windows
and are cut to measure.  What they have left makes full windows of its own.

Packing is local: a task packs its documents in groups of a bounded number of
tokens, so nothing is shuffled, no key can be hot, and a lost task is repeated
with the same outcome.  Each group ends with less than one padded window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyscope.llm.common import fields
from tallyscope.llm.textbytes import BLANKS, LETTERS, LOWER, Hasher, blocks, buffer_of, runs

TIERS = (256, 512, 1024, 2048)
GROUP_TOKENS = 1_000_000
STEP_TOKENS = 131_072
KNOWN_WORDS = 600_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids array<int>"
)
# The bytes of texts whose pre-tokens are plain runs: printable ASCII but the apostrophe (contractions),
# the blanks, and after 0xC3 the letters of Latin-1.  Any other text goes through the tokenizer as a whole.
PLAIN = np.zeros(256, bool)
PLAIN[[9, 10, 13, *range(32, 39), *range(40, 127), 0xC3]] = True
PLAIN_PAIR = np.zeros(256, bool)
PLAIN_PAIR[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True


class WordTokens:
    """Token ids of texts, looked up word by word.

    In this vocabulary a text's ids are those of its pre-tokens one after the
    other, and the last id of each pre-token marks its end.  Pre-tokens are
    found and hashed over a buffer of many texts at once; new ones are encoded
    together, known ones are looked up by a 64-bit hash in an open table.  Texts
    that hold the name of a special token go through the tokenizer as a whole;
    the name is that token there, or with ``special_as_text`` ordinary text.
    """

    def __init__(self, path: str, known: int = KNOWN_WORDS, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = known
        self._clear()

    def _clear(self) -> None:
        self.mask = (1 << max(12, (2 * self.known).bit_length())) - 1
        self.key, self.row = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        self.first, self.size = np.zeros(self.known, np.int64), np.zeros(self.known, np.int32)
        self.flat, self.used, self.count = np.zeros(8 * self.known, np.uint32), 0, 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of known hashes, -1 for others."""
        out, open_ = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(open_):
            row = self.row[slot]
            met = self.key[slot] == hashes[open_]
            out[open_[met & (row >= 0)]] = row[met & (row >= 0)]
            on = ~met & (row >= 0)
            open_, slot = open_[on], (slot[on] + 1) & self.mask
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds distinct new words; the caller leaves room for them."""
        ids = self._whole(" ".join(words))
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(words):
            sizes = np.diff(last, prepend=-1)
        else:
            each = [self._whole(w) for w in words]
            ids, sizes = np.concatenate(each), np.array([len(e) for e in each])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        rows = np.arange(self.count, self.count + len(words))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[rows], self.first[rows] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.count += len(words)
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(rows):
            free = self.row[slot] < 0
            self.row[slot[free]] = rows[free]
            won = self.row[slot] == rows
            self.key[slot[won]] = hashes[won]
            rows, hashes, slot = rows[~won], hashes[~won], (slot[~won] + 1) & self.mask

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of a string column; NULL is empty."""
        raw, offsets = buffer_of(texts)
        before = np.concatenate([[0], raw[:-1]]).astype(np.uint8)
        after_mark = (before == 0xC3) & PLAIN_PAIR[raw]
        odd = np.concatenate([[0], np.cumsum(~(PLAIN[raw] | after_mark))])
        slow = odd[offsets[1:]] > odd[offsets[:-1]]
        for name in self.special:
            slow |= pc.match_substring(texts, name).fill_null(False).to_numpy(zero_copy_only=False)
        data = LOWER[raw] + 32 * (after_mark & (raw < 0x9F)).astype(np.uint8)
        kinds = np.where(BLANKS[data], 0, np.where(LETTERS[data], 1, 2)).astype(np.uint8)
        digit = np.flatnonzero((data >= 48) & (data < 58))
        kinds[digit] = 3 + digit % 2
        kinds[np.repeat(slow, np.diff(offsets))] = 0
        t = runs(kinds, offsets)
        hashes = Hasher(data)(t.start, t.end)
        row = self._find(hashes)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            if self.count + len(fresh) > self.known:
                self._clear()
                fresh, at = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
                if len(fresh) > self.known:
                    self.known = 2 * len(fresh)
                    self._clear()
            at = new[at]
            view = data.tobytes()
            self._learn(fresh, [view[a:b].decode() for a, b in zip(t.start[at].tolist(), t.end[at].tolist(), strict=True)])
            row[new] = self._find(hashes[new])
        sizes = self.size[row].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.first[row] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[t.bounds]
        if not slow.any():
            return ids, bounds
        values = texts.to_pylist()
        parts = [self._whole(values[i]) if slow[i] else ids[bounds[i] : bounds[i + 1]] for i in range(len(values))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_CODERS: dict[str, WordTokens] = {}


def coder(path: str) -> WordTokens:
    """The coder of this worker process; what it has learned serves the worker's next tasks too."""
    if path not in _CODERS:
        _CODERS[path] = WordTokens(path)
    return _CODERS[path]


def plan_group(tokens: np.ndarray, tiers: Sequence[int] = TIERS) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) and the tier of each sequence.

    ``tokens`` are the lengths of the documents, at least 1.  Every token lies
    in one piece, pieces fill a sequence from 0 without gaps, and every sequence
    but possibly the last one is as long as a tier.
    """
    tiers = np.array(sorted(tiers))
    longest = int(tiers[-1])
    doc = np.arange(len(tokens))
    whole, rest = np.divmod(tokens, longest)
    p_doc = np.repeat(doc, whole)
    nth = np.arange(len(p_doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    n = len(p_doc)
    pieces = [(p_doc, nth * longest, np.full(n, longest), np.arange(n), np.zeros(n, np.int64))]
    sequence_tiers = [np.full(n, longest)]

    have = np.flatnonzero(rest)
    have = have[np.argsort(rest[have], kind="stable")]
    size, begin = rest[have], whole[have] * longest
    home = tiers[np.searchsorted(tiers, size)]
    gap = home - size
    given = np.concatenate([[0], np.cumsum(size)])
    wanted = np.concatenate([np.cumsum(gap[::-1])[::-1], [0]])
    cut = int(np.argmax(given >= wanted))
    own = np.argsort(-home[cut:], kind="stable") + cut
    k = len(own)
    pieces.append((have[own], begin[own], size[own], n + np.arange(k), np.zeros(k, np.int64)))
    sequence_tiers.append(home[own])

    fill = np.arange(cut)[::-1]
    total = int(size[fill].sum())
    over = total - int(gap[own].sum())
    bins = [gap[own], np.full(over // longest, longest)]
    base = [size[own], np.zeros(over // longest, np.int64)]
    left = over % longest
    for t in tiers[::-1]:
        if left >= t:
            bins.append(np.array([t]))
            base.append(np.zeros(1, np.int64))
            left -= int(t)
    if left:
        bins.append(np.array([left]))
        base.append(np.zeros(1, np.int64))
    bins, base = np.concatenate(bins).astype(np.int64), np.concatenate(base)
    sequence_tiers.append(tiers[np.searchsorted(tiers, bins[k:])])
    if total:
        f_end, b_end = np.cumsum(size[fill]), np.cumsum(bins)
        ends = np.union1d(f_end, b_end[(b_end > 0) & (b_end <= total)])
        starts = np.concatenate([[0], ends[:-1]])
        f, b = np.searchsorted(f_end, starts, "right"), np.searchsorted(b_end, starts, "right")
        pieces.append((
            have[fill][f], begin[fill][f] + starts - (f_end - size[fill])[f], ends - starts, n + b,
            base[b] + starts - (b_end - bins)[b],
        ))
    d, s, length, q, o = (np.concatenate([p[i] for p in pieces]).astype(np.int64) for i in range(5))
    return d, s, length, q, o, np.concatenate(sequence_tiers).astype(np.int64)


def step_groups(tiers: np.ndarray, step_tokens: int = STEP_TOKENS) -> np.ndarray:
    """Deals sequences to training steps: to and fro from the longest tier down, so steps hold like mixtures."""
    groups = max(1, round(int(tiers.sum()) / step_tokens))
    order = np.argsort(-tiers, kind="stable")
    turn = np.arange(len(tiers))
    lap, at = np.divmod(turn, groups)
    out = np.empty(len(tiers), np.int64)
    out[order] = np.where(lap % 2 == 0, at, groups - 1 - at)
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: Sequence[int] = TIERS, group_tokens: int = GROUP_TOKENS,
    step_tokens: int = STEP_TOKENS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group and ids.

    ``start`` counts the document's ids before the piece, ``offset`` the place
    in the sequence.  A sequence shorter than its ``tier`` is to be padded.
    ``step_group`` names the training step within the packing group.  A NULL
    text is an empty one, which is its end id alone.  Repeated rows are packed
    once each.  ``sequence_id`` carries the input partition, so reruns over the
    same partitions agree.
    """
    tiers = tuple(tiers)

    def emit(keys: list[pa.Array], lens: list[np.ndarray], stream: list[np.ndarray], first: int, base: int):
        tokens, flat, names_ = np.concatenate(lens), np.concatenate(stream), pa.concat_arrays(keys)
        at = np.cumsum(tokens) - tokens
        doc, start, length, sequence, offset, kind = plan_group(tokens, tiers)
        group = step_groups(kind, step_tokens)
        lo = at[doc] + start
        view = memoryview(flat.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
        columns = [
            names_.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc]),
            pa.array(base + first + sequence), pa.array(offset), pa.array(kind[sequence].astype(np.int32)), pa.array(base + first + group[sequence]),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        if with_ids:
            ends = np.cumsum(length)
            source = np.repeat(lo - (ends - length), length) + np.arange(ends[-1])
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat[source].astype(np.int32))))
            names.append("ids")
        return len(kind), pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, first = coder(tokenizer_path), TaskContext.get().partitionId() << 33, 0
        keys, lens, stream, held = [], [], [], 0
        for batch in batches:
            for part in blocks(batch, 1, 1 << 20):
                found, bounds = words.encode(part.column(1))
                sizes = np.diff(bounds) + 1
                closed = np.full(len(found) + part.num_rows, end_id, np.uint32)
                closed[np.arange(len(found)) + np.repeat(np.arange(part.num_rows), sizes - 1)] = found
                keys.append(part.column(0).cast(pa.int64()))
                lens.append(sizes)
                stream.append(closed)
                held += len(closed)
                if held >= group_tokens:
                    count, out = emit(keys, lens, stream, first, base)
                    first += count
                    keys, lens, stream, held = [], [], [], 0
                    yield out
        if lens:
            yield emit(keys, lens, stream, first, base)[1]

    schema = SCHEMA if with_ids else SCHEMA.removesuffix(", ids array<int>")
    return fields(docs, id_col, text_col).mapInArrow(run, schema)


