"""Whole texts as one byte buffer: token bounds and 64-bit token hashes without a loop over tokens."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

# An odd multiplier, its inverse modulo 2^64, and the finaliser of a well-known 64-bit mixer.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> SHIFT)
    x = x * MIX1
    x = x ^ (x >> SHIFT)
    x = x * MIX2
    return x ^ (x >> SHIFT)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Tokens:
    """Runs of bytes of one class: bounds, and how many of them each text has."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    bounds: np.ndarray


def runs(classes: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Maximal runs of equal non-zero class that do not cross a text's bounds."""
    n = len(classes)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, np.zeros(len(offsets), np.int64))
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(classes[1:], classes[:-1], out=change[1:n])
    change[offsets] = True
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    keep = classes[start] != 0
    start, end = start[keep], end[keep]
    text = np.searchsorted(offsets, start, "right") - 1
    return Tokens(start, end, text, np.searchsorted(start, offsets))


class Hasher:
    """Hashes of byte ranges of one buffer, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        terms = powers(BASE, n)
        terms *= data.astype(np.uint64) + np.uint64(1)
        np.cumsum(terms, out=self.prefix[1:])
        self.inverse = powers(INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def blocks(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """Slices of a batch whose text column holds about ``limit`` bytes at most (one longer text stands alone)."""
    column_ = batch.column(column)
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(column_).to_pylist()], np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
