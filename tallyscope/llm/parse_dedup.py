"""Repeated byte strings by prefix-free parsing.

A rolling hash of ``TRIGGER`` bytes marks trigger places: in every string of
``LENGTH`` bytes the place with the least hash (the first of equals) is its
trigger, so every string has one, and equal strings have it at the same offset.
Consecutive strings with one trigger form a phrase: the bytes from the first
one's start to the last one's end.  Each document is thus parsed into phrases
that overlap by less than ``LENGTH`` bytes, and no string lies across two.

* Dictionary: the distinct phrases with their first place in the corpus.  A
  trigger that occurs once cannot be part of a repeated string, so phrases with
  such triggers are left out before anything else.
* Parse: the places of the phrases.  A phrase that has stood before repeats all
  of its strings, whatever follows.
* Strings of different phrases can be equal only if the phrases share their
  trigger.  Only such phrases are opened.  Few phrases with one trigger are laid
  over each other at it, in corpus order: how far they agree to the left and to
  the right says which strings they share.  For triggers of more phrases than
  ``FEW`` the strings of ``LENGTH`` bytes are grouped by fingerprint, in place of
  suffix arrays; in each group all but those at the first place are repeats.  That way a hot trigger is spread over tasks by string.

Dictionary and parse are far smaller than the text where text repeats much:
copies cost one row a phrase, however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.textbytes import BASE, Hasher, blocks, buffer_of, mixed

LENGTH = 100
TRIGGER = 24
FEW = 32
CHUNK = 1 << 20
PLACE = np.uint64((1 << 24) - 1)
NO_ID = -(1 << 63)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
    """(text, start, count, ahead, trigger hash, phrase hash): strings start .. start + count - 1 of a text form one phrase.

    ``start`` counts within the text, the trigger is ``ahead`` bytes after it.
    """
    out = []
    for low in range(0, max(len(data), 1), CHUNK):
        part = data[low : low + CHUNK + length - 1]
        starts = min(CHUNK, len(part) - length + 1)
        if starts <= 0:
            continue
        hashes = Hasher(part)
        at = np.arange(len(part) - trigger + 1)
        rolled = hashes(at, at + trigger)
        least = least_in_windows((rolled & ~PLACE) | at.astype(np.uint64), length - trigger + 1)[:starts]
        place = (least & PLACE).astype(np.int64)
        bounds = np.clip(offsets - low, 0, len(part))
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))[:starts]
        end = bounds[text + 1]
        begin = np.arange(starts)
        whole = begin + length <= end
        change = np.empty(starts, bool)
        change[0] = True
        change[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
        a = np.flatnonzero(change)
        b = np.append(a[1:], starts) - 1
        keep = whole[a]
        a, b = a[keep], b[keep]
        p = place[a]
        key = hashes(a, b + length) * BASE + ((p - a) * 256 + (b - a)).astype(np.uint64)
        out.append((text[a], a + low - offsets[text[a]], b - a + 1, p - a, rolled[p], mixed(key)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(6))


def packed(start: np.ndarray, ahead: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Start, trigger place and count in one number that sorts by start (texts up to 2 GB)."""
    return (start << 32) | (ahead << 24) | (count << 16)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(dk, th, text): id with a number for NULL, the text's hash, and the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("dk"), F.xxhash64(text).alias("th"), text.alias("text"))


def _parsed(rows: DataFrame, length: int, trigger: int) -> DataFrame:
    """(wh, ctx, dk, th, pack) of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2, CHUNK):
                raw, offsets = buffer_of(part.column(2))
                text, start, count, ahead, wh, ctx = phrases(raw, offsets, length, trigger)
                dk = part.column(0).to_numpy(zero_copy_only=False)[text]
                th = part.column(1).to_numpy(zero_copy_only=False)[text]
                pack = packed(start, ahead, count)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (wh.view(np.int64), ctx.view(np.int64), dk, th, pack)], ["wh", "ctx", "dk", "th", "pack"])

    return rows.mapInArrow(run, "wh long, ctx long, dk long, th long, pack long")


def _triggers(rows: DataFrame, length: int, trigger: int) -> DataFrame:
    """(wh, n): trigger hashes with their number in a block of texts, 2 for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0, CHUNK):
                raw, offsets = buffer_of(part.column(0))
                wh, n = np.unique(phrases(raw, offsets, length, trigger)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(wh.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["wh", "n"])

    return rows.select("text").mapInArrow(run, "wh long, n int")


def _opened(rows: DataFrame, length: int) -> DataFrame:
    """(key, dk, th, pack, phrase) of the phrases listed in ``opened``.

    A phrase whose trigger few share comes as it is, under its trigger hash;
    any other as its strings, each under its own hash and without bytes.
    """
    names = ["key", "dk", "th", "pack", "phrase"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2, CHUNK):
                raw, offsets = buffer_of(part.column(2))
                lists = part.column(3)
                entry = lists.flatten()
                text = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                pack, wh, few = (entry.field(n).to_numpy(zero_copy_only=False) for n in ("pack", "wh", "few"))
                dk, th = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                start, count = pack >> 32, (pack >> 16) & 255
                low = offsets[text] + start
                size = count + length - 1
                f = np.flatnonzero(few)
                ends = np.cumsum(size[f])
                source = np.repeat(low[f] - (ends - size[f]), size[f]) + np.arange(ends[-1] if len(f) else 0)
                bytes_ = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(raw[source].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(wh[f]), pa.array(dk[text[f]]), pa.array(th[text[f]]), pa.array(pack[f]), bytes_], names)
                m = np.flatnonzero(~few)
                ends = np.cumsum(count[m])
                at = np.repeat(start[m] - (ends - count[m]), count[m]) + np.arange(ends[-1] if len(m) else 0)
                text = np.repeat(text[m], count[m])
                key = Hasher(raw)(offsets[text] + at, offsets[text] + at + length)
                pack = packed(at, 0 * at, 0 * at + 1)
                for i in range(0, len(key), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    columns = [pa.array(key.view(np.int64)[j]), pa.array(dk[text[j]]), pa.array(th[text[j]]), pa.array(pack[j])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], names)

    return rows.mapInArrow(run, "key long, dk long, th long, pack long, phrase binary")


def overlaid(key: np.ndarray, dk: np.ndarray, th: np.ndarray, pack: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(dk, th, pack) of strings that an earlier phrase of the same key has at the same distance from the trigger.

    Rows stand in order of key, id and place of the trigger.
    """
    start, ahead, count = pack >> 32, (pack >> 24) & 255, (pack >> 16) & 255
    n, room = len(key), np.diff(bounds)
    data = np.append(data, np.uint8(0))
    reach = np.arange(length)
    left = data[np.clip(bounds[:-1, None] + ahead[:, None] - 1 - reach, 0, len(data) - 1)]
    right = data[np.clip(bounds[:-1, None] + ahead[:, None] + reach, 0, len(data) - 1)]
    agree = lambda m, x, y: np.where((e := m[x] == m[y]).all(1), length, (~e).argmax(1))
    out_dk, out_th, out_pack = ([np.zeros(0, np.int64)] for _ in range(3))
    lag = 1
    while lag < n:
        x = np.flatnonzero(key[lag:] == key[:-lag]) + lag
        if not len(x):
            break
        for part in np.array_split(x, max(1, len(x) // 20_000)):
            y = part - lag
            before = (dk[y] != dk[part]) | (start[y] + ahead[y] != start[part] + ahead[part])
            back = np.minimum(agree(left, part, y), np.minimum(ahead[part], ahead[y]))
            on = np.minimum(agree(right, part, y), np.minimum(room[part] - ahead[part], room[y] - ahead[y]))
            most = np.minimum(back, np.minimum(ahead[part], ahead[y]))
            least = np.maximum(length - on, np.maximum(ahead[part] - count[part], ahead[y] - count[y]) + 1)
            some = before & (most >= least)
            i = part[some]
            out_dk.append(dk[i])
            out_th.append(th[i])
            out_pack.append(packed(start[i] + ahead[i] - most[some], 0 * i, most[some] - least[some] + 1))
        lag += 1
    return np.concatenate(out_dk), np.concatenate(out_th), np.concatenate(out_pack)


def _overlaid(rows: DataFrame, length: int) -> DataFrame:
    """(dk, th, pack) of repeated strings among phrases that share a trigger with few others."""

    def found(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key, dk, th, pack = (t.column(i).to_numpy() for i in range(4))
        phrase = t.column(4).combine_chunks() if isinstance(t.column(4), pa.ChunkedArray) else t.column(4)
        phrase = phrase.cast(pa.large_binary())
        _, offsets, data = phrase.buffers()
        at = np.frombuffer(offsets, np.int64)[phrase.offset : phrase.offset + len(phrase) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in overlaid(key, dk, th, pack, raw, at - at[0], length)], ["dk", "th", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            keys = t.column(0).to_numpy()
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            held = t.slice(last)
            if last:
                yield found(t.slice(0, last))
        if held is not None:
            yield found(held)

    place = F.shiftright("pack", 32) + F.shiftright("pack", 24).bitwiseAND(255)
    return rows.repartition("key").sortWithinPartitions("key", "dk", place, "pack", "th").mapInArrow(run, "dk long, th long, pack long")


def repeated_starts(texts: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(dk, th, pack): runs of starts whose strings also start earlier in ``texts(dk, th, text)``.

    Texts that share an id may have one phrase at one place.  None of them is
    earlier than the others, so each is opened where the first is.
    """
    start = lambda c: F.shiftright(c, 32)
    later = lambda: (F.col("dk") > F.col("first.dk")) | ((F.col("dk") == F.col("first.dk")) & (start("pack") > start("first.pack")))
    often = checkpointed(_triggers(texts, length, trigger).groupBy("wh").agg(F.sum("n").alias("n")).where("n > 1").select("wh"))
    parse = checkpointed(_parsed(texts, length, trigger).join(often, "wh"))
    dictionary = checkpointed(parse.groupBy("ctx").agg(F.first("wh").alias("wh"), F.min(F.struct("dk", "pack", "th")).alias("first")))
    placed = parse.select("ctx", "dk", "th", "pack").join(dictionary.select("ctx", "wh", "first"), "ctx")
    copies = placed.where(later()).select("dk", "th", "pack")
    heads = dictionary.select("wh", "first.*", F.lit(1).alias("own"))
    if not parse.groupBy("dk").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").isEmpty():
        ties = placed.where(~later() & (F.col("th") != F.col("first.th"))).select("wh", "dk", "pack", "th", F.lit(0).alias("own")).distinct()
        heads = checkpointed(heads.unionByName(ties))
    shared = heads.groupBy("wh").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("m")).where("m > 1")
    shared = checkpointed(shared.select("wh", (F.col("n") <= FEW).alias("few")))
    entry = F.struct("pack", "wh", "few")
    opened = heads.join(shared, "wh").groupBy("dk", "th").agg(F.collect_list(entry).alias("opened"))
    rows = checkpointed(_opened(texts.join(checkpointed(opened).hint("shuffle_hash"), ["dk", "th"]).select("dk", "th", "text", "opened"), length))
    strings = rows.where("phrase is null").select("key", "dk", "th", "pack")
    firsts = checkpointed(strings.groupBy("key").agg(F.min(F.struct("dk", "pack")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"))
    spread = strings.join(firsts, "key").where(later()).select("dk", "th", "pack")
    return copies.unionByName(_overlaid(rows.where("phrase is not null"), length)).unionByName(spread)


def remove_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes of strings that also start earlier.

    (doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` bytes if asked
    for) per row.  A byte goes if any ``length``-byte string that covers it also
    starts in a document with a smaller id, or earlier in the same document, of
    the input as it is.  NULL text is empty.  NULL ids come first.  Rows that
    share an id count as one place: equal starts in them are not earlier than
    one another.
    """
    texts = keyed(docs, id_col, text_col)
    marks = repeated_starts(texts, length, trigger)
    marks = checkpointed(marks.groupBy("dk", "th").agg(F.collect_list("pack").alias("marks")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, CHUNK):
                raw, offsets = buffer_of(part.column(1))
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                pack = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                cover = np.zeros(len(raw) + 1, np.int64)
                low = offsets[:-1][np.repeat(np.arange(part.num_rows), np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0))] + (pack >> 32)
                np.add.at(cover, low, 1)
                np.add.at(cover, low + ((pack >> 16) & 255) + length - 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                view, rows = raw, []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    g = gone[a:b]
                    removed = int(g.sum())
                    spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
                    kept = (view[a:b][~g] if removed else view[a:b]).tobytes()
                    rows.append((b - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                ids = part.column(0).to_pylist()
                columns = [pa.array([None if i == NO_ID else i for i in ids], pa.int64()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([r[4] for r in rows], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = texts.join(marks.hint("shuffle_hash"), ["dk", "th"], "left").select("dk", "text", "marks")
    return joined.mapInArrow(run, schema)
