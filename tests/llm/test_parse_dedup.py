import hashlib
import random

import numpy as np
import pytest

from tallyscope.llm.parse_dedup import least_in_windows, phrases, remove_repeats


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    order = lambda d: (d is not None, d or 0)
    first = {}
    for d, b in texts:
        for s in range(len(b) - length + 1):
            key, at = b[s : s + length], (order(d), s)
            first[key] = min(first.get(key, at), at)
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (order(d), s):
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "trigger", "few"), [(100, 24, 32), (20, 6, 32), (20, 6, 3), (100, 24, 0)])
def test_like_brute_force(spark, words, monkeypatch, length, trigger, few):
    monkeypatch.setattr("tallyscope.llm.parse_dedup.FEW", few)
    rng, rows = random.Random(length), []
    passages = [words(30) for _ in range(6)]
    for i in range(50):
        parts = [rng.choice([words(rng.randint(0, 40)), rng.choice(passages), rng.choice(passages)[7:120], "of of " * rng.randint(0, 40)]) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3 % 101, " é ".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "x" * (length - 1)), (505, "x" * length), (506, "x" * (2 * length + 3)), (507, "日本" * length)]
    rows += [(None, passages[0] * 2), rows[5], rows[5]]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, th int, marks int").repartition(4)
    got = sorted([tuple(r) for r in remove_repeats(docs, length, trigger).collect()], key=str)
    assert got == brute(rows, length)


@pytest.mark.parametrize("few", [32, 3])
def test_many_texts_without_an_id(spark, words, monkeypatch, few):
    """Texts of one id are told apart; a phrase at one place in many of them is repeated in all where it stands earlier."""
    monkeypatch.setattr("tallyscope.llm.parse_dedup.FEW", few)
    rng = random.Random(few)
    passages = [words(12) for _ in range(40)]
    rows = []
    for i in range(1000):
        head = rng.choice(["", passages[i % 7] + " ", passages[i % 40][rng.randint(0, 9) :] + " "])
        rows.append((None, f"{head}{i} {words(rng.randint(0, 6))} {rng.choice(passages)[rng.randint(0, 9):]}"))
    same = words(12)
    rows += [(3, same + f" {i} " + words(4)) for i in range(60)] + [(2, "x" + same[:-1]), (3, words(4) + same), (4, same[3:] + same)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([tuple(r) for r in remove_repeats(docs, 20, 6).collect()], key=str)
    assert got == brute(rows, 20)


def test_every_string_has_one_trigger_that_depends_on_it_alone():
    rng = np.random.default_rng(0)
    data = np.frombuffer(bytes(rng.integers(97, 99, 3000, np.uint8)), np.uint8)
    offsets = np.array([0, 700, 700, 790, 3000])
    text, start, count, _, wh, _ = phrases(data, offsets, 100, 24)
    covered = {}
    for t, s, n, w in zip(text, start, count, wh):
        for x in range(s, s + n):
            at = offsets[t] + x
            covered[at] = (bytes(data[at : at + 100]), w)
    want = [i for a, b in zip(offsets[:-1], offsets[1:]) for i in range(a, b - 99)]
    assert sorted(covered) == want
    by = {}
    for string, w in covered.values():
        assert by.setdefault(string, w) == w
    v = rng.integers(0, 50, 200)
    assert least_in_windows(v, 7).tolist() == [v[i : i + 7].min() for i in range(194)]


def test_chunks_of_a_long_text_agree(monkeypatch):
    import tallyscope.llm.parse_dedup as p

    data = np.frombuffer((b"the quick brown fox " * 40 + bytes(range(33, 126))) * 20, np.uint8)
    offsets = np.array([0, 5000, len(data)])
    whole = p.phrases(data, offsets, 100, 24)
    monkeypatch.setattr(p, "CHUNK", 997)
    cut = p.phrases(data, offsets, 100, 24)
    spread = lambda f: {(t, s + i): w for t, s, n, _, w, _ in zip(*f) for i in range(n)}
    assert spread(whole) == spread(cut)


def test_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a" * 30), (2, "b" + "a" * 30)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, 20, 6, with_text=True).collect()}
    assert got == {1: b"a", 2: b"b"}
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
