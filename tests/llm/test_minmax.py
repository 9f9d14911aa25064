import random

import numpy as np
import pyarrow as pa

from tallyscope.llm.links import components
from tallyscope.llm.minmax import near_duplicates, shingle_sets, signatures, without_duplicates


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return [(d, len(s), min((x for x in ids[root(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_groups_like_brute_force(spark, words):
    rng, rows = random.Random(1), []
    for g in range(25):
        base = words(rng.choice([1, 3, 4, 5, 6, 9, 60, 150])).split(" ")
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(50)
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(copy)))
    # a chain: each is like the next, the ends are not alike
    chain = words(100).split(" ")
    for k in range(6):
        rows.append((len(rows), " ".join(chain[k * 6 : k * 6 + 64])))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "É ONE two Three"), (904, "É one TWO three"), (905, "é one two three"), (3, rows[3][1]), (None, rows[0][1]), (None, "alone with no id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, row_key int").repartition(5)
    got = near_duplicates(docs).collect()
    want = sorted(brute(rows), key=str)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None)

    left = without_duplicates(docs)
    assert left.columns == docs.columns
    kept = sorted([r.doc_id for r in left.collect()], key=str)
    assert kept == sorted({d for d, n, c in brute(rows) if d == c}, key=str)


def test_large_group_of_different_copies(spark, words):
    base = words(200).split(" ")
    rng, rows = random.Random(2), []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"w{rng.random()}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_signature_bands_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.sort(np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    keys = signatures(np.concatenate([a, b]), np.array([0, 400, 800]), bands=2000)
    share, j = (keys[0] == keys[1]).mean(), 300 / 500
    assert abs(share - j**4) < 0.03


def test_shingles_of_edge_texts():
    hashes, bounds = shingle_sets(pa.array(["a b c d e f", "A B C D E", None, "a a a a a a a a", "a b", "a b"]))
    assert np.diff(bounds).tolist() == [2, 1, 0, 1, 1, 1]
    assert hashes[bounds[4]] == hashes[bounds[5]]


def test_components_and_empty_tables(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[a] == got[b] for a, b in pairs if a != b)
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 160)} == {100}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == [] and without_duplicates(none).collect() == []
