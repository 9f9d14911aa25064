import hashlib
import re

import pytest

from tallyscope.llm.positional import build_postings, contamination, proximity_matches, rarest_pairs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, met = split(text), set(), set()
        for item, t in items:
            v = split(t)
            size = min(window, len(v))
            if not size or item is None:
                continue
            for s in range(len(v) - size + 1):
                for x in range(len(w) - size + 1):
                    if w[x : x + size] == v[s : s + size]:
                        hit.update(range(x, x + size))
                        met.add(str(item))
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(met), digest, bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row long, pos int").repartition(5)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    return d, q


def test_like_brute_force(spark, words):
    items = [(i, words(8 + i)) for i in range(20)]
    items += [(30, words(3)), (31, words(1)), (32, None), (33, " .,"), (None, words(12)), (34, "la " * 25), (35, "Ä ä É äb Straße x_y z1"), (36, items[4][1]), items[4]]
    docs = [(i, words(40)) for i in range(40)]
    docs += [(100 + i, words(5) + " " + t + ". " + words(9)) for i, t in items if t and i is not None]
    docs += [(200, items[15][1].upper().replace(" ", " -- ")), (201, " ".join(items[15][1].split()[3:15]) + " x " + " ".join(items[16][1].split()[:9]))]
    docs += [(202, "la " * 40), (203, None), (204, ""), (205, "?!"), (206, (items[10][1] + " ") * 50), (207, words(3000) + " " + items[12][1] + " " + items[13][1])]
    docs += [(208, "ä é")] + [docs[45]] * 3 + [(None, items[11][1]), (None, items[11][1]), (None, words(9))]
    d, q = frames(spark, docs, items)
    assert sorted((tuple(r) for r in contamination(d, q).collect()), key=str) == brute(docs, items)
    assert sorted((tuple(r) for r in contamination(d, q, window=4).collect()), key=str) == brute(docs, items, 4)


def test_empty_tables(spark, words):
    d, q = frames(spark, [(1, words(20)), (2, None)], [(1, words(12))])
    assert contamination(d.where("doc_id = 7"), q).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in contamination(d, q.where("item_id = 7")).collect()} == {(1, 20, 0, 0, nothing, False), (2, 0, 0, 0, nothing, False)}


def test_thousands_of_equal_rows(spark, words):
    items = [(1, words(14)), (2, words(11))]
    docs = [(5, words(4) + " " + items[0][1])] * 3000 + [(None, items[1][1])] * 3000 + [(6, words(30))]
    d, q = frames(spark, docs, items)
    want = dict.fromkeys(brute([docs[0], docs[3000], docs[-1]], items))
    got = [tuple(r) for r in contamination(d, q).collect()]
    assert len(got) == 6001 and set(got) == set(want)


def test_lists_are_whole_and_sorted_by_term(spark, words):
    items = [(1, words(12)), (2, words(12))]
    docs = [(i, words(60)) for i in range(30)]
    d, q = frames(spark, docs, items)
    p = build_postings(d, q)
    held = {w for _, t in items for w in split(t)}
    want = sorted((w, i, n) for i, t in docs for n, w in enumerate(split(t)) if w in held)
    got = p.words.join(p.texts, "row").select("term", "id", "pos").collect()
    assert sorted(tuple(r) for r in got) == want


def test_rarest_words_open_a_window(spark):
    items = [(1, "often seldom often never2 mid often mid x y z often w")]
    docs = [(1, "often " * 50 + "mid " * 9 + "x " * 5 + "y " * 6 + "z " * 7 + "w " * 8 + "seldom never2 never2")]
    d, q = frames(spark, docs, items)
    rows = {r["s"]: (r["t1"], r["t2"]) for r in rarest_pairs(build_postings(d, q).items).collect()}
    assert rows == {0: ("seldom", "never2"), 1: ("seldom", "never2"), 2: ("never2", "x")}


@pytest.mark.parametrize("span", [3, 5, 9])
def test_proximity_like_brute_force(spark, words, span):
    items = [(1, "alpha beta gamma"), (2, "beta beta alpha"), (3, "delta"), (4, "gamma nothere")]
    docs = [(i, words(3) + " " + t) for i, t in enumerate(["gamma x beta alpha", "alpha x x x beta x x gamma", "beta alpha", "beta x x alpha delta delta", "gamma gamma alpha x beta gamma"])]
    d, q = frames(spark, docs, items)
    p = build_postings(d, q)
    freq = {w: sum(split(t).count(w) for _, t in docs) for _, t in items for w in split(t)}
    want = []
    for i, t in docs:
        w = split(t)
        for item, text in items:
            need = set(split(text))
            rare = min(need, key=lambda x: (freq[x], x))
            for at in [n for n, x in enumerate(w) if x == rare]:
                if len(need) <= span and any(need <= set(w[max(0, s) : s + span]) for s in range(at - span + 1, at + 1)):
                    want.append((i, item, at))
    assert sorted((r["id"], r["item_id"], r["pos"]) for r in proximity_matches(p, span).collect()) == sorted(want)
