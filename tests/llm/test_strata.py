import math
import re
from collections import Counter

from tallyscope.llm.strata import asked_terms, build_index, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def corpus(words):
    docs = [(i, words(3 + i * 7 % 90)) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(40)] + [docs[9]] * 3
    docs += [(300, None), (301, ""), (302, " .,;\n"), (303, words(4000)), (304, "Straße ÄB äb ÄB x1"), (305, "a-b A_B 1.2"), (None, docs[3][1]), (None, docs[3][1])]
    return docs


def test_like_brute_force(spark, words):
    docs = corpus(words)
    items = [(i, words(12)) for i in range(15)] + [(90, docs[7][1]), (91, docs[3][1]), (92, "straße äb a b"), (93, None), (94, "zzzz zzzz"), (95, "a a a b")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, m long, salt int").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in [*items, items[0]]], "item_id long, text string, ids string")
    index = build_index(df, piece_docs=16, piece_terms=2000)
    want = ordered(brute(docs, items, 10))
    assert ordered(search(index, asked).collect()) == want
    # so does an index of the asked terms alone
    assert asked_terms(asked, most=5) is None
    slim = build_index(df, piece_docs=16, only=asked_terms(asked))
    assert slim.documents == index.documents and ordered(search(slim, asked).collect()) == want
    # small blocks of queries give the same rows
    assert ordered(search(index, asked, query_terms=60, probe_pieces=1).collect()) == want


def test_strata_hold_one_normaliser_and_falling_tf(spark, words):
    index = build_index(spark.createDataFrame(corpus(words), "doc_id long, text string"), piece_docs=16)
    rows = index.pieces.collect()
    assert sum(len(r["ids"]) for r in rows) == index.documents == 150 + 40 + 3 + 5
    for r in rows:
        assert len(r["ids"]) <= 16
        groups = list(zip(r["terms"], [-f for f in r["tfs"]], strict=True))
        assert groups == sorted(set(groups)) and r["ends"][-1] == len(r["places"])


def test_bounds_spare_visits(spark, words):
    """Strata whose bound stays below the floor are not scored, and the rows are those of a full visit."""
    short = [(i, words(30)) for i in range(400)]
    docs = short + [(1000 + i, "needle thread button " * 3) for i in range(12)] + [(2000 + i, words(600)) for i in range(60)]
    items = [(0, "needle thread button needle")]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), piece_docs=20)
    visits = spark.sparkContext.accumulator(0)
    got = search(index, spark.createDataFrame(items, "item_id long, text string"), visits=visits)
    assert ordered(got.collect()) == ordered(brute(docs, items, 10))
    assert 0 < visits.value < index.pieces.count() / 4


def test_empty_tables(spark, words):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search(build_index(none), asked).collect() == []
    assert search(build_index(spark.createDataFrame(corpus(words), "doc_id long, text string")), asked.where("item_id = 2")).collect() == []
    assert search(build_index(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")), asked).collect() == []


def test_thousands_of_equal_rows(spark, words):
    docs = [(1, "one two three")] * 5000 + [(None, "two two")] * 5000 + [(i, words(20)) for i in range(2, 60)]
    items = [(0, "one two"), (1, words(8))]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), piece_docs=500)
    assert index.pieces.count() >= 20
    assert ordered(search(index, spark.createDataFrame(items, "item_id long, text string")).collect()) == ordered(brute(docs, items, 10))
