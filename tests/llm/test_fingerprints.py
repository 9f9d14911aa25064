import hashlib

from pyspark.sql import functions as F

from tallyscope.llm.fingerprints import containment, distinct_shingles, edited_fingerprints, merge_by, merged, resemblance, with_sketch


def grams(t):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_likeness_like_brute_force(spark, words):
    rows = [(i * 7 % 50, words(12 + i)) for i in range(40)] + [(60, None), (61, ""), (62, "日本語テキスト é"), (63, "abc"), (64, words(3)), (None, "no id here"), (70, words(40)), (70, words(41))]
    rows += [rows[4], rows[4], (1000, words(400)), (1001, words(900))]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, k int, n_chars int").repartition(3)
    got = edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = {}
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct().orderBy("doc_id", F.xxhash64("t")).collect():
        order[r.doc_id, r.t] = None
    order = list(order)
    following = dict(zip(order, order[1:] + order[:1]))
    want = {}
    for (d, t), (_, nxt) in following.items():
        q = len(t) // 4
        want[d, t] = (t[: len(t) - q] + nxt[:q], nxt)
    seen = {}
    for r in got:
        t = next(t for (d, t), (e, _) in want.items() if d == r.doc_id and hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256 and len(t) == r.n_chars)
        edited, nxt = want[r.doc_id, t]
        if max(map(len, (grams(t), grams(edited), grams(nxt)))) * 2 <= 64:
            assert abs(r.near_edited - likeness(grams(t), grams(edited))) < 1e-9
            assert abs(r.near_next - likeness(grams(t), grams(nxt))) < 1e-9
        else:
            assert abs(r.near_edited - likeness(grams(t), grams(edited))) < 0.25
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == 16 * min(64, len(grams(t)))


def test_sketches_merge_and_estimate(spark, words):
    texts = [words(2000), words(2000)]
    df = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (1, texts[1])], "g int, t string")
    s = with_sketch(df, F.col("t"), "s", k=256)
    a, b = (r.s for r in s.orderBy("g").limit(2).collect())
    one = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    both = merged(F.col("a"), F.col("b"), 256)
    row = one.select(both.alias("m"), distinct_shingles(both, 256).alias("n"), resemblance(F.col("a"), F.col("b"), 256).alias("r"), containment(F.col("a"), both, 256).alias("c")).first()
    n = len(grams(texts[0]) | grams(texts[1]))
    assert abs(row.n - n) < 0.25 * n and row.r < 0.05 and row.c > 0.85
    assert {tuple(r.s) for r in merge_by(s, [], "s", 256).collect()} == {tuple(row.m)}
    by = {r.g: r.s for r in merge_by(s, ["g"], "s", 256).collect()}
    assert by == {0: a, 1: b}


def test_one_document_and_none(spark):
    one = edited_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
