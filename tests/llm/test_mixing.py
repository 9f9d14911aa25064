import re
from fractions import Fraction

from pyspark.sql import functions as F

from tallyscope.llm.mixing import cyclic_weight, mix_sources, mixed_documents, shard_quotas, source_targets

SCHEMA = "doc_id long, text string, lang string, source string, size long, passes string"


def water(sizes, weights, repeats=3):
    """Targets by capping and sharing again until none is above."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(repeats * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        for i in capped:
            target[i] = repeats * sizes[i]
        for i in open_:
            target[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = [i for i in open_ if target[i] > repeats * sizes[i]]
        if not over:
            return target
        capped |= set(over)


def lague(shares, n):
    seats = [0] * len(shares)
    for _ in range(n):
        best = max(range(len(shares)), key=lambda i: (Fraction(shares[i]) / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def docs_of(spark, words):
    rows, n = [], 0
    for source, count, length in (("a", 60, 40), ("b", 3, 5), ("c", 25, 30), (None, 6, 20), ("é", 4, 200), ("B", 1, 1), ("empty", 3, 0)):
        for i in range(count):
            rows.append((n, words(length + i % 3) if length else (None if i else " \n"), "en", source, 1, "x"))
            n += 1
    rows += [rows[0], rows[0], (None, "one two", "en", "a", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_targets_quotas_and_limits(spark, words):
    docs, rows = docs_of(spark, words)
    got = mix_sources(docs, cyclic_weight()).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in sources]
    want = water(sizes, [1 + i % 3 for i in range(len(sources))])
    for s, total, target in zip(sources, sizes, want):
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {total}
        assert all(abs(r.target - target) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 3.5 * 16
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + r.run_words for r in mine)
    again = mix_sources(docs.repartition(7), cyclic_weight()).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_quotas_are_the_awards_one_by_one(spark):
    rows = [(c, v, i, 1.0, 1000, float(v)) for i, (c, v) in enumerate((("a", 500), ("b", 260), ("c", 130), ("d", 110), ("e", 0)))]
    targets = spark.createDataFrame(rows, "source string, source_size long, _rank int, weight double, _total long, target double")
    got = {(r.source, r.shard): r.upto for r in shard_quotas(targets, block=10, shards=7).collect()}
    for shard in range(7):
        n = 100 * (shard + 1) // 7
        seats = lague([Fraction(r[1], 1000) for r in rows], n)
        assert [got[r[0], shard] for r in rows] == seats


def test_source_with_no_words_at_all_and_empty_table(spark):
    sizes = spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")
    assert [r.target for r in source_targets(sizes, cyclic_weight()).collect()] == [0.0, 0.0]
    none = spark.createDataFrame([], SCHEMA)
    assert mix_sources(none, cyclic_weight()).collect() == []
    assert mixed_documents(none, cyclic_weight()).collect() == []


def test_the_mix_holds_the_words_taken(spark, words):
    docs, rows = docs_of(spark, words)
    taken = {r.source: r.n for r in mix_sources(docs, cyclic_weight()).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    mixed = mixed_documents(docs, cyclic_weight())
    assert mixed.columns == docs.columns
    out = mixed.collect()
    for s, n in taken.items():
        assert sum(len((r.text or "").split()) for r in out if r.source == s) == n
    whole = {r[1] for r in rows}
    assert sum(r.text not in whole for r in out) <= 2 * len(taken)
    assert sum(r.source == "empty" for r in out) == 3
