import corpus_pipeline as p
from test_minmax import brute
from test_mixing import water
from tallyscope.functions.session import checkpointed
from tallyscope.llm.toxicity import learn, score_texts
from tallyscope.llm.common import fold
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    machine = learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    fine = {r.doc_id for r in score_texts(docs, machine).collect() if r.score < 0.5}
    a = checkpointed(p.toxicity(spark, docs, SF))
    assert a.columns == columns and {r.doc_id for r in a.collect()} == fine

    rows = [(r.doc_id, r.text) for r in a.collect()]
    b = checkpointed(p.near_duplicates(spark, a, SF))
    assert b.columns == columns and sorted(r.doc_id for r in b.collect()) == sorted(d for d, _, c in brute(rows) if d == c)

    c = checkpointed(p.personal_data(spark, b, SF))
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (b, c))
    assert c.columns == columns and before.keys() == after.keys()
    import re

    private = re.compile(r"[a-z.0-9]+@mail\d\.example\.com|\d+\.\d+\.\d+\.\d+|\+1 \(\d{3}\) 555-\d{4}|\b4\d{15}\b|AKIA[A-Z0-9]{16}")
    for d, t in before.items():
        for m in private.findall(t):
            assert m not in after[d]
        if not re.search(r"[0-9@]", t):
            assert after[d] == t

    e = checkpointed(p.source_mix(spark, c, SF))
    sizes = {}
    for r in c.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    sources = sorted(sizes)
    target = water([sizes[s] for s in sources], [1 + i % 3 for i in range(len(sources))])
    assert e.columns == columns
    for s, t in zip(sources, target):
        assert abs(sum(len(r.text.split()) for r in e.where(F.col("source") == s).collect()) - t) <= 3.5 * 16 + 1

    out = p.packing(spark, e, SF).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in e.collect()}
    assert sum(r.length for r in out if r.start + r.length == r.doc_tokens) >= e.count()


def test_run_gives_whole_sequences(spark):
    out = p.run(spark, SF).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == r.length
            at += r.length
        assert at <= 2048
