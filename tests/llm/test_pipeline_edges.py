"""Every stage on NULLs, empty and long texts, ties, repeated rows, clashing names and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline as p
from tallyscope.functions.session import checkpointed

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 2500
ROWS = [
    (1, "one two three four five six seven", "en", "a", 1), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, " \n\t ", None, "b", 3),
    (None, "text without an id at all here", "en", "b", 1), (None, None, None, None, None), (5, LONG, "en", "a", 1), (6, "one two three four five six seven", "en", "a", 1),
    (7, "write to bob@mail1.example.com now please my friend", "de", "b", 1),
    *[(8, "again and again the very same row of words", "en", "a", 1)] * 5, (8, "another text under the same number as others", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score double, size string, row int, component_id string, key int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, 1.0, "s", 3, "c", 4) for r in ROWS], SCHEMA).repartition(3)


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_empty_table(spark, docs, name, stage):
    out = stage(spark, docs.where("doc_id = 99"), SF)
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_defined_results(spark, docs):
    got = {name: checkpointed(stage(spark, docs, SF)) for name, stage in p.STAGES}
    every = Counter(r[0] for r in ROWS)
    for name in ("toxicity", "near_duplicates", "personal_data", "source_mix"):
        assert got[name].columns == docs.columns
        assert {(r.size, r.row, r.component_id, r.key) for r in got[name].collect()} == {("s", 3, "c", 4)}
    # nothing here is toxic, and no row is lost or gained
    assert Counter(r.doc_id for r in got["toxicity"].collect()) == every
    # equal texts and repeated rows leave one; texts without words and rows without an id stay
    kept = Counter(r.doc_id for r in got["near_duplicates"].collect())
    assert kept == Counter([1, 2, 3, 4, 5, 7, 8, 8, None, None])
    private = got["personal_data"].collect()
    assert Counter(r.doc_id for r in private) == every
    text = {r.doc_id: r.text for r in private if r.doc_id is not None}
    assert text[2] is None and text[3] == "" and text[5] == LONG and "bob@mail1" not in text[7] and text[7].startswith("write to ")
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in private)
    # texts without words weigh nothing and stay; no source goes beyond three times itself
    mixed = Counter(r.doc_id for r in got["source_mix"].collect())
    assert all(mixed[i] == 1 for i in (2, 3, 4)) and set(mixed) <= set(every)
    # each row's ids lie in its pieces, and empty texts are one closing id
    pieces = got["packing"].collect()
    assert {(r.length, r.doc_tokens) for r in pieces if r.doc_id in (2, 3, 4)} == {(1, 1)}
    assert sum(r.length for r in pieces if r.doc_id == 5) == next(r.doc_tokens for r in pieces if r.doc_id == 5) == 20_001
