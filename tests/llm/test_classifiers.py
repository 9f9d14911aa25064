import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyscope.llm.common import fold
from tallyscope.llm.labelled import training_rows
from tallyscope.llm.quality import fit_network, quality_scores
from tallyscope.llm.toxicity import fit_machine, learn, score_texts, term_places, with_scores


def test_pairs_of_terms_count(words):
    """Toxic only if an insult and a group stand together: no additive weight can tell."""
    rng, texts, labels = random.Random(0), [], []
    for _ in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        t = words(rng.randint(3, 30)).split() + ["insultword"] * insult + ["groupword"] * group
        rng.shuffle(t)
        texts.append(" ".join(t))
        labels.append(float(insult and group))
    places, bounds = term_places(pa.array(texts))
    lists, y = [places[a:b] for a, b in zip(bounds[:-1], bounds[1:])], np.array(labels)
    m = fit_machine(lists[:900], y[:900])
    flat = np.concatenate(lists[900:])
    right = (m.margins(flat, np.cumsum([0, *map(len, lists[900:])])) > 0) == (y[900:] > 0)
    assert right.mean() > 0.97


def made(spark, words, n=400):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        bad = rng.random() < 0.3
        t = words(rng.randint(5, 60)).split()
        if bad:
            t = [w + "&&&" if k % 2 else w for k, w in enumerate(t)] + ["scoundrel"]
        rows.append((i, " ".join(t), "x", 1.0))
        if i % 4:
            labels.append((i, int(not bad), int(bad)))
    rows += [(n, None, "x", 1.0), (n + 1, "", "x", 1.0), (n + 2, "  \n", "x", 1.0), rows[0], rows[0], (None, "scoundrel", "x", 1.0), (n + 3, "long " * 50_000, "x", 1.0)]
    labels += [(None, 1, 1), (1, None, None), (2, 0, 1), labels[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def judge(got, labels, name, held, flip):
    truth = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None}
    mine = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in got if r.doc_id in truth and r.doc_id in held]
    assert len(mine) > 20 and np.mean(mine) > 0.9
    assert all(0 <= r.score <= 1 for r in got) and flip is not None


def test_toxicity_on_held_out_rows(spark, words):
    docs, labels, rows = made(spark, words)
    machine = learn(docs, labels, fold(F.col("doc_id"), 5) != 0)
    got = score_texts(docs, machine).collect()
    held = {r.doc_id for r in docs.where(fold(F.col("doc_id"), 5) == 0).collect()}
    assert len(got) == len(rows)
    judge(got, labels, "toxic", held, 1)
    empty = {round(r.score, 12) for r in got if r.doc_id in (400, 401, 402)}
    assert len(empty) == 1 and empty.pop() < 0.5
    kept = with_scores(docs, machine, name="score_")
    assert kept.columns == [*docs.columns, "score_"] and kept.count() == len(rows)


def test_quality_on_held_out_rows(spark, words):
    docs, labels, rows = made(spark, words)
    got = quality_scores(docs, labels, fold(F.col("doc_id"), 4) != 2).collect()
    held = {r.doc_id for r in docs.where(fold(F.col("doc_id"), 4) == 2).collect()}
    assert len(got) == len(rows)
    judge(got, labels, "quality", held, 0)
    again = quality_scores(docs.repartition(7), labels, fold(F.col("doc_id"), 4) != 2).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in again) == sorted((str(r.doc_id), round(r.score, 6)) for r in got)


def test_no_labels_no_rows_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (score_texts(docs, learn(docs, none, F.lit(True))), quality_scores(docs, none, F.lit(True))):
        assert {r.score for r in out.collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in quality_scores(docs, one, F.lit(True)).collect())
    assert quality_scores(docs.limit(0), one, F.lit(True)).collect() == []
    assert score_texts(docs.limit(0), learn(docs.limit(0), one, F.lit(True))).collect() == []


def test_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    a = training_rows(labels, "toxic", F.col("doc_id") % 3 != 0, 50).collect()
    b = training_rows(labels.repartition(9), "toxic", F.col("doc_id") % 3 != 0, 50).collect()
    assert len(a) == 50 and sorted(a) == sorted(b) and all(r.doc_id % 3 for r in a)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (4000, 6))
    p = 1 / (1 + np.exp(-1.5 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    net = fit_network(x[:3000], y[:3000])
    s = net.scores(x[3000:])
    for lo in (0.0, 0.25, 0.5, 0.75):
        some = (s >= lo) & (s < lo + 0.25)
        assert abs(s[some].mean() - y[3000:][some].mean()) < 0.12
