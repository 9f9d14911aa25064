"""The manifest log: writers at once, uncommitted batches, compaction, odd rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from tallyscope.sources import manifest_log

COLS = "k string, arrival long, status string"


def state(spark, path):
    return {r.k: (r.arrival, r.status) for r in manifest_log.current(spark, path, ["k"], "arrival").collect()}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")

    def write(i):
        manifest_log.append(spark.createDataFrame([(f"own{i}", i, "ok"), ("shared", i, f"from{i}")], COLS), path, at=i)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(8)))
    got = state(spark, path)
    assert len(got) == 9 and got["shared"] == (7, "from7")


def test_compaction_changes_nothing_and_lets_others_go_on(spark, tmp_path):
    path = str(tmp_path / "log")
    add = lambda rows, at: manifest_log.append(spark.createDataFrame(rows, COLS), path, at=at)
    add([("a", 1, "old"), ("b", 1, "old"), (None, 1, "nameless")], 10)
    add([("a", 2, "new"), ("a", 5, "later"), ("a", 5, "later")], 30)
    before = state(spark, path)
    assert before == {"a": (5, "later"), "b": (1, "old"), None: (1, "nameless")}
    manifest_log.compact(spark, path, ["k"], "arrival")
    assert state(spark, path) == before
    assert manifest_log.commits(spark, path).count() == 1
    # earlier than the batch that gave a its version, later than that of b
    add([("a", 9, "late writer"), ("b", 9, "late writer")], 20)
    assert state(spark, path) == {"a": (5, "later"), "b": (9, "late writer"), None: (1, "nameless")}
    manifest_log.compact(spark, path, ["k"], "arrival")
    assert state(spark, path)["b"] == (9, "late writer")


def test_a_batch_without_its_marker_does_not_exist(spark, tmp_path):
    path = str(tmp_path / "log")
    manifest_log.append(spark.createDataFrame([("a", 1, "ok")], COLS), path)
    spark.createDataFrame([("a", 2, "lost"), ("z", 1, "lost")], COLS).write.parquet(f"{path}/rows/_batch=half")
    assert state(spark, path) == {"a": (1, "ok")}


def test_columns_may_be_added_and_batches_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "log")
    manifest_log.append(spark.createDataFrame([], COLS), path, at=1)
    assert state(spark, path) == {}
    manifest_log.append(spark.createDataFrame([("a", 1, "ok")], COLS), path, at=2)
    manifest_log.append(spark.createDataFrame([("b", 1, "ok", 7)], COLS + ", note long"), path, at=3)
    rows = {r.k: r.note for r in manifest_log.current(spark, path, ["k"]).collect()}
    assert rows == {"a": None, "b": 7}
    with pytest.raises(ValueError, match="_batch"):
        manifest_log.append(spark.createDataFrame([("a", "b")], "k string, _batch string"), path)
