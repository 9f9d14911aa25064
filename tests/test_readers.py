"""Wide count tables read by lines."""

from tallyscope.sources import readers


def test_samples_are_kept_or_skipped_whole(spark, tmp_path):
    files = {
        "good.csv": 'cell,"g1",g2,g3\n"c1",0,2,0\nc2,1,0,3.0000000001\n\nc3,0,0,0\n',
        "half.csv": "cell,g1\nc1,0.5\n",
        "minus.csv": "cell,g1\nc1,-1\n",
        "text.csv": "cell,g1\nc1,many\n",
        "blank.csv": "cell,g1,g2\nc1,,1\n",
        "short.csv": "cell,g1,g2\nc1,1\n",
        "other.csv": "EntityID,g1\nc1,1\n",
        "names.csv": "cell,g1\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    counts, skipped = readers.read_count_tables(spark, str(tmp_path))
    assert sorted(tuple(r) for r in counts.collect()) == [("good.csv", "c1", "g2", 2), ("good.csv", "c2", "g1", 1), ("good.csv", "c2", "g3", 3)]
    assert {r.sample_id: r.skip_reason for r in skipped.collect()} == {
        "half.csv": "fractional_value", "minus.csv": "negative_value", "text.csv": "unreadable_value", "blank.csv": "unreadable_value",
        "short.csv": "ragged_line", "other.csv": "first_column",
    }


def test_the_plan_does_not_grow_with_the_features(spark, tmp_path):
    def plan(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        lines = ["cell\t" + "\t".join(f"f{i}" for i in range(n))] + [f"c{j}\t" + "\t".join("1" if i % 1000 == j else "0" for i in range(n)) for j in range(3)]
        (folder / "t.tsv").write_text("\n".join(lines))
        counts, _ = readers.read_count_tables(spark, str(folder), sep="\t")
        assert counts.count() == 3 * -(-n // 1000)
        return len(counts._jdf.queryExecution().optimizedPlan().toString())

    assert plan(20_000) <= plan(2000) + 200


def test_text_is_read_once_and_split_as_it_stands(spark, tmp_path):
    files = {
        "good.txt": 'cell::"g1"::gä::g3\nü::0::5::0.0\n"c2"::-0::0.00::00\nc3::1e1::0::30\n',
        "twice.txt": "cell::g1\nc1::0\ncell::g1\nc1::4\n",
        "colon.txt": "cell::g1\nc1::2:\n:c2::1\n",
        "blank.txt": "cell::g1::g2\nc1::0::\n",
        "long.txt": "cell::g1\nc1::0::0\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    counts, skipped = readers.read_count_tables(spark, str(tmp_path), sep="::")
    assert sorted(tuple(r) for r in counts.collect()) == [("good.txt", "c3", "g1", 10), ("good.txt", "c3", "g3", 30), ("good.txt", "ü", "gä", 5), ("twice.txt", "c1", "g1", 4)]
    assert {r.sample_id: r.skip_reason for r in skipped.collect()} == {"colon.txt": "unreadable_value", "blank.txt": "unreadable_value", "long.txt": "ragged_line"}
    assert not any("FileScan text" in df._jdf.queryExecution().toString() for df in (counts, skipped))


def test_tables_of_the_query_are_compressed(spark, tmp_path, monkeypatch):
    """Lines of 5 000 zeros: as plain text they took some 10 KB each."""
    import os

    import catalog.files as files
    from __spark_entry__ import queries

    monkeypatch.setattr(files, "scratch_path", lambda spark, name: str(tmp_path / name))
    queries()["io1_wide_tables"](spark, "/root/testdata/sf0.001")
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "tables") for f in names if f.startswith("part-")]
    lines = spark.read.text(str(tmp_path / "tables")).selectExpr("count(*)", "sum(length(value))").first()
    assert lines[0] > 100 and lines[1] > 9000 * lines[0] and sum(sizes) < lines[1] / 10
