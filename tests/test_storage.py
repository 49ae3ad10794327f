"""Sinks that fail, listings of many files, and reads of listed files only."""

import os

import pytest
from pyspark.sql import functions as F

from gridleaf.sources import files as S
from gridleaf.sources import publish, storage


def rows(spark, path, schema="a long"):
    return sorted(r.a for r in S.read_jsonl(spark, path, schema).collect())


def test_a_failing_job_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_json(spark.range(3).toDF("a"), path)
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("a"))
    for write in (lambda: S.write_json(bad, path), lambda: S.write_text(bad.select(F.col("a").cast("string")), path), lambda: S.write_csv(bad, path, ["a"])):
        with pytest.raises(Exception, match="no"):
            write()
        assert rows(spark, path) == [0, 1, 2] and os.listdir(tmp_path) == ["out"]
    S.write_json(spark.range(5, 7).toDF("a"), path)
    assert rows(spark, path) == [5, 6] and os.listdir(tmp_path) == ["out"]
    S.write_json(spark.read.json(path, schema="a long").select(F.col("a") + 1).toDF("a"), path)  # what it reads is there until it has ended
    assert rows(spark, path) == [6, 7]


def test_a_writer_that_died_between_renames(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_json(spark.range(3).toDF("a"), path)
    os.rename(path, tmp_path / ".out.old-1")
    assert rows(spark, path) == [0, 1, 2] and os.listdir(tmp_path) == ["out"]
    os.rename(path, tmp_path / ".out.old-1")
    S.write_json(spark.range(1).toDF("a"), path)
    assert rows(spark, path) == [0] and os.listdir(tmp_path) == ["out"]


def test_rename_failure_keeps_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    S.write_json(spark.range(3).toDF("a"), path)
    moved, seen = publish._moved, []

    def second_fails(files, a, b):
        seen.append(1)
        if len(seen) == 2:
            raise OSError("gone")
        moved(files, a, b)

    monkeypatch.setattr(publish, "_moved", second_fails)
    with pytest.raises(OSError, match="gone"):
        S.write_json(spark.range(9).toDF("a"), path)
    assert rows(spark, path) == [0, 1, 2] and os.listdir(tmp_path) == ["out"]


def test_empty_union_is_an_empty_file(spark, tmp_path):
    path = tmp_path / "out.csv"
    assert S.write_csv_union([spark.range(0).toDF("a")], str(path)) is False
    parts = [f for f in path.iterdir() if f.name.startswith("part-")]
    assert len(parts) == 1 and parts[0].stat().st_size == 0
    assert S.write_csv_union([], str(path)) is False and S.write_csv_union([spark.range(2).toDF("a"), spark.range(1).toDF("b")], str(path)) is True
    assert S.read_csv(spark, str(path)).columns == ["a", "b"]


def test_many_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    for d in range(40):
        folder = tmp_path / f"d{d % 4}" / f"ü {d}#%20"
        folder.mkdir(parents=True)
        for i in range(250):
            (folder / f"{i}.json").write_bytes(b"x" * (i % 3))
    (tmp_path / "no_ext").write_text("y")
    monkeypatch.setattr(S, "_listed_by_hadoop", None)
    found = S.listing(spark, str(tmp_path), recursive=True)
    assert found.count() == 10_001 and found.where("ext = 'json'").agg(F.sum("size")).first()[0] == 40 * sum(i % 3 for i in range(250))
    assert S.listing(spark, str(tmp_path)).select("name", "ext").collect() == [("no_ext", "no_ext")]
    assert S.listing(spark, str(tmp_path / "none")).count() == 0


def test_listing_agrees_with_hadoop(spark, tmp_path):
    for name in ("a.b.json", ".hidden", "c", "d.", "e f.txt"):
        (tmp_path / name).write_bytes(name.encode())
    cols = ["path", "name", "ext", "size", "mtime"]
    ours, theirs = (sorted(map(tuple, d.select(*cols).collect())) for d in (S.listing(spark, str(tmp_path)), S._listed_by_hadoop(spark, str(tmp_path), False)))
    assert ours == theirs


def test_only_listed_files_are_read(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * (i * 1000))
    some = S.listing(spark, str(tmp_path)).where("name IN ('0', '3', '19')")
    for i in range(20):
        if i not in (0, 3):
            os.remove(tmp_path / f"{i}.bin")
    got = {r.name: r.content for r in S.contents(some).collect()}
    assert got == {"0": b"", "3": bytes([3]) * 3000, "19": None}
    assert "binaryFile" not in S.contents(some)._jdf.queryExecution().toString()


def test_large_contents_go_on_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BATCH", 10)
    for i in range(50):
        (tmp_path / f"{i}.txt").write_bytes(b"z" * 7)
    got = S.contents(S.listing(spark, str(tmp_path)))
    assert got.where("content = X'7A7A7A7A7A7A7A'").count() == 50
