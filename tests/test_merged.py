"""Merged tables: the latest row of each key after any number of batches, in few files."""
import random

import pytest

from contactlake.sources.merged import MergedTable
from contactlake.sources.notes import read_note, write_note

SCHEMA = "k STRING, v INT, at INT"


def table(spark, path, **more):
    return MergedTable(spark, str(path), SCHEMA, ("k",), "at", **more)


def folders(path):
    return sorted(p.name for p in path.glob("level=*/run-*"))


@pytest.mark.parametrize("fan_in", [2, 4])
def test_fifty_batches(spark, tmp_path, fan_in):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        r, want = random.Random(fan_in), {}
        t = table(spark, tmp_path / "t", fan_in=fan_in)
        n = 50 if fan_in == 4 else 20
        for b in range(n):
            rows = [(f"k{r.randrange(12)}", b * 10 + i, r.randrange(10**6)) for i in range(5)]
            for k, v, at in rows:
                if k not in want or want[k][1] < at:
                    want[k] = (v, at)
            t.add(spark.createDataFrame(rows, SCHEMA).coalesce(1), b)
        assert {x.k: (x.v, x.at) for x in t.read().collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    levels = [x["level"] for x in t.runs()]
    assert max(map(levels.count, levels)) < fan_in and levels == sorted(levels, reverse=True)
    # no more folders than those of this version and the one before
    assert len(folders(tmp_path / "t")) <= len(levels) + fan_in * (max(levels) + 1)
    assert [x["first"] for x in t.runs()][1:] == [x["last"] + 1 for x in t.runs()][:-1]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for b, v in ((0, 1), (1, 2), (1, 99), (0, 98)):
        t.add(spark.createDataFrame([("a", v, v)], SCHEMA), b)
    assert [tuple(r) for r in t.read().collect()] == [("a", 2, 2)]
    assert len(t.runs()) == 2


def test_readers_keep_the_version_they_began_with(spark, tmp_path):
    t = table(spark, tmp_path / "t", fan_in=2)
    t.add(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0)
    held = t.read()
    t.add(spark.createDataFrame([("a", 2, 2), ("b", 1, 1)], SCHEMA), 1)
    assert [tuple(r) for r in held.collect()] == [("a", 1, 1)]
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, 2), ("b", 1, 1)]


def test_a_run_without_a_note_is_not_read(spark, tmp_path):
    """A batch that failed after writing its run and before the note is written again."""
    t = table(spark, tmp_path / "t")
    t.add(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0)
    t._write(spark.createDataFrame([("a", 7, 7)], SCHEMA), 0, 1, 1)
    assert [tuple(r) for r in t.read().collect()] == [("a", 1, 1)]
    t.add(spark.createDataFrame([("a", 7, 7)], SCHEMA), 1)
    assert [tuple(r) for r in t.read().collect()] == [("a", 7, 7)]


def test_empty(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().collect() == []
    t.add(spark.createDataFrame([], SCHEMA), 0)
    assert t.read().collect() == []


def test_notes(spark, tmp_path):
    path = str(tmp_path / "n" / "x.json")
    assert read_note(spark, path, 5) == 5
    for v in ({"a": 1}, {"a": [2, "é"]}):
        write_note(spark, path, v)
        assert read_note(spark, path) == v
    assert [p.name for p in (tmp_path / "n").iterdir() if not p.name.startswith(".")] == ["x.json"]
