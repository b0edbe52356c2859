"""Upserts into a bucketed run store touch the buckets they concern."""
import os

import pytest
from pyspark.sql import functions as F

from contactlake.sources import runstore as R
from contactlake.sources.writers import upsert_runs

RUN = ("id STRING, status STRING, brief_json STRING, pipeline_json STRING, results_json STRING, error STRING, is_demo INT, "
       "created_at STRING, updated_at STRING")
UPDATE = "id STRING, seq INT, status STRING, brief_json STRING, pipeline_json STRING, results_json STRING, error STRING, is_demo INT"


def explained(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def runs(spark, n):
    return spark.createDataFrame([(f"r{i}", "done", "{}", None, "[]", None, 0, f"2026-01-{i % 28 + 1:02d}", "2026-01-31")
                                  for i in range(n)], RUN)


def update(spark, rows):
    return spark.createDataFrame([(i, s, st, None, None, None, e, None) for i, s, st, e in rows], UPDATE)


def files(path):
    return {f"{os.path.basename(d)}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_change(spark, tmp_path):
    path = str(tmp_path / "store")
    all_runs = runs(spark, 200)
    R.create_store(all_runs, path, 16)
    before = files(path)
    up = update(spark, [("r5", 1, "running", None), ("r5", 2, None, "boom"), ("new", 1, None, None), (None, 1, "x", None)])
    touched = R.upsert_store(spark, path, up, F.lit("2026-02-01"))
    after = files(path)
    assert 1 <= len(touched) <= 2
    assert {f.split("/")[0] for f in before ^ after} == {f"bucket={b}" for b in touched}
    want = upsert_runs(all_runs, up.where("id is not null"), F.lit("2026-02-01"))
    assert sorted(map(tuple, R.read_store(spark, path).collect()), key=repr) == sorted(
        map(tuple, want.select(*R.COLUMNS).collect()), key=repr)
    # the same updates again change nothing but the time
    R.upsert_store(spark, path, up, F.lit("2026-02-01"))
    assert R.read_store(spark, path).count() == 201


def test_plan_reads_the_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    R.create_store(runs(spark, 200), path, 16)
    part = R.touched_runs(spark, path, update(spark, [("r5", 1, "x", None)]))
    assert "PartitionFilters: [isnotnull(bucket" in explained(part)
    assert part.select(F.input_file_name()).distinct().count() == 1
    assert [r.id for r in R.runs_by_id(spark, path, spark.createDataFrame([("r5",), ("none",)], "id STRING")).collect()] == ["r5"]


def test_no_updates_and_no_store(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        R.read_store(spark, path)
    R.create_store(runs(spark, 3), path, 4)
    assert R.upsert_store(spark, path, update(spark, []), F.lit("x")) == []
    R.upsert_store(spark, path, update(spark, [("brand", 1, "s", None)]), F.lit("2026-02-01"))
    assert {r.id for r in R.read_store(spark, path).collect()} == {"r0", "r1", "r2", "brand"}


def test_empty_store_takes_new_runs(spark, tmp_path):
    path = str(tmp_path / "store")
    R.create_store(runs(spark, 2).limit(0), path, 4)
    R.upsert_store(spark, path, update(spark, [("a", 1, "s", None)]), F.lit("t"))
    assert [(r.id, r.status, r.created_at) for r in R.read_store(spark, path).collect()] == [("a", "s", "t")]
