"""The run table on disk, in hash buckets, so that an upsert reads and writes the buckets it concerns.

A store is a folder of Parquet partitions ``bucket=...`` by the hash of the run's id, and a note with
the number of buckets.  Updates are reduced to one row an id first; only buckets that hold such
an id are read, and only they are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.session import stage
from contactlake.sources.notes import read_note, write_note
from contactlake.sources.writers import RUN_FIELDS, upsert_runs

COLUMNS = ("id", *RUN_FIELDS, "created_at", "updated_at")
# A bucket of some hundred megabytes is read and written at once; choose the number by the store's size.
BUCKETS = 64


def _note(path: str) -> str:
    return f"{path}/_buckets.json"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    # one file a bucket: rows of a bucket come from one task
    (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode)
     .partitionBy("bucket").parquet(path))


def create_store(runs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the run table as a new store, in place of what the folder held."""
    _write(runs.select(*COLUMNS).withColumn("bucket", _bucket(buckets)), path, "static")
    types = dict(runs.dtypes)
    write_note(runs.sparkSession, _note(path), {"buckets": buckets, "schema": [[c, types[c]] for c in COLUMNS]})


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    note = read_note(spark, _note(path))
    if note is None:
        raise FileNotFoundError(f"no run store in {path}")
    schema = ", ".join(f"`{c}` {t}" for c, t in note["schema"])
    return spark.read.schema(f"{schema}, bucket INT").parquet(path), note["buckets"]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _open(spark, path)[0].drop("bucket")


def runs_by_id(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The runs with these ids (column ``id``), from their buckets only."""
    rows, buckets = _open(spark, path)
    return rows.where(F.col("bucket").isin(_touched(ids, buckets))).join(ids.select("id").distinct(), "id", "left_semi").drop("bucket")


def _touched(rows: DataFrame, buckets: int) -> list[int]:
    """Buckets of the rows' ids: no more numbers than buckets."""
    return sorted(r.b for r in rows.where(F.col("id").isNotNull()).select(_bucket(buckets).alias("b")).distinct().collect())


def touched_runs(spark: SparkSession, path: str, updates: DataFrame) -> DataFrame:
    """The part of the store that a set of updates may change."""
    rows, buckets = _open(spark, path)
    return rows.where(F.col("bucket").isin(_touched(updates, buckets)))


def upsert_store(spark: SparkSession, path: str, updates: DataFrame, now: Column) -> list[int]:
    """Apply partial updates (as ``upsert_runs``) to the store; returns the buckets that were replaced.

    The new buckets are staged in the shared folder before the first is replaced, so a job that
    fails while it computes leaves the store as it was; run again it gives the same rows.  Updates
    without an id are passed over.
    """
    updates = stage(updates.where(F.col("id").isNotNull()))
    rows, buckets = _open(spark, path)
    touched = _touched(updates, buckets)
    if not touched:
        return []
    old = rows.where(F.col("bucket").isin(touched)).drop("bucket")
    types = dict(old.dtypes)
    new = upsert_runs(old, updates, now).select(*(F.col(c).cast(types[c]).alias(c) for c in COLUMNS))
    _write(stage(new.withColumn("bucket", _bucket(buckets))), path, "dynamic")
    return touched
