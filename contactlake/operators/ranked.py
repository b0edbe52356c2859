"""A table in a global order, ranked without a sort in one task, and its pages.

Rows are dealt by range and sorted within each partition; the partitions' row counts (one small
number each) give every partition its first rank.  Stored, the table keeps one folder a range and a
note of the ranks each holds, so any page, the ten-thousandth too, reads the one or two ranges
that hold it.
"""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.session import stage
from contactlake.sources.notes import read_note, write_note

_PART, _ROW = "_part", "_row"


def _ranged(rows: DataFrame, order: list[Column], parts: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Staged rows with their range and place in it, and (range, rows) in order."""
    placed = stage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .withColumn(_ROW, F.monotonically_increasing_id()))
    placed = placed.withColumn(_PART, F.shiftright(_ROW, 33).cast("int")).withColumn(
        _ROW, F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1)))
    return placed, sorted(tuple(r) for r in placed.groupBy(_PART).count().collect())


def ranked(rows: DataFrame, *order: Column, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Rows with their place in the global order, from 1.  ``order`` should tell rows apart; others tie at will."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _with_rank(*_ranged(rows, list(order), parts), name).drop(_PART)


def _with_rank(placed: DataFrame, sizes: list[tuple[int, int]], name: str) -> DataFrame:
    before = accumulate((n for _, n in sizes), initial=0)
    # one row a range
    starts = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], f"{_PART} INT, _before LONG")
    return placed.join(F.broadcast(starts), _PART).withColumn(name, F.col("_before") + F.col(_ROW) + 1).drop("_before", _ROW)


def write_ranked(rows: DataFrame, path: str, *order: Column, name: str = "rank", parts: int | None = None) -> None:
    """Store the rows in their global order under ``path``, in place of what it held."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed, sizes = _ranged(rows, list(order), parts)
    before = list(accumulate((n for _, n in sizes), initial=0))
    out = _with_rank(placed, sizes, name)
    out.write.mode("overwrite").partitionBy(_PART).parquet(path)
    fields = [[f.name, f.dataType.simpleString()] for f in out.drop(_PART).schema]
    write_note(spark, f"{path}/_ranks.json", {
        "name": name, "fields": fields, "rows": before[-1], "ranges": [[p, b + 1, b + n] for (p, n), b in zip(sizes, before)]})


def _slice(spark: SparkSession, path: str, note: dict, first: int, last: int) -> DataFrame:
    held = [p for p, lo, hi in note["ranges"] if lo <= last and hi >= first]
    fields = ", ".join(f"`{n}` {t}" for n, t in note["fields"])
    rows = spark.read.schema(f"{fields}, {_PART} INT").parquet(path)
    rank = F.col(note["name"])
    return rows.where(F.col(_PART).isin(held) & rank.between(first, last)).drop(_PART)


def ranked_page(spark: SparkSession, path: str, page: int, size: int = V.PAGE_SIZE) -> DataFrame:
    """One page of a stored table; the page number is held within the existing pages.  Rows carry their rank."""
    note = read_note(spark, f"{path}/_ranks.json")
    at = max(1, min(page, -(-note["rows"] // size)))
    return _slice(spark, path, note, (at - 1) * size + 1, at * size)


def ranked_after(spark: SparkSession, path: str, rank: int, size: int = V.PAGE_SIZE) -> DataFrame:
    """The next rows behind the one of this rank."""
    return _slice(spark, path, read_note(spark, f"{path}/_ranks.json"), rank + 1, rank + size)
