"""Reading the given tables, staging, and prefix sums over a global order."""
from __future__ import annotations

import os
import zipfile

from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake.session import stage

__all__ = ["highest", "log_level", "on_workers", "prefix_sums", "read", "stage", "task_count"]

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def on_workers(df: DataFrame) -> DataFrame:
    """The same rows; workers can import this package from now on."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        # beside the files that Spark itself serves to executors, and cleared with them
        folder = os.path.join(SparkFiles.getRootDirectory(), "package")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{os.path.basename(_PACKAGE)}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(_PACKAGE):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(_PACKAGE)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: list[str], value: str) -> tuple[DataFrame, int, int]:
    """Add ``before`` (sum of ``value`` in front of the row) and ``place`` (rows in front of it).

    The order is global: range partitions are sorted, each adds up its own rows, and the
    totals of the partitions (one small row each) give every partition its start.  Ties in
    ``order`` are taken in any order, so give columns that tell all rows apart that matter.
    Returns the staged rows, the sum of all values and the number of rows.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()),
                           T.StructField("_sum", T.LongType()), T.StructField("_row", T.LongType())])
    at = df.columns.index(value)

    def local(batches):
        import numpy as np
        import pyarrow as pa

        part, total, rows = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            v = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(v)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(total + upto - v),
                 pa.array(rows + np.arange(len(v)))], names=schema.names)
            total, rows = total + int(upto[-1]) if len(v) else total, rows + len(v)

    rows = stage(on_workers(df).repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order)
                 .mapInArrow(local, schema))
    totals = sorted(rows.groupBy("_part").agg(F.sum(value), F.count("*")).collect())
    starts, total, count = [], 0, 0
    for part, s, n in totals:
        starts.append((part, total, count))
        total, count = total + s, count + n
    # one row per partition, so the size of this side is known
    base = spark.createDataFrame(starts, "_part INT, _sum0 LONG, _row0 LONG")
    out = (rows.join(F.broadcast(base), "_part")
           .select(*df.columns, (F.col("_sum") + F.col("_sum0")).alias("before"),
                   (F.col("_row") + F.col("_row0")).alias("place")))
    return out, total, count


def log_level(value: Column) -> Column:
    """Level of a positive number: the floor of 256 times its binary logarithm."""
    return F.floor(F.log2(value) * 256).cast("int")


def highest(df: DataFrame, level: Column, most: int) -> DataFrame:
    """All rows of the highest levels that together hold at most ``most`` rows.

    ``level`` has a bounded number of values (``log_level``: some thousands).  Only their counts
    reach the driver, and no task or driver sorts rows; the first level that would not fit is
    left out whole, so the rows do not depend on their order.
    """
    kept, lowest = 0, None
    for value, rows in sorted(df.groupBy(level.alias("level")).count().collect(), key=lambda r: -r[0]):
        if kept + rows > most:
            return df.where(level >= lowest) if lowest is not None else df.limit(0)
        kept, lowest = kept + rows, value
    return df
