"""Session settings the jobs rely on."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension this small is broadcast; anything larger is left to the optimizer.
BROADCAST_MAX_ROWS = 10_000
_LOCAL_DIRS: dict[str, str] = {}


def build_session(cores: str = "*", shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("contactlake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        # rows here are small in bytes and dear in CPU: do not merge them into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints, stream state and staged tables.

    Taken from ``spark.checkpoint.dir``.  A machine-local folder is made only in
    local mode, where driver and executors share one disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="contactlake-")
    return _LOCAL_DIRS[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    For small results of expensive work that are read more than once.  Unlike a
    checkpoint the copy is columnar and has a known size, so later joins prune columns
    and choose their strategy from real numbers.
    """
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fence(df: DataFrame, key: str) -> DataFrame:
    """The same rows behind an aggregate on their unique key.

    A filter that a later explode or condition brings in stops at the aggregate.  Without
    it the optimizer rewrites the filter into the long expressions below, once per use,
    and they are evaluated (and planned) many times over.  Input already hashed by the key
    is not shuffled again.
    """
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.first(F.struct(*rest)).alias("_row")).select(key, "_row.*")


# Rows of a dear table that one task should take.
TASK_ROWS = 16_384


def spread(df: DataFrame) -> DataFrame:
    """Give a freshly read table at least one partition per core, and none of very many rows.

    A parquet row group is one task, however heavy the work on it, and its file may be cut into
    splits that hold nothing, so the rows of each split are counted (from the files' footers).  A table whose
    rows lie in many splits of fair size passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        rows = [df.count()]
    else:
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if len(rows) >= cores and max(rows) <= 2 * max(TASK_ROWS, sum(rows) // len(rows)) and max(rows) <= 4 * TASK_ROWS:
        return df
    return df.repartition(max(cores, -(-sum(rows) // TASK_ROWS)))
