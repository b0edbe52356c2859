"""Live status per (run, site) from the append-only run log.

Every micro-batch is reduced to its latest entry per site and becomes a run of a merged table;
readers take one version of that table, whose size is that of the sites and not of the log.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactlake.operators.runs import progress
from contactlake.sources.merged import FAN_IN, MergedTable

SCHEMA = "run_id STRING, site STRING, at STRUCT<ts: TIMESTAMP, seq: BIGINT>, status STRING"


def status_table(spark: SparkSession, out: str, fan_in: int = FAN_IN) -> MergedTable:
    return MergedTable(spark, out, SCHEMA, ("run_id", "site"), "at", fan_in)


def run_status_stream(log: DataFrame, out: str, checkpoint: str, fan_in: int = FAN_IN) -> StreamingQuery:
    """``log``: run_id, site, ts, seq, status (streaming)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("site").isNotNull()).select("run_id", "site", F.struct("ts", "seq").alias("at"), "status")
        status_table(batch.sparkSession, out, fan_in).add(rows, batch_id)

    q = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    q.awaitTermination()
    return q


def site_status(spark: SparkSession, out: str) -> DataFrame:
    return status_table(spark, out).read().select("run_id", "site", "status")


def run_progress(spark: SparkSession, out: str, runs: DataFrame, steps: DataFrame,
                 probes: DataFrame | None = None) -> DataFrame:
    return progress(runs, steps, site_status(spark, out), probes)
