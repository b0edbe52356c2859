"""Incremental contact extraction.

New pages (or texts) come in as a file stream; each (site, phone) goes out once, however far
apart in time its pages lie.  What has gone out is keyed state in the stream's state store: a
micro-batch asks for its own keys only, so its work does not grow with what earlier batches
wrote, and a restart goes on from the checkpoint.  A batch replaces the folder of its own
number, so a repeated batch leaves the same files.
"""
from __future__ import annotations

import datetime
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from contactlake.functions.phone import RU, NumberingPlan
from contactlake.functions.url import host
from contactlake.operators.contacts import text_contacts
from contactlake.operators.html import page_contacts


KEYS = ("site", "phone")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_contact_stream(pages: DataFrame, time: str = "fetched_at", plan: NumberingPlan = RU) -> DataFrame:
    """Streaming pages (url, html, event time) -> contacts: time, site, ord, phone, type, source."""
    parsed = page_contacts(pages.select(time, "url", "html"), plan)
    return parsed.select(F.col(time).alias("at"), host(F.col("url")).alias("site"), F.inline_outer("contacts")).where(
        F.col("phone").isNotNull())


def text_contact_stream(texts: DataFrame, site: Column, text: Column, time: Column, plan: NumberingPlan = RU) -> DataFrame:
    """Streaming texts -> contacts."""
    keyed = texts.select(time.alias("at"), site.alias("site"), text.alias("text"))
    return text_contacts(keyed, F.col("text"), plan=plan).select("at", "site", F.inline_outer("contacts")).where(
        F.col("phone").isNotNull())


def _order(row: tuple) -> tuple:
    return tuple((v is not None, v) for v in row)


class FirstSeen(StatefulProcessor):
    """Lets the least row of a key through, once; with a time to live again when that has passed."""

    def __init__(self, columns: list[str], ttl_ms: int | None):
        self._columns, self._ttl = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen BOOLEAN", self._ttl)

    def handleInputRows(self, key, rows, timerValues):
        if not self._seen.exists():
            self._seen.update((True,))
            yield min(rows, key=lambda r: _order(tuple(r[c] for c in self._columns)))

    def close(self) -> None:
        pass


def _fewer(columns: list[str]):
    """Of equal contacts of one Arrow batch only the least goes on, so a hot contact is thinned before the shuffle."""
    rest = [c for c in columns if c not in KEYS]

    def run(batches):
        for b in batches:
            order = [(c, "ascending") for c in [*KEYS, *rest]]
            b = b.take(pc.sort_indices(b, order, null_placement="at_start"))
            same = np.ones(max(b.num_rows - 1, 0), bool)
            for c in KEYS:
                v = b.column(c)
                same &= pc.equal(v[1:], v[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(np.r_[[True] * min(1, b.num_rows), ~same].astype(bool)))

    return run


def run_available(stream: DataFrame, out: str, checkpoint: str, ttl: datetime.timedelta | None = None) -> StreamingQuery:
    """Process what is there now, add the contacts that are new to ``out`` and stop.

    Of equal contacts of a batch the earliest is written.  With ``ttl`` a contact is forgotten that
    long (by the clock) after it went out, which bounds the state; a later page brings it again.
    """
    spark, columns = stream.sparkSession, stream.columns
    thin = stream.mapInArrow(_fewer(columns), stream.schema)
    fresh = thin.groupBy(*KEYS).transformWithState(
        FirstSeen([c for c in columns if c not in KEYS], ttl and int(ttl.total_seconds() * 1000)), stream.schema, "append",
        "processingTime" if ttl else "none")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": STATE_STORE,
                           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
                           # the clock alone starts no batch, else a state with a time to live would never be done
                           "spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        q = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings that a stream takes up when it starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None,
                files_per_batch: int = 1000) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)
