"""Streaming forms over the given tables as file streams.

A table may be a file or a folder, and a file stream takes a folder or a pattern: so the names
are patterns that only the table itself fits.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contactlake import schemas as S
from contactlake.functions.phone import NANP
from contactlake.session import shared_dir
from contactlake.streaming.contacts import page_contact_stream, read_stream, run_available, text_contact_stream
from contactlake.streaming.status import run_progress, run_status_stream, site_status
from workload import runs as R
from workload.common import PLAIN_TEXT_SQL, contacts_sql, host_sql


def _work(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _texts(stream):
    return text_contact_stream(
        stream, F.col("source"), F.col("text"), F.timestamp_seconds(F.col("doc_id") * 3600), plan=NANP)


def q_stream_contacts(spark, sf_dir):
    """Every document once through the text stream; a (source, phone) pair goes out once."""
    work = _work(spark)
    run_available(_texts(read_stream(spark, f"{sf_dir}/documents.parque[t]", S.DOCUMENTS)), f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out").select("site", "phone", "type")


def q_stream_resume(spark, sf_dir):
    """The documents arrive in two deliveries with a restart in between; each spans the whole time."""
    work = _work(spark)
    d = spark.read.schema(S.DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")
    for short in (True, False):
        d.where((F.col("n_chars") < 2000) == short).write.mode("append").parquet(f"{work}/in")
        run_available(_texts(read_stream(spark, f"{work}/in", S.DOCUMENTS)), f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out").groupBy("site", "phone").agg(F.count("*").alias("n"))


def q_stream_pages(spark, sf_dir):
    work = _work(spark)
    pages = read_stream(spark, f"{sf_dir}/pages.parque[t]", S.PAGES).withColumn("fetched_at", F.timestamp_seconds("page_id"))
    run_available(page_contact_stream(pages, plan=NANP), f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out").select("site", "phone", "type")


def _status_work(spark, sf_dir):
    work = _work(spark)
    e = read_stream(spark, f"{sf_dir}/events.parque[t]", S.EVENTS)
    kind = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "click", "skip").otherwise("pending")
    log = e.select(F.col("user_id").cast("string").alias("run_id"), F.get_json_object("props", "$.k").alias("site"),
                   F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("status"))
    run_status_stream(log, f"{work}/status", f"{work}/state")
    return f"{work}/status"


def q_stream_status(spark, sf_dir):
    return site_status(spark, _status_work(spark, sf_dir))


def q_stream_progress(spark, sf_dir):
    steps = R._steps(spark, sf_dir).withColumn("run_id", F.col("run_id").cast("string"))
    states = steps.groupBy("run_id").agg(F.lit("running").alias("status"))
    return run_progress(spark, _status_work(spark, sf_dir), states, steps)


QUERIES = {f.__name__: f for f in (
    q_stream_contacts, q_stream_resume, q_stream_pages, q_stream_status, q_stream_progress)}

_DOCS = f"WITH {contacts_sql('c', 'documents', 'doc_id, source', 'text')}"
SQL = {
    "q_stream_contacts": f"{_DOCS} SELECT DISTINCT source AS site, phone, type FROM c",
    "q_stream_resume": f"{_DOCS} SELECT DISTINCT source AS site, phone, CAST(1 AS BIGINT) AS n FROM c",
    "q_stream_pages": f"""WITH {contacts_sql('pc', f"(SELECT page_id, url, {PLAIN_TEXT_SQL} AS text FROM pages)", 'page_id, url', 'text')}
        SELECT DISTINCT {host_sql('url')} AS site, phone, type FROM pc""",
    "q_stream_status": f"WITH {R._SITES} SELECT CAST(run_id AS VARCHAR) AS run_id, site, status FROM si",
    "q_stream_progress": f"""WITH {R._STEPS}, {R._SITES},
        b AS (SELECT run_id, sum(CASE status WHEN 'done' THEN 16 WHEN 'running' THEN 8 ELSE 0 END) AS base,
              arg_max(step, array_position([{', '.join(repr(s) for s in R.V.STEPS)}], step)) FILTER (WHERE status = 'running') AS current,
              bool_or(status = 'running' AND step = 'crawl') AS c FROM st GROUP BY 1),
        d AS (SELECT run_id, count(*) FILTER (WHERE status IN ('success', 'error', 'skip')) AS done, count(*) AS n FROM si GROUP BY 1)
        SELECT CAST(b.run_id AS VARCHAR) AS run_id, 'running' AS status, CAST(least(base
          + CASE WHEN c THEN floor(8.0::DOUBLE * done / n) ELSE 0 END, 99) AS INTEGER) AS progress,
          coalesce(current, '') AS current_step FROM b LEFT JOIN d USING (run_id)""",
}
