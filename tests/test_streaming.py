"""One or several micro-batches, with or without a restart: the same contacts, each once."""
import datetime

from pyspark.sql import functions as F

from contactlake import schemas as S
from contactlake.streaming import contacts as C
from contactlake.streaming import status as T

PAGE = "page_id BIGINT, url STRING, html STRING, fetched_at TIMESTAMP"


def page(i, url, number):
    at = datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=i)
    return (i, url, f"<footer>{number}</footer>", at)


PAGES = [
    page(1, "https://www.a.ru/", "8 495 111 22 33"), page(2, "https://a.ru/x", "+7 495 111-22-33, 8 903 000 00 01"),
    page(3, "https://b.ru/", "8 495 111 22 33"), page(4, "https://a.ru/y", "8 903 000 00 01"), page(5, "https://c.ru/", "нет"),
]
WANT = [("a.ru", "74951112233"), ("a.ru", "79030000001"), ("b.ru", "74951112233")]


def deliver(spark, rows, path):
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(path)


def found(spark, out):
    return sorted((r.site, r.phone) for r in spark.read.parquet(out).collect())


def test_batches_and_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for rows in (PAGES[:1], PAGES[1:3], PAGES[3:]):
        deliver(spark, rows, src)
        stream = C.read_stream(spark, src, PAGE, files_per_batch=1)
        C.run_available(C.page_contact_stream(stream), out, state)
    assert found(spark, out) == WANT
    C.run_available(C.page_contact_stream(C.read_stream(spark, src, PAGE)), out, state)
    assert found(spark, out) == WANT

    one = str(tmp_path / "one")
    C.run_available(C.page_contact_stream(C.read_stream(spark, src, PAGE)), one, str(tmp_path / "state1"))
    assert found(spark, one) == WANT


def test_text_stream(spark, tmp_path):
    rows = [(1, "тел 8 495 111 22 33 и 8 495 111 22 33", "ru", "s", 1), (2, "8 495 111 22 33", "ru", "s", 1)]
    spark.createDataFrame(rows, S.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    stream = C.text_contact_stream(C.read_stream(spark, str(tmp_path / "in"), S.DOCUMENTS), F.col("source"), F.col("text"),
                                   F.timestamp_seconds("doc_id"))
    C.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert found(spark, str(tmp_path / "out")) == [("s", "74951112233")]


def test_status_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "run_id STRING, site STRING, ts TIMESTAMP, seq BIGINT, status STRING"
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    batches = [
        [("r", "a", at(1), 1, "pending"), ("r", "b", at(2), 2, "error"), ("r", None, at(3), 3, "info")],
        [("r", "a", at(5), 4, "success"), ("r", "a", at(5), 5, "skip"), ("r", "b", at(1), 6, "pending")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        T.run_status_stream(C.read_stream(spark, src, schema), out, state)
    assert {r.site: r.status for r in T.site_status(spark, out).collect()} == {"a": "skip", "b": "error"}
    runs = spark.createDataFrame([("r", "running")], "run_id STRING, status STRING")
    steps = spark.createDataFrame([("r", "analyze", "done"), ("r", "crawl", "running")], "run_id STRING, step STRING, status STRING")
    got = T.run_progress(spark, out, runs, steps).first()
    assert (got.progress, got.current_step) == (16 + 8 + 8, "crawl")


def test_late_pages_are_kept_and_far_repeats_are_not_written_again(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    first = [page(100_000, "https://a.ru/", "8 495 111 22 33")]
    late = [page(1, "https://b.ru/", "8 495 111 22 33"), page(99_000, "https://b.ru/", "8 903 000 00 01"),
            page(300_000, "https://a.ru/x", "8 495 111 22 33")]
    for rows in (first, late):
        deliver(spark, rows, src)
        C.run_available(C.page_contact_stream(C.read_stream(spark, src, PAGE)), out, state)
    assert found(spark, out) == [("a.ru", "74951112233"), ("b.ru", "74951112233"), ("b.ru", "79030000001")]


def test_what_went_out_is_state_and_not_read_back(spark, tmp_path):
    """Batches with another output folder each: contacts of earlier ones are still known."""
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    outs = []
    for i, rows in enumerate((PAGES[:2], PAGES[2:], PAGES[:4])):
        deliver(spark, rows, src)
        outs.append(str(tmp_path / f"out{i}"))
        C.run_available(C.page_contact_stream(C.read_stream(spark, src, PAGE)), outs[-1], state)
    assert sorted(c for o in outs for c in found(spark, o)) == WANT
    assert found(spark, outs[0]) == WANT[:2] and found(spark, outs[2]) == []


def test_earliest_of_a_batch_and_thinning(spark, tmp_path):
    rows = [page(i, f"https://a.ru/{i}", "8 495 111 22 33") for i in range(40, 0, -1)] + [page(5, None, "8 495 111 22 33")]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    deliver(spark, rows, src)
    C.run_available(C.page_contact_stream(C.read_stream(spark, src, PAGE)), out, str(tmp_path / "state"))
    got = {r.site: r.at.minute for r in spark.read.parquet(out).collect()}
    assert got["a.ru"] == 1


def test_time_to_live(spark, tmp_path):
    import time

    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for _ in range(2):
        deliver(spark, PAGES[:1], src)
        C.run_available(C.page_contact_stream(C.read_stream(spark, src, PAGE)), out, state, ttl=datetime.timedelta(seconds=1))
        time.sleep(1.5)
    assert found(spark, out) == [("a.ru", "74951112233")] * 2

