"""Looking pages up in a snapshot leaves html where it is."""
import re
import uuid

import pytest
from pyspark.sql import functions as F

from contactlake.plans.leads import catalog_pages, deep_visits
from contactlake.plans.profile import survey_pages
from contactlake.sources.snapshot import has_page, pages_at, read_snapshot, write_snapshot


def page(url, *links):
    nav = "".join(f'<a href="{h}">{h.strip("/")}</a>' for h in links)
    return (url, f"<html><body><nav>{nav}</nav><p>8 495 111 22 33</p></body></html>")


PAGES = [page("https://a.ru/", "/catalog", "/services"), page("https://a.ru/catalog"), page("https://a.ru/services"),
         page("https://a.ru/contacts", "/p1", "/p2"), page("https://a.ru/p1"), page("https://a.ru/p2"), page("https://b.ru/", "/services"),
         page("https://b.ru/services"), page("https://c.ru/x")]


@pytest.fixture
def snapshot(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "url STRING, html STRING")
    name = f"pages_{uuid.uuid4().hex}"
    write_snapshot(pages, name, str(tmp_path / "pages"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield pages, read_snapshot(spark, name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.sql(f"DROP TABLE {name}")


def moved_html(df):
    """Scans of the snapshot that read html and lie below an exchange with nothing between that drops it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    bad, depth = [], lambda line: len(re.match(r"[\s:+\-|]*", line).group())
    for i, line in enumerate(lines):
        if "FileScan" not in line or "html" not in line.split("Batched")[0]:
            continue
        at = depth(line)
        for above in reversed(lines[:i]):
            if depth(above) < at:
                at = depth(above)
                if "MapInArrow" in above or "Join" in above:
                    break  # the parsed page, or the lookup itself
                if "Exchange" in above:
                    bad.append(line)
    return bad


def test_lookups_read_html_in_place(spark, snapshot):
    pages, table = snapshot
    urls = spark.createDataFrame([("https://a.ru/p1", 1), ("https://none.ru/", 2), (None, 3)], "url STRING, k INT").repartition(3)
    found = pages_at(table, urls)
    assert moved_html(found) == []
    assert [(r.k, "495" in r.html) for r in found.collect()] == [(1, True)]
    kept = has_page(table, urls.unionByName(urls))
    assert moved_html(kept) == [] and [r.url for r in kept.collect()] == ["https://a.ru/p1"]


def test_the_helper_sees_a_moved_scan(spark, snapshot, tmp_path):
    pages, _ = snapshot
    pages.write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain"))
    urls = spark.createDataFrame([("https://a.ru/p1",)], "url STRING")
    assert moved_html(pages_at(plain, urls)) != []


def test_jobs_over_a_snapshot(spark, snapshot):
    pages, table = snapshot
    surveyed = survey_pages(table)
    assert moved_html(surveyed) == []
    rows = lambda df: sorted((r.site, r.visit, r.url) for r in df.collect())
    assert rows(surveyed) == rows(survey_pages(pages))
    assert {r[2] for r in rows(surveyed)} >= {"https://a.ru/", "https://a.ru/catalog", "https://b.ru/services"}
    deep = deep_visits(table, 5, spark.createDataFrame([("a.ru",)], "site STRING"))
    assert moved_html(deep) == []
    assert rows(deep) == [r for r in rows(deep_visits(pages, 5)) if r[0] == "a.ru"]
    assert {"https://a.ru/p1", "https://a.ru/p2"} <= {r[2] for r in rows(deep)}
    hits = spark.createDataFrame([("b", 1, "https://b.ru/services", "b.ru")], "brief_id STRING, pos INT, url STRING, domain STRING")
    found = catalog_pages(hits, table, domains=("b.ru",))
    assert moved_html(found) == [] and [r.url for r in found.collect()] == ["https://b.ru/services"]
