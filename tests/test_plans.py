"""Plans that have to hold at scale, and the composite jobs end to end."""
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contactlake import session
from contactlake.operators import contacts as C
from contactlake.operators import hits as H
from contactlake.operators import html
from contactlake.operators.flatten import flatten_pages
from contactlake.operators.leads import dedupe_leads, fill_from_catalogs
from contactlake.plans.candidates import brief_parameters, candidate_job, live_pages, seeded_candidates
from contactlake.plans.leads import client_summary, deep_visits, full_run, planned_visits
from contactlake.sources.readers import parse_briefs, read_pages

SF = "/root/testdata/sf0.001"
HITS = "brief_id STRING, pos INT, url STRING, domain STRING, title STRING, snippet STRING, engine STRING, query STRING"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


def test_first_hits_plan(spark):
    hits = spark.createDataFrame([], HITS)
    text = plan(H.first_hits(hits, 5))
    assert "WindowGroupLimit" in text and "partial_min_by" in text
    grouped = plan(H.group_by_domain(H.first_hits(hits, 5)))
    assert "CartesianProduct" not in grouped and "BroadcastNestedLoopJoin" not in grouped


def test_page_jobs_are_narrow(spark):
    pages = spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")
    for df in (html.page_contacts(pages), html.contact_rows(html.page_contacts(pages), "page_id"),
               html.page_content(flatten_pages(pages), "page_id")):
        text = plan(df)
        assert "Exchange" not in text and text.count("MapInArrow") == 1


def test_no_inferred_filter_repeats_the_extraction(spark):
    pages = spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")
    text = plan(html.contact_rows(html.page_contacts(pages), "page_id"))
    assert text.count("whatsapp") == plan(html.page_contacts(pages)).count("whatsapp")


def test_top_k_plans(spark):
    rows = spark.createDataFrame([], "site STRING, ord INT, phone STRING, type STRING, source STRING, source_rank INT")
    text = plan(C.pick_by_site(rows, "site"))
    assert "WindowGroupLimit" in text and text.count("Window [") == 1
    pages = spark.createDataFrame([], "site STRING, url STRING, html STRING")
    assert "WindowGroupLimit" in plan(C.limit_visits(pages, 6, "url"))


def test_equi_joins_only(spark):
    leads = spark.createDataFrame(
        [], "brief_id STRING, ord INT, site STRING, phones ARRAY<STRING>, p1 STRING, p2 STRING, p1_type STRING, "
            "p2_type STRING, source STRING, status STRING")
    contact = "ARRAY<STRUCT<ord: INT, phone: STRING, type: STRING, source: STRING>>"
    pages = spark.createDataFrame([], f"brief_id STRING, url STRING, body STRING, contacts {contact}")
    for df in (fill_from_catalogs(leads, pages), dedupe_leads(leads)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


@needs_data
def test_pages_scan_is_pruned(spark):
    text = plan(html.flatten_pages(read_pages(spark, f"{SF}/pages.parquet", ("page_id", "html"))))
    assert re.search(r"ReadSchema: struct<page_id:bigint,html:string>", text)


def test_spread_leaves_large_tables_alone(spark):
    many = spark.range(1000, numPartitions=64)
    assert "Exchange" not in plan(session.spread(many))
    assert session.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_stage_and_fence(spark):
    folder = session.shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir", folder)
    df = session.stage(spark.range(3).withColumn("x", F.col("id") * 2))
    assert sorted(r.x for r in df.collect()) == [0, 2, 4]
    assert all(f.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")) for f in df.inputFiles())
    fenced = session.fence(df, "id")
    assert sorted(tuple(r) for r in fenced.collect()) == [(0, 0), (1, 2), (2, 4)]


BRIEFS = [
    ("b1", '{"clientSite": "client.ru", "queries": "аренда опалубки", "excludeDomains": "bad.ru", "maxSites": 10}'),
    ("b2", '{"clientSite": "other.ru", "queries": "аренда опалубки", "regions": "тверская область", "regionMode": "exclude"}'),
    ("b3", '{"clientSite": "q.ru", "quickCrawl": true, "seedDomains": "www.one.ru, q.ru, two.ru"}'),
]


def hit(brief, pos, domain, title="Аренда опалубки", snippet="", path="/"):
    return (brief, pos, f"https://{domain}{path}", domain, title, snippet, "e", "аренда опалубки")


def test_full_run(spark):
    params = brief_parameters(parse_briefs(spark.createDataFrame(BRIEFS, "brief_id STRING, value STRING")))
    hits = spark.createDataFrame([
        hit("b1", 0, "client.ru"), hit("b1", 1, "sub.bad.ru"), hit("b1", 2, "avito.ru"), hit("b1", 3, "vc.ru"),
        hit("b1", 4, "home.ru"), hit("b1", 5, "deep.ru"), hit("b1", 6, "snip.ru", snippet="звоните 8 903 000 00 02"),
        hit("b1", 7, "catal.ru"), hit("b1", 8, "none.ru"), hit("b1", 9, "twin.ru"),
        hit("b1", 10, "spb.kudagid.ru", path="/list"),
        hit("b2", 0, "home.ru", snippet="Тверская область"), hit("b2", 1, "home2.ru"),
    ], HITS)
    page = lambda u, h: (u, f"<html><title>{u}</title>{h}</html>")
    pages = spark.createDataFrame([
        page("https://home.ru/", "<header>8 495 000 00 01</header>"), page("https://home.ru/contacts", "8 495 999 99 99"),
        page("https://www.deep.ru", "пусто"), page("https://www.deep.ru/kontakty", "8 903 000 00 03, 8 495 000 00 04"),
        page("https://twin.ru/", "8 495 000 00 01"), page("https://none.ru/", "8 800 000 00 00"),
        page("https://spb.kudagid.ru/list", "CATAL — 8 903 000 00 05, 8 903 000 00 06"),
    ], "url STRING, html STRING")
    got = {(r.brief_id, r.site): r for r in full_run(hits, params.withColumn("check_alive", F.lit(False)), pages, None).collect()}
    assert ("b1", "client.ru") not in got and ("b1", "sub.bad.ru") not in got and ("b1", "avito.ru") not in got
    assert ("b1", "vc.ru") not in got and ("b2", "home.ru") not in got and ("b2", "home2.ru") in got

    def lead(site):
        r = got["b1", site]
        return (r.p1, r.p2, r.p1_type, r.source, r.status, r.crawl_status)

    assert lead("home.ru") == ("74950000001", None, "city", "сайт", "найден", "success")
    assert lead("deep.ru") == ("79030000003", "74950000004", "mobile", "сайт", "найден", "success")
    assert lead("snip.ru") == ("79030000002", None, "mobile", "SERP", "найден", "success")
    assert lead("catal.ru") == ("79030000005", "79030000006", "mobile", "KudaGid", "найден", "error")
    assert lead("none.ru") == (None, None, None, "SERP", "без телефона", "success")
    assert ("b1", "twin.ru") not in got  # its only number is that of home.ru
    assert got["b1", "home.ru"].name == "https://home.ru/"

    seeds = {(r.brief_id, r.domain) for r in seeded_candidates(params).collect()}
    assert seeds == {("b3", "one.ru"), ("b3", "two.ru")}
    live = live_pages(pages.withColumn("html", F.concat("html", F.repeat(F.lit(" "), 300))))
    chosen = candidate_job(hits, params, live).chosen
    order = [r.domain for r in chosen.where("brief_id = 'b1'").orderBy("pick").collect()]
    assert order == ["home.ru", "none.ru", "spb.kudagid.ru", "twin.ru"]


def test_visits(spark):
    link = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    pages = spark.createDataFrame([
        ("https://a.ru/", "<title>А</title>home"), ("https://a.ru/contacts", link("/p1", "/company", "/p2", "/p1")),
        ("https://a.ru/about-us", link("/p3", "/p4")), ("https://a.ru/p1", "8 495 111 22 33"), ("https://a.ru/company", link("/deep")),
        ("https://a.ru/p2", ""), ("https://a.ru/p4", ""), ("https://a.ru/deep", "x"), ("https://a.ru/contacts?x", "q"),
        ("http://www.a.ru/kontakty", "8 903 000 00 01"),
    ], "url STRING, html STRING")
    def visits(df):
        return [r.url.split("a.ru")[1] for r in df.orderBy("visit", "url").collect()]

    assert visits(planned_visits(pages, 2)) == ["/", "/contacts", "/kontakty"]
    assert visits(deep_visits(pages, 3)) == ["/", "/contacts", "/kontakty", "/about-us"]
    # depth 4: three more positions, contact-like link first, then page order
    assert visits(deep_visits(pages, 4))[4:] == ["/company", "/p1", "/p2"]
    # depth 5: six more; /p3 has no snapshot page but uses up one; /deep comes from the second level
    assert visits(deep_visits(pages, 5))[4:] == ["/company", "/p1", "/p2", "/p4", "/deep"]
    r = client_summary(pages).first()
    assert (r.site, r.title, r.phones, r.pages) == ("a.ru", "А", ["79030000001"], 3)


def test_hot_keys(spark):
    """A third of all hits on one domain, half of all contacts on one site: whole results."""
    n = 30_000
    hits = spark.range(n).select(
        F.lit("b").alias("brief_id"), F.col("id").cast("int").alias("pos"), F.lit("u").alias("url"),
        F.when(F.col("id") % 3 == 0, "hot.ru").otherwise(F.concat(F.lit("d"), (F.col("id") % 500).cast("string"))).alias("domain"),
        F.lit("t").alias("title"), F.lit("s").alias("snippet"), F.lit("e").alias("engine"), F.lit("q").alias("query"))
    first = H.first_hits(hits, 1000)
    assert first.count() == 501 and first.where("domain = 'hot.ru'").first().pos == 0
    params = spark.createDataFrame([("b", ["q", "r"]), ("none", [])], "brief_id STRING, brief_queries ARRAY<STRING>")
    stats = {r.brief_id: (r.raw_hits, r.unique_domains, r.queries) for r in H.hit_stats(first, params).collect()}
    assert stats == {"b": (501, 501, 2), "none": (0, 0, 0)}
    rows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("site"), F.col("id").alias("ord"),
        F.format_string("79%09d", F.col("id") % 5000).alias("phone"), F.lit("mobile").alias("type"), F.lit("text").alias("source"))
    unique = C.first_per_site(rows, "site")
    assert unique.count() == 5000
    picked = {r.site: r for r in C.pick_by_site(unique, "site").collect()}
    assert picked["hot"].overflow and picked["hot"].phones == [f"79{i:09d}" for i in range(0, 20, 2)]


@needs_data
def test_registered_queries_read_tables(spark):
    """Every own query scans a given table, or rows that its SQL takes from one."""
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "q_lead_rows" in names
    tables = "documents|pages|events|orders|customer|nation|region|lineitem|part|supplier|conversations"
    for name, sql in entry.oracle_sql().items():
        if name.startswith("q_"):
            assert re.search(rf"(?i)(from|join)\s+\(?({tables})\b", sql), name
