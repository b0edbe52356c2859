"""Profiles of whole sites: every page and every text counts, whatever range of pages it lies in."""
import random
import re

import pytest
from pyspark.sql import functions as F

from contactlake.functions.url import host
from contactlake.operators import profile as P
from contactlake.operators import siteprofile as SP
from contactlake.operators.flatten import flatten_pages
from contactlake.operators.html import headings, list_items, meta_description, page_title, visible_text
from contactlake.plans.profile import whole_profile_job
from workload import profile as W

PAGES = "page_id BIGINT, url STRING, html STRING"


def page(i, body, site="okna.ru", head=""):
    return i, f"https://{site}/{i}" if site else None, f"<html><head>{head}</head><body>{body}</body></html>"


def profiles(spark, rows):
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = whole_profile_job(pages.withColumn("site", host(F.col("url"))), "page_id")
    return {r.site: r for r in got.collect()}


def test_query_reads_all_pages_and_whole_texts(spark, tmp_path):
    """A seventh page, and what lies behind the 8000th character, change the profile."""
    filler = "<p>" + "абв где. " * 1500 + "</p>"
    rows = [page(i, f"<p>{i}.</p>") for i in range(6)]
    rows += [page(6, filler + "<h2>Монтаж окон недорого</h2><p>. ремонт пластиковых балконов. аренда в Казань. ООО «Окна Плюс»</p>")]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    r = W.q_profile(spark, str(tmp_path)).first()
    assert r.pages_surveyed == 7 and r.geo_cities == "Казань" and r.client_name == "ООО «Окна Плюс»"
    assert r.offerings.split("|")[0] == "Монтаж окон недорого" and "ремонт пластиковых балконов" in r.offerings
    assert r.business_model == "goods_rental" and "пластиковых" in r.industry_keywords


def test_no_limit_within_a_page(spark):
    """Behind 40 images, 40 blocks, 30 items of a block and 500 characters of a description."""
    body = "<img alt='x'>" * 50 + "<div></div>" * 50
    body += "<div><ul>" + "".join(f"<li>пункт {k}</li>" for k in range(50)) + "<li>аренда строительных лесов</li></ul></div>"
    body += "".join(f"<h2>{k}</h2>" for k in range(70)) + "<h2>Монтаж стальных дверей</h2>"
    head = f"<meta name=description content='{'Раз. ' * 200}Доставка бетонных плит. '>"
    r = profiles(spark, [page(1, body, head=head)])["okna.ru"]
    assert r.offerings[:3] == ["Монтаж стальных дверей", "аренда строительных лесов", "Доставка бетонных плит"]


def test_pages_without_site_text_or_number(spark):
    rows = [page(1, "аренда "), page(2, "ремонт пластиковых окон.", site=None), (None, None, None), page(3, "", site="leer.ru")]
    got = profiles(spark, [*rows, rows[1]])
    assert got[None].pages_surveyed == 3 and got[None].offerings == ["ремонт пластиковых окон"]
    assert (got["leer.ru"].offerings, got["leer.ru"].industry_keywords, got["leer.ru"].title) == ([], [], "")


def joined(spark, rows):
    """Profiles by the rules for one row a site, from the texts of all pages joined without a limit."""
    content = flatten_pages(spark.createDataFrame(rows, PAGES).withColumn("site", host(F.col("url"))), whole=True).select(
        "site", "page_id", page_title().alias("title"), visible_text().alias("text"), headings(None).alias("headings"),
        list_items(None).alias("list_items"), meta_description(None).alias("meta"))
    sites = content.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_id", F.struct(
        "title", "text", "headings", "list_items", "meta").alias("p")))).alias("pages"))
    none = F.array().cast("array<string>")
    described = F.filter(F.transform("pages", lambda x: x["p"]["meta"]), lambda d: d != "")
    survey = sites.select(
        "site", F.get("pages", F.lit(0))["p"]["title"].alias("title"),
        F.array_join(F.transform("pages", lambda x: x["p"]["text"]), "\n").alias("body_text"),
        F.flatten(F.transform("pages", lambda x: x["p"]["headings"])).alias("headings"),
        F.flatten(F.transform("pages", lambda x: x["p"]["list_items"])).alias("list_items"), none.alias("schema_offerings"),
        F.coalesce(F.get(described, F.lit(0)), F.lit("")).alias("meta_description"), none.alias("brand_hints"),
        none.alias("org_names"), F.lit("").alias("footer_text"), F.size("pages").alias("pages_surveyed"))
    return {r.site: r for r in P.profile_sites(survey).collect()}


def test_same_as_joined_texts(spark, monkeypatch):
    """Random pages, many without a full stop, so that phrases run over edges of pages and ranges; small packs of words."""
    monkeypatch.setattr(SP, "_PAGE_ROWS", 4)
    monkeypatch.setattr(SP, "_PACK", 5)
    monkeypatch.setattr(SP, "_HELD", 20)
    rnd = random.Random(1)
    words = ["аренда", "монтаж", "окна", "дом", "компания", "ремонт", "Бетон", "стальных-дверей", "цех", "купить", "a1", "Казань", "Окнаплюс",
             "thereon", "Sale", "услуги", "доставка", "леса"]

    def text(most):
        return "".join(rnd.choice(words) + rnd.choice([" "] * 9 + [". ", "\n", "  "]) for _ in range(rnd.randrange(most)))

    rows = []
    for i in range(80):
        body = rnd.choice([text(4), text(30), text(30) + ".", "", f"<h2>{text(6)}</h2>{text(8)}",
                           f"<div><ul><li>{text(6)}</li><li>{text(5)}</li></ul></div>{text(3)}"])
        head = rnd.choice(["", f"<title>{text(4)}</title>", f"<meta name=description content='{text(12)}'>"])
        rows.append(page(i, body, rnd.choice(["okna.ru"] * 4 + ["b.ru", "montazh.ru"]), head))
    got, want = profiles(spark, rows), joined(spark, rows)
    for site in want:
        for c in ("title", "offerings", "industry_keywords", "queries", "geo_cities", "business_model", "audience", "pages_surveyed"):
            assert got[site][c] == want[site][c], (site, c)


def cut_over_edges(texts, parts):
    """Phrases of the texts of one site, read in ranges of the given sizes."""
    rows, at = [], 0
    for k, n in enumerate(parts):
        reader = SP._Reader(k)
        for t in texts[at:at + n]:
            reader.page("s", t)
        reader.end()
        rows += reader.rows
        at += n
    out = [(r["ord"], i, p) for r in rows if r["kind"] == SP._PAGE for i, p in zip(r["inner_at"], r["inner"])]
    out += [(r["ord"], r["pos"], r["phrase"]) for r in rows if r["kind"] == SP._EDGE]
    return out, [r for r in rows if r["kind"] in (SP._HEAD, SP._EXIT)]


@pytest.mark.parametrize("seed", range(20))
def test_phrases_over_edges(seed):
    """All phrases, not only the first ones, against one search over the joined text."""
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(["слово", "другое-слово", "эти", "дома,", "конец."] if rnd.random() < .3 else ["слово", "третье"])
                      for _ in range(rnd.choice([0, 1, 2, 5, 9]))) for _ in range(30)]
    low = "\n".join(texts)
    want = [p for p in re.findall(P._BODY_PHRASE, low) if 18 <= len(p) <= 65]
    late = []
    found, open_ends = cut_over_edges(texts, [1, 4, 0, 7, 2, 16])
    SP._close_ranges(open_ends, lambda site, at, pos, phrase: late.append((at, pos, phrase)))
    assert [p for _, _, p in sorted(found + late) if 18 <= len(p) <= 65] == want
