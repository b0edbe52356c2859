"""Candidates + page snapshot -> lead rows; the full run over many briefs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.phone import RU, NumberingPlan
from contactlake.functions.url import host, path_of
from contactlake.operators.contacts import crawl_results, one_per_visit
from contactlake.operators.hits import catalog_urls
from contactlake.operators.html import page_contacts
from contactlake.operators.leads import build_leads, dedupe_leads, fill_from_catalogs
from contactlake.operators.flatten import flatten_pages
from contactlake.operators.links import page_budget, top_links, visit_order
from contactlake.plans.candidates import candidate_job, searching, seeded_candidates
from contactlake.session import stage
from contactlake.sources.readers import union_all
from contactlake.sources.snapshot import has_page, pages_at


PATHS = ("/",) + V.CONTACT_PATHS + V.ABOUT_PATHS
CLIENT_PATHS = ("/", "/contacts", "/kontakty")


def planned_visits(pages: DataFrame, depth: int = 2, paths: tuple[str, ...] = PATHS) -> DataFrame:
    """Pages on the fixed visiting path of each site, within the page budget.

    The budget counts positions of the path, so this is a filter on the url: no ranking,
    no join, and the html of other pages is never moved.
    """
    plain = ~F.col("url").rlike(r"[?#]")
    return (
        pages.where(plain).withColumn("site", host(F.col("url")))
        .withColumn("visit", visit_order(path_of(F.col("url")), paths))
        .where(F.col("visit") < page_budget(depth))
        .select("site", "visit", "url", "html")
    )


def deep_visits(pages: DataFrame, depth: int, sites: DataFrame | None = None) -> DataFrame:
    """Fixed path plus, where the budget allows (depth 4 and 5), links found on visited pages.

    Links queue up in visiting order, the best eight per page; a link without a snapshot
    page still uses up budget.  Each level keeps at most the free budget per site.  ``sites`` (site)
    picks the sites; urls are picked, and html is joined by url, where a snapshot has it in place.
    """
    fixed = planned_visits(pages, depth)
    if sites is not None:
        mine = stage(fixed.drop("html").join(sites.distinct(), "site", "left_semi"))
        fixed = pages_at(pages, mine).select(*fixed.columns)
    free = page_budget(depth) - len(PATHS)
    if free <= 0:
        return fixed
    known = stage(fixed.select("site", "url").distinct())
    frontier, found = fixed.where(F.col("visit") > 0), []
    queue = Window.partitionBy("site").orderBy("first")
    for level in range(1, depth - 1):
        targets = (
            top_links(flatten_pages(frontier)).groupBy("site", F.col("target").alias("url"))
            .agg(F.min(F.struct("visit", "rank")).alias("first"))
            .join(known, ["site", "url"], "left_anti")
            .withColumn("n", F.row_number().over(queue)).where(F.col("n") <= free)
            .select("site", "url", (F.lit(level * 100) + F.col("n")).alias("visit"))
        )
        fresh = stage(targets)
        known = known.unionByName(fresh.select("site", "url"))
        found.append(fresh)
        frontier = pages_at(pages, fresh).select("site", "visit", "url", "html")
    by_visit = Window.partitionBy("site").orderBy("visit")
    extra = pages_at(pages, union_all(found).withColumn("n", F.row_number().over(by_visit)).where(F.col("n") <= free)).select(
        "site", "visit", "url", "html")
    return fixed.unionByName(extra)


def client_summary(pages: DataFrame, plan: NumberingPlan = RU) -> DataFrame:
    """Short reading of client sites: title, text sample and numbers from home and contact pages."""
    parsed = page_contacts(planned_visits(pages, 1, CLIENT_PATHS), plan)
    return crawl_results(one_per_visit(parsed)).select(
        "site", "title", F.substring("title", 1, 200).alias("niche_hint"),
        F.substring("text", 1, 4000).alias("text_sample"),
        F.transform("contacts", lambda c: c["phone"]).alias("phones"), "pages")


def catalog_pages(hits: DataFrame, pages: DataFrame, plan: NumberingPlan = RU,
                  domains=V.CATALOG_DOMAINS) -> DataFrame:
    """Parsed catalogue pages per brief: brief_id, url, body, contacts."""
    urls = catalog_urls(hits, domains).select("brief_id", "url")
    named = has_page(pages.select("url", "html"), urls)
    parsed = page_contacts(named, plan)
    return urls.join(parsed.select("url", "body", "contacts"), "url")


def visits_of(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages to visit for each wanted (site, crawl_depth): site, crawl_depth, visit, url.

    Only urls are ranked and joined here; html is read once, later, for the urls that are left.
    """
    deepest = wanted.agg(F.max("crawl_depth")).first()[0] or 0
    fixed = planned_visits(pages, V.MAX_DEPTH).select("site", "visit", "url").join(wanted, "site")
    out = [fixed.where(F.col("visit") < page_budget(F.col("crawl_depth")))]
    for depth in range(1, deepest + 1):
        if page_budget(depth) > len(PATHS):
            sites = wanted.where(F.col("crawl_depth") == depth).select("site")
            out.append(deep_visits(pages, depth, sites).where(F.col("visit") >= 100)
                       .select("site", "visit", "url", F.lit(depth).alias("crawl_depth")))
    return union_all(out)


def finish_run(chosen: DataFrame, hits: DataFrame, pages: DataFrame, params: DataFrame, plan: NumberingPlan = RU,
               catalog_domains=V.CATALOG_DOMAINS, region_names=None) -> DataFrame:
    """Chosen candidates -> deduplicated lead rows, each brief by its own policy, depth and sources.

    Every page is parsed once, also for briefs of different depths.  The results of each
    phase are small (the sites of each brief, plus catalogue pages with a number) but are
    read several times by the next, so they are staged in the shared folder; a lost executor
    repeats one phase only.
    """
    by_brief = params.select("brief_id", "policy", "crawl_depth", "sources")
    picked = stage(
        chosen.select("brief_id", "ord", "domain", "title", "snippet", "engines", "queries").join(by_brief, "brief_id")
        .where(F.array_contains("sources", "site")).drop("sources"))
    visits = stage(visits_of(pages, picked.select(F.col("domain").alias("site"), "crawl_depth").distinct()))
    read = has_page(pages.select("url", "html"), visits)
    parsed = stage(page_contacts(read, plan).select("url", "title", "body", "contacts"))
    keys = ("site", "crawl_depth")
    sites = crawl_results(one_per_visit(parsed.join(visits, "url"), keys=keys), keys=keys)
    policy = F.col("policy")
    leads = stage(build_leads(picked, sites, policy, plan, region_names))
    filled = by_brief.where(F.array_contains("sources", "catalog")).select("brief_id", "policy")
    catalogs = stage(catalog_pages(hits, pages, plan, catalog_domains).join(filled, "brief_id"))
    return dedupe_leads(stage(fill_from_catalogs(leads, catalogs, policy, plan)))


def full_run(hits: DataFrame, params: DataFrame, pages: DataFrame, live: DataFrame | None, plan: NumberingPlan = RU,
             catalog_domains=V.CATALOG_DOMAINS, region_names=None, **lists) -> DataFrame:
    """Hits, briefs and pages -> deduplicated lead rows of every brief; quick briefs bring their own sites."""
    params = stage(params)  # a row a brief, read by every phase
    found = candidate_job(hits, params, live, **lists).chosen
    chosen = union_all([df.select("brief_id", "ord", "domain", "title", "snippet", "engines", "queries")
                        for df in (found, seeded_candidates(params))])
    searched = hits.join(searching(params).select("brief_id"), "brief_id", "left_semi")
    return finish_run(chosen, searched, pages, params, plan, catalog_domains, region_names)
