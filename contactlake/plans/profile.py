"""Pages -> site profiles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.functions.url import host
from contactlake.operators.html import flatten_pages, page_content
from contactlake.operators.links import section_links
from contactlake.operators.profile import merge_pages, profile_sites
from contactlake.operators.siteprofile import site_profiles
from contactlake.sources.snapshot import has_page, pages_at


def survey_pages(pages: DataFrame) -> DataFrame:
    """Home page and up to four section pages of each site: site, visit, url, html.

    Sites are worked out from urls alone; html is joined by url, so over a snapshot (bucketed by
    url) it is read in place.
    """
    site = host(F.col("url")).alias("site")
    home_urls = pages.where(F.col("url").rlike(r"^[a-zA-Z]+://[^/?#]*/?$")).select("url", site).groupBy("site").agg(
        F.min("url").alias("url"))
    homes = has_page(pages, home_urls).select(site, "url", "html")
    sections = section_links(flatten_pages(homes))
    visits = home_urls.withColumn("visit", F.lit(0)).unionByName(
        sections.select("site", F.col("target").alias("url"), F.col("rank").alias("visit")))
    return pages_at(pages, visits)


def profile_job(visits: DataFrame) -> DataFrame:
    """``visits``: site, visit, html (``survey_pages`` or any page order per site)."""
    content = page_content(flatten_pages(visits.select("site", "visit", "html")), "site", "visit")
    return profile_sites(merge_pages(content))


def whole_profile_job(pages: DataFrame, *order: str) -> DataFrame:
    """Profiles over every page of a site and its whole texts.  ``pages``: site, html and the columns that order a site's
    pages, the first of which is its home page; pages alike in these follow the hash of their html."""
    o = F.struct(*order, F.xxhash64("html").alias("_tie"))
    return site_profiles(pages.select("site", o.alias("o"), "html"))
