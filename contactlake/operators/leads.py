"""Lead rows: build, fill from catalogues, deduplicate, resume."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.phone import RU, NumberingPlan, is_valid
from contactlake.functions.text import hit_blob
from contactlake.operators.classify import detect_region
from contactlake.operators.contacts import pick_phones, primary_secondary, text_contacts
from contactlake.operators.containment import first_containing

LEAD_COLUMNS = (
    "brief_id", "ord", "site", "name", "offer", "region", "phones", "p1", "p2", "p1_type", "p2_type",
    "p1_valid", "p2_valid", "source", "status", "crawl_status",
)


def _offer(snippet: Column, engines: Column) -> Column:
    cut = F.nullif(F.substring(snippet, 1, 160), F.lit(""))
    return F.coalesce(cut, F.substring(F.concat(F.lit("Выдача "), F.array_join(engines, "/")), 1, 200))


def build_leads(candidates: DataFrame, sites: DataFrame, policy: Column | str = "business",
                plan: NumberingPlan = RU, region_names=None) -> DataFrame:
    """Candidate rows joined with what their site gave.

    ``candidates``: brief_id, ord, domain, title, snippet, engines, queries;
    ``sites``: site, title, contacts (``crawl_results``), and crawl_depth where candidates
    have one.  A site without numbers falls back to numbers in its own search text.
    """
    c = F.col
    by = ["domain"] + [k for k in ("crawl_depth",) if k in sites.columns]
    found = sites.withColumnRenamed("site", "domain").select(
        *by, c("title").alias("site_title"), c("contacts").alias("site_contacts"))
    joined = candidates.join(found, by, "left")
    with_text = text_contacts(
        joined, F.trim(hit_blob(c("title"), c("snippet"))), "snippet", plan, out="text_contacts")
    has_site = F.coalesce(F.size("site_contacts") > 0, F.lit(False))
    picked = (
        with_text.withColumn("from_site", has_site)
        .withColumn("used", F.when(has_site, c("site_contacts")).otherwise(c("text_contacts")))
        .withColumn("phones", pick_phones(c("used"), policy, plan))
    )
    region_text = hit_blob(c("title"), c("snippet"), queries=c("queries"))
    from_text = F.col("p1").isNotNull() & ~c("from_site")
    return (
        picked.select("*", *primary_secondary("phones", plan))
        .select(
            "brief_id", "ord", c("domain").alias("site"),
            F.substring(F.coalesce(F.nullif("site_title", F.lit("")), F.nullif("title", F.lit("")), "domain"),
                        1, 120).alias("name"),
            _offer(c("snippet"), c("engines")).alias("offer"),
            detect_region(region_text, region_names).alias("region"),
            "phones", "p1", "p2", "p1_type", "p2_type",
            F.coalesce(is_valid(c("p1"), plan) | c("p1").isNull(), F.lit(True)).alias("p1_valid"),
            F.coalesce(is_valid(c("p2"), plan) | c("p2").isNull(), F.lit(True)).alias("p2_valid"),
            F.when(c("from_site"), V.SOURCE_SITE).otherwise(V.SOURCE_SEARCH).alias("source"),
            F.when(c("p1").isNotNull(), V.STATUS_FOUND).otherwise(V.STATUS_NO_PHONE).alias("status"),
            F.when(from_text | c("site_title").isNotNull(), "success").otherwise("error").alias("crawl_status"),
        )
    )


def fill_from_catalogs(leads: DataFrame, catalog_pages: DataFrame, policy: Column | str = "business",
                       plan: NumberingPlan = RU, guide: str = V.GUIDE_MARK) -> DataFrame:
    """Leads without a number take those of the first catalogue page that names their site.

    ``catalog_pages``: brief_id, url, body, contacts.  A page names a site when its text
    contains the first label of the host (the full host contains that label too).
    """
    pages = (
        catalog_pages.withColumn("picked", pick_phones(F.col("contacts"), policy, plan))
        .where(F.size("picked") > 0)
        .select("brief_id", "url", F.lower("body").alias("text"), "picked")
    )
    label = F.split_part(F.lower("site"), F.lit("."), F.lit(1))
    needy = leads.where(F.col("p1").isNull()).select("brief_id", label.alias("needle"))
    named = first_containing(pages, needy, by=["brief_id"], key="url").join(
        pages.select("brief_id", "url", "picked"), ["brief_id", "url"])
    filled = (
        leads.withColumn("needle", F.when(F.col("p1").isNull(), label))
        .join(named, ["brief_id", "needle"], "left")
    )
    hit = F.col("picked").isNotNull()
    types = primary_secondary("phones", plan)
    origin = F.when(F.contains("url", F.lit(guide)), V.SOURCE_GUIDE).otherwise(V.SOURCE_CATALOG)
    return (
        filled.withColumn("phones", F.coalesce("picked", "phones"))
        .withColumn("source", F.when(hit, origin).otherwise(F.col("source")))
        .withColumn("status", F.when(hit, V.STATUS_FOUND).otherwise(F.col("status")))
        .drop("p1", "p2", "p1_type", "p2_type")
        .select("*", *types)
        .select(*[c for c in leads.columns])
    )


def dedupe_leads(leads: DataFrame) -> DataFrame:
    """First row per site; then rows whose only number an earlier row already has are dropped.

    A dropped row brings no new number, so "seen on an earlier kept row" equals "first
    seen at a smaller position", which is one aggregate instead of a loop.
    """
    c = F.col
    rest = [x for x in leads.columns if x not in ("brief_id", "site", "ord")]
    first = (
        leads.groupBy("brief_id", F.lower("site").alias("site_key"))
        .agg(F.min_by(F.struct("ord", "site", *rest), "ord").alias("r"))
        .select("brief_id", "r.*")
    )
    seen = (
        first.select("brief_id", "ord", F.explode(F.array("p1", "p2")).alias("phone"))
        .where(F.coalesce(c("phone"), F.lit("")) != "")
        .groupBy("brief_id", "phone").agg(F.min("ord").alias("first_ord"))
    )
    single = (F.coalesce(c("p1"), F.lit("")) != "") & (F.coalesce(c("p2"), F.lit("")) == "")
    repeated = (
        first.where(single).select("brief_id", "ord", c("p1").alias("phone"))
        .join(seen, ["brief_id", "phone"]).where(c("first_ord") < c("ord"))
        .select("brief_id", "ord")
    )
    return first.join(repeated, ["brief_id", "ord"], "left_anti").select(*leads.columns)


def not_yet_done(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Resume: candidates whose site has no result row yet."""
    done = results.select("brief_id", F.lower("site").alias("site_key"))
    return (
        candidates.withColumn("site_key", F.lower("domain"))
        .join(done, ["brief_id", "site_key"], "left_anti").drop("site_key")
    )
