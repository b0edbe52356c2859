"""Hits -> candidates: first hits, grouping, rejection, live check, cut."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.lists import domain_list, query_list, region_list, seed_domains
from contactlake.functions.url import host
from contactlake.operators.classify import is_alive
from contactlake.operators.hits import (
    clamp, cut_candidates, first_hits, group_by_domain, hits_cap, with_reject_reason,
)


@dataclass
class CandidateJob:
    judged: DataFrame   # every candidate with its reject_reason
    chosen: DataFrame   # the cut list, with rank and pick


def brief_parameters(briefs: DataFrame) -> DataFrame:
    """Parsed briefs (brief_id, brief struct) -> the columns the jobs work with."""
    b = F.col("brief")
    quick = F.coalesce(b["quickCrawl"], F.lit(False))
    return briefs.select(
        "brief_id",
        host(F.coalesce(b["clientSite"], F.lit(""))).alias("client_domain"),
        domain_list(b["excludeDomains"]).alias("exclude_domains"),
        region_list(b["regions"]).alias("regions"),
        F.when(b["regionMode"] == "exclude", "exclude").otherwise("include").alias("region_mode"),
        query_list(b["queries"], quick=quick).alias("brief_queries"),
        seed_domains(b["seedDomains"], quick).alias("seeds"),
        F.coalesce(b["niche"], F.lit("")).alias("niche"),
        F.coalesce(b["phoneFilter"], F.lit("business")).alias("policy"),
        F.coalesce(b["checkAlive"], F.lit(True)).alias("check_alive"),
        clamp(b["maxSites"], V.MIN_SITES, V.MAX_SITES, V.DEFAULT_MAX_SITES).alias("max_sites"),
        clamp(b["crawlDepth"], V.MIN_DEPTH, V.MAX_DEPTH, V.DEFAULT_DEPTH).alias("crawl_depth"),
        F.when(F.size(b["sources"]) > 0, b["sources"]).otherwise(F.array(*map(F.lit, V.BRIEF_SOURCES))).alias("sources"),
    )


def seeded_candidates(params: DataFrame) -> DataFrame:
    """Quick mode: the brief's own sites are the candidates, ``max_sites`` of those not excluded."""
    seeds = params.select("*", F.posexplode("seeds").alias("at", "domain"))
    own = F.array_contains("exclude_domains", F.col("domain")) | (F.col("domain") == F.col("client_domain"))
    ord_ = F.row_number().over(Window.partitionBy("brief_id").orderBy("at"))
    return seeds.where(~own).withColumn("ord", ord_).where(F.col("ord") <= F.col("max_sites")).select(
        "brief_id", "ord", "domain", F.col("domain").alias("title"), F.lit(V.SEED_SNIPPET).alias("snippet"),
        F.array(F.concat(F.lit("https://"), "domain")).alias("urls"),
        F.array(F.lit("seed")).alias("engines"), F.array(F.lit("quick")).alias("queries"))


def searching(params: DataFrame) -> DataFrame:
    """The briefs that take their candidates from search hits."""
    return params.where((F.size("seeds") == 0) & F.array_contains("sources", "serp"))


def live_pages(pages: DataFrame) -> DataFrame:
    """url -> alive, from a page snapshot."""
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(None).cast("int")
    return pages.groupBy("url").agg(F.bool_or(is_alive(status, F.col("html"))).alias("alive"))


def candidate_job(hits: DataFrame, params: DataFrame, live: DataFrame | None,
                  largest_sites: int = V.MAX_SITES, **lists) -> CandidateJob:
    """``params``: one row per brief (``brief_parameters``); ``live``: url, alive.

    Every brief has its own hit cap, number of sites and live test; without ``live`` a brief
    that asks for the live test is an error, and so is one above ``largest_sites``, the
    literal bound that the group limits work with.  One shuffle by (brief, query, domain), one
    by (brief, domain); the brief columns ride along by an equi-join on brief_id that the
    optimizer broadcasts while briefs are few.  ``lists`` go to ``with_reject_reason``.
    """
    too_many = F.raise_error(F.concat(F.lit(f"more than {largest_sites} sites: brief "), F.col("brief_id")))
    params = searching(params).withColumn(
        "max_sites", F.when(F.col("max_sites") > largest_sites, too_many.cast("int")).otherwise(F.col("max_sites")))
    caps = params.select("brief_id", hits_cap(F.col("max_sites")).alias("hits_cap"))
    largest_cap = max(V.HITS_PER_QUERY_MIN, 3 * largest_sites)
    grouped = group_by_domain(first_hits(hits, largest_cap, caps))
    judged = with_reject_reason(grouped.join(params, "brief_id"), **lists)
    kept = judged.where(F.col("reject_reason").isNull())
    if live is not None:
        kept = kept.join(live.withColumnRenamed("url", "first_url"), "first_url", "left").withColumn(
            "alive", F.coalesce("alive", F.lit(False)))
    else:
        untested = F.raise_error(F.concat(F.lit("no live table for brief "), F.col("brief_id"))).cast("boolean")
        kept = kept.withColumn("alive", F.when(F.col("check_alive"), untested).otherwise(F.lit(True)))
    chosen = cut_candidates(kept, F.col("max_sites"), F.col("check_alive"), largest_sites)
    return CandidateJob(judged, chosen.withColumn("ord", F.col("pick")))
