"""From search hits to an ordered, cut list of candidate sites."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.operators.classify import domain_class, hit_region_ok, is_catalog, is_junk, is_relevant
from contactlake.functions.text import hit_blob

HIT_FIELDS = ("url", "title", "snippet", "engine", "page", "source")


def hits_cap(max_sites: Column) -> Column:
    """Hits kept per query of a brief that wants ``max_sites`` sites."""
    return F.greatest(F.lit(V.HITS_PER_QUERY_MIN), max_sites * 3)


def probe_window(max_sites):
    """Candidates that are probed for a brief that wants ``max_sites`` sites."""
    if isinstance(max_sites, int):
        return max(max_sites + 20, max_sites * 14 // 10)
    return F.greatest(max_sites + 20, F.floor(max_sites * F.lit(1.4))).cast("int")


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    """The value within its bounds; nothing and zero mean the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))))


def union_hits(*sources: DataFrame) -> DataFrame:
    """Hits of several engines in one table; missing columns become NULL."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary hits, and for queries without any the first filled page of the fallback engine."""
    keys = ["brief_id", "query"]
    missing = fallback.join(primary.select(*keys).distinct(), keys, "left_anti")
    first_page = missing.groupBy(*keys).agg(F.min("page").alias("page"))
    return union_hits(primary, missing.join(first_page, [*keys, "page"], "left_semi"))


def first_hits(hits: DataFrame, cap: int | None = None, caps: DataFrame | None = None) -> DataFrame:
    """First hit per (brief, query, domain), in list order; ``caps`` (brief_id, hits_cap) bounds
    them per query of each brief, ``cap`` those of all.

    The first step is a hash aggregate with map-side combine, so a domain holding a
    third of all hits shrinks before the shuffle.  ``cap`` becomes a window group
    limit, which also cuts every map partition down to ``cap`` rows per query.
    """
    fields = [c for c in HIT_FIELDS if c in hits.columns]
    first = (
        hits.groupBy("brief_id", "query", "domain")
        .agg(F.min("pos").alias("pos"), F.min_by(F.struct(*fields), "pos").alias("h"))
    )
    order = Window.partitionBy("brief_id", "query").orderBy("pos")
    ranked = first.withColumn("rank_in_query", F.row_number().over(order))
    if cap is not None:
        ranked = ranked.where(F.col("rank_in_query") <= cap)
    if caps is not None:
        ranked = ranked.join(caps, "brief_id").where(F.col("rank_in_query") <= F.col("hits_cap"))
    return ranked.select("brief_id", "query", "domain", "pos", "h.*", "rank_in_query")


def group_by_domain(first: DataFrame) -> DataFrame:
    """One candidate per (brief, domain) from ``first_hits`` output.

    The arrays hold at most one entry per query of the brief.
    """
    def longest(c: str) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        return F.max_by(text, F.struct(F.length(text), -F.col("pos")))

    return (
        first.groupBy("brief_id", "domain")
        .agg(
            longest("title").alias("title"),
            longest("snippet").alias("snippet"),
            F.min_by("url", "pos").alias("first_url"),
            F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("hits"),
            F.array_sort(F.collect_set("engine")).alias("engines"),
            F.array_sort(F.collect_set("query")).alias("queries"),
        )
        .withColumn("urls", F.transform("hits", lambda h: h["url"]))
        .drop("hits")
    )


def hit_stats(first: DataFrame, params: DataFrame) -> DataFrame:
    """Kept hits and distinct domains of ``first_hits``, and queries asked, of every brief."""
    small = first.groupBy("brief_id", "domain").agg(F.count("*").alias("n"))
    counted = small.groupBy("brief_id").agg(F.sum("n").alias("raw_hits"), F.count("*").alias("unique_domains"))
    return params.select("brief_id", F.size("brief_queries").cast("long").alias("queries")).join(
        counted, "brief_id", "left").select(
        "brief_id", F.coalesce("raw_hits", F.lit(0)).alias("raw_hits"),
        F.coalesce("unique_domains", F.lit(0)).alias("unique_domains"), "queries")


def query_errors(responses: DataFrame) -> DataFrame:
    """``query: message`` of failed searches, one row each (``error`` not NULL)."""
    return responses.where(F.col("error").isNotNull()).select(
        "brief_id", F.concat_ws(": ", "query", "error").alias("error")
    )


def catalog_urls(hits: DataFrame, domains=V.CATALOG_DOMAINS) -> DataFrame:
    """Catalogue domain -> url of its last hit, per brief."""
    return (
        hits.where(is_catalog(F.col("domain"), domains))
        .groupBy("brief_id", "domain").agg(F.max_by("url", "pos").alias("url"))
    )


def with_reject_reason(candidates: DataFrame, aggregators=V.AGGREGATOR_DOMAINS, regions: dict | None = None,
                       junk: dict | None = None, **relevance) -> DataFrame:
    """First failing test of each candidate; NULL for the survivors.

    Needs the brief's columns next to the candidate's: ``client_domain``,
    ``exclude_domains``, ``regions``, ``region_mode``, ``brief_queries``, ``niche``.
    ``regions``, ``junk`` and ``relevance`` are word lists of the three tests.
    """
    c = F.col
    region_text = hit_blob(c("title"), c("snippet"), queries=c("queries"))
    reason = (
        F.when(domain_class(c("domain"), c("exclude_domains"), c("client_domain"), aggregators)
               != V.STATUS_CANDIDATE, "excluded")
        .when(~hit_region_ok(region_text, c("regions"), c("region_mode"), **(regions or {})), "region")
        .when(~is_relevant(c("domain"), c("title"), c("snippet"), c("queries"), c("brief_queries"), c("niche"),
                           junk=is_junk(c("domain"), c("title"), c("snippet"), **(junk or {})), **relevance),
              "irrelevant")
    )
    return candidates.withColumn("reject_reason", reason)


def reject_counts(judged: DataFrame) -> DataFrame:
    return (
        judged.groupBy("brief_id", F.coalesce("reject_reason", F.lit("kept")).alias("reason"))
        .agg(F.count("*").alias("n"))
    )


def candidate_order() -> list[Column]:
    return [F.size("queries").desc(), F.col("domain").asc()]


def cut_candidates(candidates: DataFrame, max_sites: Column, check_alive: Column,
                   largest_sites: int | None = None) -> DataFrame:
    """Keep ``max_sites`` candidates per brief, live ones of the probe window first.

    Needs ``alive``.  The probe window is the first ``max(n + 20, floor(1.4 n))``
    candidates.  Its live ones are taken in order; what is missing comes unprobed from
    behind the window.  No more than window + n rows per brief can matter; when no
    ``max_sites`` is above ``largest_sites`` that is a group limit on every map partition.
    """
    window_size = probe_window(max_sites)
    by_brief = Window.partitionBy("brief_id")
    ranked = candidates.withColumn("rank", F.row_number().over(by_brief.orderBy(*candidate_order())))
    if largest_sites is not None:
        ranked = ranked.where(F.col("rank") <= probe_window(largest_sites) + largest_sites)
    ranked = (
        ranked.where(F.col("rank") <= window_size + max_sites)
        .withColumn("in_probe", check_alive & (F.col("rank") <= window_size))
        .withColumn("tier", F.when(~check_alive | (F.col("in_probe") & F.col("alive")), 0)
                    .when(~F.col("in_probe"), 1))
        .where("tier is not null")
    )
    return (
        ranked.withColumn("pick", F.row_number().over(by_brief.orderBy("tier", "rank")))
        .where(F.col("pick") <= max_sites)
        .drop("tier")
    )


def probe_counts(candidates: DataFrame, max_sites: Column, largest_sites: int | None = None) -> DataFrame:
    """Checked / alive / dead within each brief's probe window."""
    order = Window.partitionBy("brief_id").orderBy(*candidate_order())
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    if largest_sites is not None:
        ranked = ranked.where(F.col("rank") <= probe_window(largest_sites))
    return (
        ranked.where(F.col("rank") <= probe_window(max_sites))
        .groupBy("brief_id")
        .agg(F.count("*").alias("checked"), F.count_if("alive").alias("alive"),
             F.count_if(~F.col("alive")).alias("dead"))
    )
