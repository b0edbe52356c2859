"""Contacts per site: first mentions, the page that counts, the numbers to keep."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.phone import (
    RU, NumberingPlan, filter_by_policy, phone_type, phones_after_words, phones_in_text,
)
from contactlake.operators.html import first_mentions, source_rank

POLICIES = ("mobile", "city", "business", "no-800", "all")


def text_contacts(df: DataFrame, text: Column, source: str = "text", plan: NumberingPlan = RU,
                  strict: bool = False, out: str = "contacts") -> DataFrame:
    """Contacts of plain text: running numbers, then numbers announced by a word.  Narrow."""
    found = F.transform(
        F.concat(phones_in_text(text, plan, strict), phones_after_words(text, plan)),
        lambda p: F.struct(F.lit(source).alias("source"), p.alias("phone")))
    return first_mentions(df.withColumn("_found", found), "_found", out, plan)


def pick_phones(contacts: Column, policy: Column | str, plan: NumberingPlan = RU,
                threshold: int = V.PHONES_OVERFLOW_THRESHOLD,
                limit: int = V.PHONES_OVERFLOW_MOBILE_MAX) -> Column:
    """Numbers to keep from one row's contacts (array<struct<ord, phone, type, source>>).

    More than ``threshold`` numbers: mobiles only, best source first, at most ``limit``,
    whatever the policy.  Otherwise the policy decides, in order.
    """
    phones = F.transform(contacts, lambda c: c["phone"])
    mobiles = F.array_sort(F.transform(
        F.filter(contacts, lambda c: c["type"] == "mobile"),
        lambda c: F.struct(source_rank(c["source"]).alias("r"), c["ord"].alias("o"), c["phone"].alias("p"))))
    over = F.slice(F.transform(mobiles, lambda m: m["p"]), 1, limit)
    if isinstance(policy, str):
        kept = filter_by_policy(phones, policy, plan, fallback=True)
    else:
        kept = F.array().cast("array<string>")
        for name in POLICIES:
            kept = F.when(policy == name, filter_by_policy(phones, name, plan, fallback=True)).otherwise(kept)
    return F.when(F.size(contacts) > threshold, over).otherwise(kept)


def first_per_site(rows: DataFrame, *site: str) -> DataFrame:
    """First mention of each (site, phone); one hash aggregate with map-side combine."""
    return (
        rows.groupBy(*site, "phone")
        .agg(F.min("ord").alias("ord"), F.min_by(F.struct("type", "source"), "ord").alias("m"))
        .select(*site, "phone", "ord", "m.*")
        .withColumn("source_rank", source_rank(F.col("source")))
    )


def phone_counts(unique: DataFrame, kept: DataFrame, *site: str,
                 threshold: int = V.PHONES_OVERFLOW_THRESHOLD) -> DataFrame:
    """Unique and kept numbers per site, and whether the overflow rule applied."""
    raw = unique.groupBy(*site).agg(F.count("*").alias("raw_unique"))
    return raw.join(kept.select(*site, F.size("phones").alias("kept")), list(site), "left").select(
        *site, "raw_unique", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("raw_unique") > threshold).alias("overflow"))


def pick_by_site(unique: DataFrame, *site: str, policy: str = "business", plan: NumberingPlan = RU,
                 threshold: int = V.PHONES_OVERFLOW_THRESHOLD,
                 limit: int = V.PHONES_OVERFLOW_MOBILE_MAX) -> DataFrame:
    """The keeping rule for sites with any number of contact rows.

    Two top-k lists per site: the first threshold + 1 numbers (enough to tell overflow) and
    the best ``limit`` mobiles.  Each row is tagged for the lists it may enter and both are
    ranked in one pass, so the input is read once.  The group limit cuts every map
    partition, so no site brings more than a few rows per partition into one task.
    """
    tags = F.array(
        F.struct(F.lit("head").alias("list"), F.lit(0).alias("grade")),
        F.when(F.col("type") == "mobile", F.struct(F.lit("mobile").alias("list"), F.col("source_rank").alias("grade"))))
    order = Window.partitionBy(*site, "list").orderBy("grade", "ord", "phone")
    room = F.when(F.col("list") == "head", threshold + 1).otherwise(limit)
    ranked = (
        unique.select(*site, "phone", "ord", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("t"))
        .select(*site, "phone", "ord", "t.*")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= max(threshold + 1, limit)).where(F.col("n") <= room)
    )
    both = ranked.groupBy(*site).agg(
        F.count_if(F.col("list") == "head").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("list") == "head", F.struct("n", "phone")))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("list") == "mobile", F.struct("n", "phone")))).alias("mobile"),
    )
    kept = filter_by_policy(F.transform("head", lambda x: x["phone"]), policy, plan, fallback=True)
    return both.select(
        *site,
        F.when(F.col("n") > threshold, F.transform("mobile", lambda x: x["phone"])).otherwise(kept).alias("phones"),
        (F.col("n") > threshold).alias("overflow"),
    )


def primary_secondary(phones: str = "phones", plan: NumberingPlan = RU) -> list[Column]:
    """p1, p2 and their types; NULL where the list is shorter."""
    p1, p2 = F.get(F.col(phones), F.lit(0)), F.get(F.col(phones), F.lit(1))
    return [
        p1.alias("p1"), p2.alias("p2"),
        F.when(p1.isNotNull(), phone_type(p1, plan)).alias("p1_type"),
        F.when(p2.isNotNull(), phone_type(p2, plan)).alias("p2_type"),
    ]


def limit_visits(pages: DataFrame, max_pages: int, *order: str) -> DataFrame:
    """First ``max_pages`` pages per site in the given order, numbered from 0 (``visit``)."""
    w = Window.partitionBy("site").orderBy(*order)
    return (
        pages.withColumn("visit", F.row_number().over(w)).where(F.col("visit") <= max_pages)
        .withColumn("visit", F.col("visit") - 1)
    )


def one_per_visit(parsed: DataFrame, page_chars: int = 8000, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Of several addresses of one position (http and https, with and without www) the smallest url."""
    cut = parsed.withColumn("body", F.substring("body", 1, page_chars))
    return cut.groupBy(*keys, "visit").agg(
        F.min_by(F.struct("title", "body", "contacts"), "url").alias("p")).select(*keys, "visit", "p.*")


def crawl_results(parsed: DataFrame, page_chars: int = 8000, site_chars: int = 6000,
                  keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row per site: visiting stops at the first page with a number.

    ``parsed``: site, visit, title, body, contacts, already cut to the page budget, so a
    site has at most fifteen rows here and the sorted list is bounded.
    """
    visits = parsed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "visit", "title", F.substring("body", 1, page_chars).alias("body"), "contacts"))).alias("all"))
    with_phone = F.filter("all", lambda v: F.size(v["contacts"]) > 0)
    stop = F.get(with_phone, F.lit(0))["visit"]
    seen = F.filter("all", lambda v: F.col("stop").isNull() | (v["visit"] <= F.col("stop")))
    titles = F.filter("seen", lambda v: F.coalesce(v["title"], F.lit("")) != "")
    return (
        visits.withColumn("first", F.get(with_phone, F.lit(0)))
        .withColumn("stop", stop).withColumn("seen", seen)
        .select(
            *keys,
            F.col("stop").alias("found_at"),
            F.coalesce(F.get(titles, F.lit(0))["title"], F.lit("")).alias("title"),
            F.substring(F.array_join(F.transform("seen", lambda v: v["body"]), "\n"), 1, site_chars).alias("text"),
            F.size("seen").alias("pages"),
            F.coalesce(F.col("first.contacts"), F.array().cast(parsed.schema["contacts"].dataType)).alias("contacts"),
        )
    )
