"""Page parsing, rules: column expressions over flat pages.

What a footer is, which links count, what a heading is worth: all of it is an expression
over the flat form made by ``flatten_pages``, so a change of rule never touches the pass.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.phone import (
    RU, NumberingPlan, normalize_phone, phone_hint, phone_type, phones_after_words, phones_in_text,
)
from contactlake.operators.flatten import FLAT_COLUMNS, FLAT_SCHEMA, flatten_pages


# --- expressions over the flat form ---------------------------------------------------

def _span(n: Column, sep: str = " ") -> Column:
    return F.array_join(F.slice(F.col("strings"), n["s"] + 1, n["e"] - n["s"]), sep)


def _nodes(*tags: str) -> Column:
    return F.filter("nodes", lambda n: n["tag"].isin(*tags))


def _segment(source: Column, kind: str, value: Column) -> Column:
    return F.struct(source.alias("source"), F.lit(kind).alias("kind"), value.alias("value"))


def _call_links(links: Column, source) -> Column:
    """tel: and callto: targets of links that are not messenger links."""
    found = F.filter(
        links, lambda k: k["href"].rlike(r"(?i)^(tel|callto):") & ~k["href"].rlike(V.MESSENGER_LINKS)
    )
    return F.transform(found, lambda k: _segment(
        source(F.lower(F.regexp_extract(k["href"], "^([a-zA-Z]+):", 1))), "number",
        F.regexp_replace(k["href"], r"^[a-zA-Z]+:", "")))


def _block_segments(nodes: Column, source) -> Column:
    """Text of each block followed by its call links."""
    return F.flatten(F.transform(nodes, lambda n: F.concat(
        F.array(_segment(source(n), "text", _span(n))),
        _call_links(F.slice(F.col("links"), n["ls"] + 1, n["le"] - n["ls"]),
                    lambda _: F.concat(source(n), F.lit("-tel"))),
    )))


def contact_segments() -> Column:
    """The nine channels in extraction order as array<struct<source, kind, value>>."""
    def footer_like(n: Column) -> Column:
        return n["tag"].isin("div", "section", "aside") & (
            (F.lower(n["role"]) == "contentinfo") | n["cls"].rlike(V.FOOTER_HINTS)
            | F.coalesce(n["id"].rlike(V.FOOTER_HINTS), F.lit(False)))

    marked = F.flatten(F.transform(F.filter("nodes", lambda n: n["phone"]), lambda n: F.concat(
        F.array(_segment(F.lit("header-class"), "text", _span(n))),
        F.transform(n["data"], lambda d: _segment(F.lit("data-attr"), "text", d)))))
    metas = F.filter("metas", lambda m: F.contains(
        F.lower(F.coalesce(F.nullif(m["name"], F.lit("")), m["property"], F.lit(""))), F.lit("phone")))
    body = F.array_join("strings", "\n")
    return F.concat(
        _block_segments(_nodes("header"), lambda n: n["tag"]),
        _block_segments(_nodes("nav"), lambda n: n["tag"]),
        marked,
        _block_segments(_nodes("footer"), lambda n: F.lit("footer")),
        _block_segments(F.filter("nodes", lambda n: F.coalesce(footer_like(n), F.lit(False))),
                        lambda n: F.lit("footer")),
        F.transform(F.filter("ld", lambda x: x["kind"] == "phone"),
                    lambda x: _segment(F.lit("json-ld"), "number", x["value"])),
        F.transform(metas, lambda m: _segment(F.lit("meta"), "number", m["content"])),
        _call_links(F.col("links"), lambda scheme: scheme),
        F.array(_segment(F.lit("text"), "text", body), _segment(F.lit("context"), "context", body)),
    )


def mentions(segments: Column, plan: NumberingPlan = RU, strict: bool = False) -> Column:
    """Allowed numbers of all segments in order, repeats kept: array<struct<source, phone>>."""
    def numbers(g: Column) -> Column:
        single = F.filter(F.array(normalize_phone(g["value"], plan)), lambda p: p.isNotNull())
        return (
            F.when(g["kind"] == "text", phones_in_text(g["value"], plan, strict))
            .when(g["kind"] == "context", phones_after_words(g["value"], plan))
            .otherwise(single)
        )

    return F.flatten(F.transform(
        segments, lambda g: F.transform(numbers(g), lambda p: F.struct(
            g["source"].alias("source"), p.alias("phone")))))


def first_mentions(df: DataFrame, found: str, out: str = "contacts", plan: NumberingPlan = RU) -> DataFrame:
    """First mention of each number within the row, in order.

    ``found`` (array<struct<source, phone>>) is replaced by ``out``
    (array<struct<ord, phone, type, source>>).  Sort, keep the head of each run, sort back.
    """
    numbered = F.transform(F.col(found), lambda m, i: F.struct(
        m["phone"].alias("phone"), i.alias("ord"), m["source"].alias("source")))
    heads = F.filter(F.col("_runs"), lambda m, i: (i == 0) | (
        F.get(F.col("_runs"), i - 1)["phone"] != m["phone"]))
    ordered = F.array_sort(F.transform(heads, lambda m: F.struct(
        m["ord"].alias("ord"), m["phone"].alias("phone"), m["source"].alias("source"))))
    return (
        df.withColumn("_runs", F.array_sort(numbered))
        .withColumn(out, F.transform(ordered, lambda m, i: F.struct(
            i.alias("ord"), m["phone"].alias("phone"),
            phone_type(m["phone"], plan).alias("type"), m["source"].alias("source"))))
        .drop("_runs", found)
    )


def page_contacts(pages: DataFrame, plan: NumberingPlan = RU, strict: bool = False) -> DataFrame:
    """``pages`` without html, plus title, body text and ``contacts`` per page."""
    flat = flatten_pages(pages)
    keep = [c for c in pages.columns if c != "html"]
    found = flat.select(
        *keep, page_title().alias("title"), F.array_join("strings", "\n").alias("body"),
        mentions(contact_segments(), plan, strict).alias("found"),
    )
    return first_mentions(found, "found", plan=plan)


def contact_rows(contacts: DataFrame, *keys: str) -> DataFrame:
    """Normal form: one row per (page, phone) with its source rank.

    The outer form keeps the optimizer from inferring a size filter, which it would push
    down as a second evaluation of the whole extraction.
    """
    rows = contacts.select(*keys, F.inline_outer("contacts")).where(F.col("phone").isNotNull())
    return rows.withColumn("source_rank", source_rank(F.col("source")))


def source_rank(source: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in V.SOURCE_RANK.items() for x in kv])
    low = F.lower(source)
    return F.coalesce(F.try_element_at(ranks, low), F.when(low.endswith("-tel"), 2), F.lit(9))


def with_phone_flag(pages: DataFrame, plan: NumberingPlan = RU, out: str = "has_phone") -> DataFrame:
    """Whether a page holds a number: the cheap hint first, the full extraction only where it misses.

    A page with the hint enters the Arrow pass with NULL instead of its html, so it is
    scanned once and not parsed; the html column itself is dropped.
    """
    keep = [c for c in pages.columns if c != "html"]
    hinted = pages.withColumn("_hint", phone_hint(F.col("html"), plan)).withColumn(
        "html", F.when(~F.col("_hint"), F.col("html")))
    found = flatten_pages(hinted).select(*keep, "_hint", mentions(contact_segments(), plan).alias("_found"))
    return found.select(*keep, (F.col("_hint") | (F.size("_found") > 0)).alias(out))


# --- content and identity ----------------------------------------------------------------

def page_title() -> Column:
    """``<title>`` when it holds a single string, else the first ``h1``."""
    title = F.get(_nodes("title"), F.lit(0))
    h1 = F.get(_nodes("h1"), F.lit(0))
    named = F.when(title["e"] - title["s"] == 1, _span(title))
    return F.coalesce(named, _span(h1, ""), F.lit(""))


def _with_noscript(body) -> Column:
    """``body`` of the test whether a string lies outside all noscript blocks, which are looked up once."""
    blocks = F.transform(_nodes("noscript"), lambda n: F.struct(n["s"].alias("s"), n["e"].alias("e")))
    return F.get(F.transform(F.array(blocks), lambda bs: body(
        lambda at: ~F.exists(bs, lambda n: (at >= n["s"]) & (at < n["e"])))), F.lit(0))


def visible_text(limit: int | None = None) -> Column:
    """Text outside noscript blocks, whole or its first ``limit`` characters."""
    text = F.array_join(_with_noscript(lambda outside: F.filter("strings", lambda t, i: outside(i))), "\n")
    return text if limit is None else F.substring(text, 1, limit)


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def headings(limit: int | None = 30) -> Column:
    """h1..h3 with text: array<struct<level, text>>."""
    kept = _with_noscript(lambda outside: F.filter(
        _nodes("h1", "h2", "h3"), lambda n: (n["e"] > n["s"]) & outside(n["s"])))
    found = F.transform(kept, lambda n: F.struct(n["tag"].alias("level"), _span(n).alias("text")))
    return _first(found, limit)


def list_items(limit: int | None = 40) -> Column:
    """Text of list items in content blocks, each item once, 10 to 90 characters."""
    texts = F.transform(F.filter(_nodes("li"), lambda n: n["listed"]), lambda n: _span(n))
    return _first(F.filter(texts, lambda t: F.length(t).between(10, 90)), limit)


def meta_description(limit: int | None = 500) -> Column:
    """First filled one of description, og:description, twitter:description."""
    def first(test) -> Column:
        return F.nullif(F.get(F.filter("metas", test), F.lit(0))["content"], F.lit(""))

    text = F.coalesce(
        first(lambda m: m["name"] == "description"),
        first(lambda m: m["property"] == "og:description"),
        first(lambda m: m["name"] == "twitter:description"), F.lit(""))
    return F.trim(text) if limit is None else F.substring(F.trim(text), 1, limit)


def ld_values(kind: str, limit: int | None) -> Column:
    return _first(F.transform(F.filter("ld", lambda x: x["kind"] == kind), lambda x: x["value"]), limit)


def nav_labels(limit: int = 30) -> Column:
    blocks = F.slice(_nodes("nav", "header"), 1, 4)
    labels = F.flatten(F.transform(blocks, lambda n: F.transform(
        F.slice(F.col("links"), n["ls"] + 1, F.least(n["le"] - n["ls"], F.lit(40))), lambda k: _span(k))))
    return F.slice(F.filter(labels, lambda t: t != ""), 1, limit)


def footer_text(limit: int | None = 2500) -> Column:
    text = _span(F.get(_nodes("footer"), F.lit(0)), "\n")
    return F.coalesce(text if limit is None else F.substring(text, 1, limit), F.lit(""))


def brand_hints(limit: int | None = 20, logos: int | None = 6) -> Column:
    names = F.transform(
        F.filter("metas", lambda m: F.lower(F.coalesce(
            F.nullif(m["property"], F.lit("")), m["name"], F.lit(""))).isin(
                "og:site_name", "application-name", "twitter:title")),
        lambda m: F.trim(m["content"]))
    short = F.filter(F.transform("images", lambda t: F.trim(t)), lambda t: (F.length(t) > 3) & (F.length(t) < 80))
    marked = F.filter(
        F.transform(_first(F.filter("links", lambda k: k["logo"]), logos), lambda k: _span(k)),
        lambda t: (F.length(t) > 3) & (F.length(t) < 80))
    return _first(F.concat(F.filter(names, lambda t: t != ""), short, marked), limit)


def page_content(flat: DataFrame, *keys: str) -> DataFrame:
    """Content and identity columns of each flat page."""
    return flat.select(
        *keys,
        page_title().alias("title"),
        visible_text(5000).alias("text"),
        headings().alias("headings"),
        list_items().alias("list_items"),
        meta_description().alias("meta_description"),
        ld_values("offering", 15).alias("schema_offerings"),
        nav_labels().alias("nav_labels"),
        footer_text().alias("footer_text"),
        brand_hints().alias("brand_hints"),
        ld_values("org", 5).alias("org_names"),
    )
