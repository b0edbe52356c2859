"""Phones in texts and pages, urls and links."""
from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from contactlake.functions.phone import (
    NANP, RU, filter_by_policy, format_display, invalid_reason, is_valid, phone_hint, phone_type,
)
from contactlake.functions.url import clean_site_input, host, host_without_port, normalize_url
from contactlake.operators import html as H
from contactlake.operators.contacts import (
    crawl_results, first_per_site, limit_visits, phone_counts, pick_by_site, primary_secondary, text_contacts,
)
from contactlake.operators.links import expand_frontier, page_links, section_links, top_links
from contactlake.session import shared_dir, stage
from contactlake.sources.snapshot import pages_at, read_snapshot, write_snapshot
from workload.common import (
    HITS_SQL, PLAIN_TEXT_SQL, contacts_sql, documents, hits, host_sql, pages, q, table, type_sql,
)

RU_TRUNK = replace(RU, bare_run=None)
LINK_HINTS = r"(?i)(tion|unge|que)"


def _doc_contacts(spark, sf_dir, plan=NANP):
    return text_contacts(documents(spark, sf_dir).select("doc_id", "source", "lang", "text"), F.col("text"), plan=plan)


def _doc_rows(spark, sf_dir, site, plan=NANP):
    rows = _doc_contacts(spark, sf_dir, plan).select("doc_id", F.col(site).alias("site"), F.inline_outer("contacts")).where(F.col("phone").isNotNull())
    return rows.withColumn("ord", F.col("doc_id") * 1000 + F.col("ord"))


def q_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", host(F.col("url")).alias("host"), host_without_port(F.col("url")).alias("bare_host"))


def q_url_normal(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", normalize_url(u).alias("url_normal"),
        normalize_url(F.lit("../a/./b?c=1#x"), u).alias("up"),
        normalize_url(F.lit("/root"), u).alias("rooted"),
        normalize_url(F.lit("//Other.example.com"), u).alias("other"))


def q_contacts_text(spark, sf_dir):
    return _doc_contacts(spark, sf_dir).select("doc_id", F.inline_outer("contacts")).where(
        F.col("phone").isNotNull()).select("doc_id", "ord", "phone", "type")


def q_contacts_text_trunk(spark, sf_dir):
    return _doc_contacts(spark, sf_dir, RU_TRUNK).select("doc_id", F.inline_outer("contacts")).where(
        F.col("phone").isNotNull()).select("doc_id", "ord", "phone", "type")


def q_contacts_html(spark, sf_dir):
    contacts = H.page_contacts(pages(spark, sf_dir).select("page_id", "html"), NANP)
    return H.contact_rows(contacts, "page_id").select(
        "page_id", "phone", "type",
        F.when(F.col("source").isin("footer", "nav", "header"), F.col("source")).otherwise("body").alias("zone"))


def q_phone_policy(spark, sf_dir):
    phones = F.transform("contacts", lambda c: c["phone"])
    return _doc_contacts(spark, sf_dir).where(F.size("contacts") > 0).select(
        "doc_id", *[
            F.array_join(filter_by_policy(phones, p, NANP, fallback=(p == "mobile")), ",").alias(p.replace("-", "_"))
            for p in ("mobile", "city", "business", "no-800", "all")])


def q_phone_display(spark, sf_dir):
    raw = F.explode(F.regexp_extract_all("text", F.lit(r"([0-9][0-9() \-]{8,16}[0-9])"), F.lit(1)))
    p = F.col("raw")
    digits = F.regexp_replace(p, "[^0-9]+", "")
    return documents(spark, sf_dir).select("doc_id", raw.alias("raw")).select(
        "doc_id", "raw", format_display(p, NANP).alias("shown"), phone_type(digits, RU).alias("ru_type"),
        is_valid(digits, RU).alias("ru_valid"), invalid_reason(digits, RU).alias("ru_reason"))


def q_primary_phones(spark, sf_dir):
    picked = pick_by_site(first_per_site(_doc_rows(spark, sf_dir, "source"), "site"), "site", plan=NANP)
    return picked.select("site", *primary_secondary("phones", NANP))


def q_phone_overflow(spark, sf_dir):
    unique = stage(first_per_site(_doc_rows(spark, sf_dir, "lang"), "site"))
    kept = pick_by_site(unique, "site", plan=NANP, threshold=2, limit=2)
    counts = phone_counts(unique, kept, "site", threshold=2)
    return counts.join(kept.select("site", F.array_join("phones", ",").alias("phones")), "site").select(
        "site", "raw_unique", F.col("kept").cast("bigint").alias("kept"), "overflow", "phones")


def q_phone_hint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", phone_hint(F.col("html"), NANP).alias("hint_nanp"), phone_hint(F.col("html"), RU).alias("hint_ru"))


def q_phone_flag(spark, sf_dir):
    return H.with_phone_flag(pages(spark, sf_dir).select("page_id", "html"), NANP)


def q_first_contact_page(spark, sf_dir):
    sited = pages(spark, sf_dir).withColumn("site", host(F.col("url")))
    parsed = H.page_contacts(limit_visits(sited, 6, "page_id").select("site", "visit", "html"), NANP)
    return crawl_results(parsed).select(
        "site", "found_at", "title", "pages", F.size("contacts").alias("n_phones"),
        F.array_join(F.transform("contacts", lambda c: c["phone"]), ",").alias("phones"))


def q_snippet_fallback(spark, sf_dir):
    """Numbers of the page, else those of the document of the same number."""
    site = H.page_contacts(pages(spark, sf_dir).select("page_id", "html"), NANP).select("page_id", F.col("contacts").alias("site_contacts"))
    texts = _doc_contacts(spark, sf_dir).select("doc_id", "contacts")
    joined = site.join(texts, site.page_id == texts.doc_id, "left")
    has_site = F.size("site_contacts") > 0
    used = F.when(has_site, F.col("site_contacts")).otherwise(
        F.coalesce("contacts", F.array().cast(texts.schema["contacts"].dataType)))
    return joined.withColumn("used", used).select(
        "page_id", F.array_join(F.array_sort(F.transform("used", lambda c: c["phone"])), ",").alias("phones"),
        F.when(has_site, "page").when(F.size("used") > 0, "snippet").otherwise("none").alias("origin"))


def q_links(spark, sf_dir):
    flat = H.flatten_pages(pages(spark, sf_dir))
    return page_links(flat).select("page_id", "pos", "target", "same_host")


def q_links_top(spark, sf_dir):
    flat = H.flatten_pages(pages(spark, sf_dir))
    return top_links(flat, k=3, hints=LINK_HINTS).select("page_id", "rank", "target", "score")


def q_section_links(spark, sf_dir):
    sited = pages(spark, sf_dir).withColumn("site", host(F.col("url")))
    return section_links(H.flatten_pages(sited.select("site", "url", "html")), hints=LINK_HINTS)


def q_frontier(spark, sf_dir):
    """Two steps from the first page of each site over the links of the snapshot."""
    sited = pages(spark, sf_dir).withColumn("site", host(F.col("url"))).withColumn("url", normalize_url(F.col("url")))
    best = top_links(H.flatten_pages(sited.select("site", "url", "html")), hints=LINK_HINTS).select("site", "url", "target")
    seeds = sited.groupBy("site").agg(F.min_by("url", "page_id").alias("url"))
    return expand_frontier(best, seeds, 2)


def q_snapshot_lookup(spark, sf_dir):
    """Pages of all hit urls, looked up in a snapshot bucketed by url."""
    name = uuid.uuid4().hex
    write_snapshot(table(spark, sf_dir, "pages").select("url", "html"), f"pages_{name}", f"{shared_dir(spark)}/pages-{name}")
    urls = hits(spark, sf_dir).groupBy("url").agg(F.count("*").alias("n_hits"))
    return pages_at(read_snapshot(spark, f"pages_{name}"), urls).select(
        "url", "n_hits", F.octet_length("html").cast("long").alias("html_bytes"))


def q_site_input(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    prose = F.concat(F.lit("See <"), "url", F.lit(">, or write."))
    bare = F.concat(F.lit("/"), host(F.col("url")), F.lit("/Path;x."))
    return p.select("page_id", clean_site_input(prose).alias("from_prose"), clean_site_input(bare).alias("from_bare"),
                    clean_site_input(F.lit("no site here")).alias("none"))


QUERIES = {f.__name__: f for f in (
    q_host, q_url_normal, q_contacts_text, q_contacts_text_trunk, q_contacts_html, q_phone_policy,
    q_phone_display, q_primary_phones, q_phone_overflow, q_phone_hint, q_phone_flag, q_first_contact_page,
    q_snippet_fallback, q_links, q_links_top, q_section_links, q_frontier, q_snapshot_lookup, q_site_input)}

_ORIGIN = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"
_NORMAL = (f"split_part(url, '://', 1) || '://' || lower(split_part({_ORIGIN}, '://', 2)) || "
           f"CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || "
           f"CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END")
_FOLDER = f"regexp_replace({_PATH}, '[^/]*$', '')"
_LINKS = f"""
hrefs AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i FROM pages),
targets AS (
  SELECT page_id, url, href, i, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href ELSE {_ORIGIN} || href END AS target
  FROM hrefs),
links AS (
  SELECT page_id, url, target, min(i) AS i, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INTEGER) AS pos,
         ({host_sql('target')} = {host_sql('url')} OR ends_with({host_sql('target')}, '.' || {host_sql('url')})) AS same_host
  FROM targets GROUP BY page_id, url, target),
scored AS (
  SELECT *, CASE WHEN regexp_matches(regexp_extract(target, '://[^/]*([^?#]*)', 1), {q(LINK_HINTS)})
              THEN 15 ELSE 0 END AS score FROM links WHERE same_host),
top AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i) - 1 AS rank FROM scored)"""

_DOC_CONTACTS = f"WITH {contacts_sql('c', 'documents', 'doc_id, source, lang', 'text')}"
_PAGE_CONTACTS = contacts_sql("pc", f"(SELECT page_id, {PLAIN_TEXT_SQL} AS text FROM pages)", "page_id", "text")
_ZONE = "(SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<{0}\\b[^>]*>(.*?)</{0}>', 1), '<[^>]*>', ' ', 'g') AS text FROM pages)"


def _policy(kinds: str) -> str:
    return (f"coalesce(array_to_string(list(phone ORDER BY ord) FILTER (WHERE type IN ({kinds})), ','), '')")


_SITE = """
u AS (SELECT {site} AS site, phone, min(doc_id * 1000 + ord) AS ord, arg_min(type, doc_id * 1000 + ord) AS type
      FROM c GROUP BY {site}, phone)"""
_DISPLAY_RAW = r"regexp_extract_all(text, '([0-9][0-9() \-]{8,16}[0-9])', 1)"
_D = "regexp_replace(raw, '[^0-9]+', '', 'g')"
_NAT = f"regexp_extract({_D}, '{NANP.national}', 1)"

SQL = {
    "q_host": f"""SELECT page_id, {host_sql('url')} AS host,
        regexp_replace({host_sql('url')}, ':[0-9]*$', '') AS bare_host FROM pages""",
    "q_url_normal": f"""SELECT page_id, {_NORMAL} AS url_normal,
        split_part(url, '://', 1) || '://' || lower(split_part({_ORIGIN}, '://', 2)) ||
          regexp_replace({_FOLDER}, '[^/]+/$', '') || 'a/b?c=1' AS up,
        lower({_ORIGIN}) || '/root' AS rooted,
        split_part(url, '://', 1) || '://other.example.com/' AS other FROM pages""",
    "q_contacts_text": f"{_DOC_CONTACTS} SELECT doc_id, ord, phone, type FROM c",
    "q_contacts_text_trunk": f"""WITH {contacts_sql('c', 'documents', 'doc_id', 'text', RU_TRUNK)}
        SELECT doc_id, ord, phone, type FROM c""",
    "q_contacts_html": f"""WITH {_PAGE_CONTACTS},
        {contacts_sql('f', _ZONE.format('footer'), 'page_id', 'text')},
        {contacts_sql('n', _ZONE.format('nav'), 'page_id', 'text')}
        SELECT pc.page_id, pc.phone, pc.type, CASE WHEN n.phone IS NOT NULL THEN 'nav'
          WHEN f.phone IS NOT NULL THEN 'footer' ELSE 'body' END AS zone
        FROM pc LEFT JOIN f ON f.page_id = pc.page_id AND f.phone = pc.phone
        LEFT JOIN n ON n.page_id = pc.page_id AND n.phone = pc.phone""",
    "q_phone_policy": f"""{_DOC_CONTACTS} SELECT doc_id,
        CASE WHEN count(*) FILTER (WHERE type = 'mobile') > 0 THEN {_policy("'mobile'")}
             ELSE {_policy("'mobile', 'city'")} END AS mobile,
        {_policy("'city'")} AS city, {_policy("'mobile', 'city'")} AS business,
        coalesce(array_to_string(list(phone ORDER BY ord) FILTER (WHERE NOT starts_with(phone, '1800')), ','), '') AS no_800,
        {_policy("'mobile', 'city'")} AS "all" FROM c GROUP BY doc_id""",
    "q_phone_display": f"""WITH r AS (SELECT doc_id, unnest({_DISPLAY_RAW}) AS raw FROM documents)
        SELECT doc_id, raw, CASE WHEN {_NAT} = '' THEN raw ELSE
          '+1 (' || substring({_NAT}, 1, 3) || ') ' || substring({_NAT}, 4, 3) || '-' || substring({_NAT}, 7, 2)
          || '-' || substring({_NAT}, 9, 2) END AS shown,
        {type_sql(_D, RU)} AS ru_type, {type_sql(_D, RU)} IN ('mobile', 'city') AS ru_valid,
        CASE WHEN {_D} = '' THEN 'empty' WHEN {type_sql(_D, RU)} IN ('mobile', 'city') THEN ''
             WHEN {type_sql(_D, RU)} = 'excluded' THEN 'toll-free' ELSE 'format' END AS ru_reason FROM r""",
    "q_primary_phones": f"""{_DOC_CONTACTS}, {_SITE.format(site='source')},
        n AS (SELECT site, count(*) AS n FROM u GROUP BY site),
        kept AS (
          SELECT u.site, phone, type, row_number() OVER (PARTITION BY u.site ORDER BY ord, phone) AS k
          FROM u JOIN n USING (site) WHERE n.n <= 10 AND type IN ('mobile', 'city')
          UNION ALL
          SELECT u.site, phone, type, row_number() OVER (PARTITION BY u.site ORDER BY ord, phone) AS k
          FROM u JOIN n USING (site) WHERE n.n > 10 AND type = 'mobile')
        SELECT n.site, max(phone) FILTER (WHERE k = 1) AS p1, max(phone) FILTER (WHERE k = 2) AS p2,
          max(type) FILTER (WHERE k = 1) AS p1_type, max(type) FILTER (WHERE k = 2) AS p2_type
        FROM n LEFT JOIN kept USING (site) GROUP BY n.site""",
    "q_phone_overflow": f"""{_DOC_CONTACTS}, {_SITE.format(site='lang')},
        n AS (SELECT site, count(*) AS n FROM u GROUP BY site),
        r AS (SELECT u.*, n.n, row_number() OVER (PARTITION BY u.site, type = 'mobile' ORDER BY ord, phone) AS k
              FROM u JOIN n USING (site)),
        kept AS (SELECT * FROM r WHERE (n > 2 AND type = 'mobile' AND k <= 2) OR (n <= 2 AND type IN ('mobile', 'city')))
        SELECT n.site, n.n AS raw_unique, count(kept.phone) AS kept, n.n > 2 AS overflow,
          coalesce(array_to_string(list(kept.phone ORDER BY kept.ord) FILTER (WHERE kept.phone IS NOT NULL), ','), '') AS phones
        FROM n LEFT JOIN kept USING (site) GROUP BY n.site, n.n""",
    "q_phone_hint": f"""SELECT page_id, regexp_matches(substring(html, 1, 80000), {q(NANP.hint)}) AS hint_nanp,
        regexp_matches(substring(html, 1, 80000), {q(RU.hint)}) AS hint_ru FROM pages""",
    "q_phone_flag": f"""WITH {_PAGE_CONTACTS} SELECT page_id, regexp_matches(substring(html, 1, 80000), {q(NANP.hint)})
        OR page_id IN (SELECT page_id FROM pc) AS has_phone FROM pages""",
    "q_first_contact_page": f"""WITH {_PAGE_CONTACTS},
        v AS (SELECT * FROM (SELECT page_id, {host_sql('url')} AS site, html,
                row_number() OVER (PARTITION BY {host_sql('url')} ORDER BY page_id) - 1 AS visit FROM pages) WHERE visit < 6),
        t AS (SELECT site, visit, page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;?', '&', 'g')) AS title,
                (SELECT count(*) FROM pc WHERE pc.page_id = v.page_id) AS n_phones,
                (SELECT string_agg(phone, ',' ORDER BY ord) FROM pc WHERE pc.page_id = v.page_id) AS phones FROM v),
        s AS (SELECT site, min(visit) FILTER (WHERE n_phones > 0) AS found_at FROM t GROUP BY site)
        SELECT t.site, CAST(any_value(found_at) AS INTEGER) AS found_at,
          coalesce(arg_min(title, visit) FILTER (WHERE title <> ''), '') AS title,
          CAST(count(*) AS INTEGER) AS pages, CAST(max(n_phones) AS INTEGER) AS n_phones,
          coalesce(max(phones), '') AS phones
        FROM t JOIN s USING (site) WHERE found_at IS NULL OR visit <= found_at GROUP BY t.site""",
    "q_snippet_fallback": f"""{_DOC_CONTACTS}, {_PAGE_CONTACTS},
        p AS (SELECT page_id, string_agg(phone, ',' ORDER BY phone) AS phones FROM pc GROUP BY page_id),
        d AS (SELECT doc_id, string_agg(phone, ',' ORDER BY phone) AS phones FROM c GROUP BY doc_id)
        SELECT pages.page_id, coalesce(p.phones, d.phones, '') AS phones,
          CASE WHEN p.phones IS NOT NULL THEN 'page' WHEN d.phones IS NOT NULL THEN 'snippet' ELSE 'none' END AS origin
        FROM pages LEFT JOIN p USING (page_id) LEFT JOIN d ON d.doc_id = pages.page_id""",
    "q_links": f"WITH {_LINKS} SELECT page_id, pos, target, same_host FROM links",
    "q_links_top": f"""WITH {_LINKS} SELECT page_id, CAST(rank AS INTEGER) AS rank, target, CAST(score AS INTEGER) AS score
        FROM top WHERE rank < 3""",
    "q_section_links": f"""WITH {_LINKS},
        h AS (SELECT {host_sql('url')} AS site, url, target, i FROM links WHERE same_host AND
              regexp_matches(lower(regexp_extract(target, '://[^/]*([^?#]*)', 1)), {q(LINK_HINTS)})),
        f AS (SELECT site, target, min((url, i)) AS first_at FROM h GROUP BY site, target),
        r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first_at) AS rank FROM f)
        SELECT site, CAST(rank AS INTEGER) AS rank, target FROM r WHERE rank <= 4""",
    "q_frontier": f"""WITH {_LINKS},
        e AS (SELECT {host_sql('url')} AS site, {_NORMAL} AS url, target FROM top WHERE rank < 8),
        s0 AS (SELECT {host_sql('url')} AS site, arg_min({_NORMAL}, page_id) AS url FROM pages GROUP BY 1),
        s1 AS (SELECT DISTINCT site, target AS url FROM s0 JOIN e USING (site, url) EXCEPT SELECT site, url FROM s0),
        s2 AS (SELECT DISTINCT site, target AS url FROM s1 JOIN e USING (site, url)
               EXCEPT (SELECT site, url FROM s0 UNION ALL SELECT site, url FROM s1))
        SELECT site, url, 0 AS level FROM s0 UNION ALL SELECT site, url, 1 FROM s1 UNION ALL SELECT site, url, 2 FROM s2""",
    "q_snapshot_lookup": f"""WITH {HITS_SQL}, u AS (SELECT url, count(*) AS n_hits FROM hits GROUP BY url)
        SELECT url, n_hits, CAST(strlen(html) AS BIGINT) AS html_bytes FROM u JOIN (SELECT url, html FROM pages) p USING (url)""",
    "q_site_input": f"""SELECT page_id, {_NORMAL} AS from_prose,
        'https://' || {host_sql('url')} || '/Path' AS from_bare, CAST(NULL AS VARCHAR) AS none FROM pages""",
}
