"""Lead rows, catalogue fill, deduplication, export."""
from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.lists import export_name
from contactlake.functions.phone import NANP
from contactlake.functions.url import host
from contactlake.operators.contacts import text_contacts
from contactlake.operators.leads import dedupe_leads, fill_from_catalogs, not_yet_done
from contactlake.plans.candidates import live_pages
from contactlake.plans.leads import PATHS, full_run
from contactlake.session import shared_dir, stage
from contactlake.sources.readers import read_pages
from contactlake.sources.writers import export_table, exportable, write_csv
from workload import common as W
from workload.common import (
    HITS_SQL, PLAIN_TEXT_SQL, contacts_sql, documents, hits, host_sql, in_domains_sql, pages, q, table,
)
from workload.hits import CHOSEN, LISTS, REGION_TEXT


def site_pages(spark, sf_dir):
    """The pages, and the first of each host once more under the addresses of the visiting path.

    Every second address ends in a slash.
    """
    p = pages(spark, sf_dir).select("page_id", "url", "html")
    nth = F.row_number().over(Window.partitionBy(host(F.col("url"))).orderBy("page_id"))
    ranked = p.select("page_id", "url").withColumn("n", nth).where(F.col("n") <= len(PATHS))
    path = F.element_at(F.array(*map(F.lit, PATHS)), F.col("n"))
    slash = F.when((F.col("n") % 2 == 0), "/").otherwise("")
    own = ranked.select("page_id", F.concat(F.lit("https://"), host(F.col("url")), path, slash).alias("url"))
    return p.drop("page_id").unionByName(own.join(p.select("page_id", "html"), "page_id").drop("page_id"))


def q_lead_rows(spark, sf_dir):
    """The full run over all briefs, the one with its own sites included."""
    live = live_pages(pages(spark, sf_dir))
    done = full_run(hits(spark, sf_dir), W.briefs(spark), site_pages(spark, sf_dir), live, NANP, W.CATALOGS, W.REGION_NAMES, **LISTS)
    return done.select(
        "brief_id", "ord", "site", "name", "offer", "region", F.array_join("phones", ",").alias("phones"),
        "p1", "p2", "p1_type", "p2_type", "p1_valid", "p2_valid", "source", "status", "crawl_status")


def q_catalog_fill(spark, sf_dir):
    """Sites without a number against documents that hold one."""
    d = documents(spark, sf_dir)
    docs = stage(text_contacts(d.select("doc_id", "lang", "text"), F.col("text"), plan=NANP).select(
        F.col("lang").alias("brief_id"), F.format_string("d%09d", "doc_id").alias("url"),
        F.col("text").alias("body"), "contacts"))
    none = F.lit(None).cast("string")
    needy = hits(spark, sf_dir).groupBy("brief_id", F.col("domain").alias("site")).agg(F.min("pos").alias("ord"))
    leads = needy.select(
        "brief_id", "ord", "site", F.array().cast("array<string>").alias("phones"), none.alias("p1"),
        none.alias("p2"), none.alias("p1_type"), none.alias("p2_type"),
        F.lit(V.SOURCE_SITE).alias("source"), F.lit(V.STATUS_NO_PHONE).alias("status"))
    return fill_from_catalogs(leads, docs, "business", NANP).select(
        "brief_id", "ord", "site", "p1", "p2", "p1_type", "source", "status")


def _order_leads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("brief_id"), F.col("o_orderkey").alias("ord"),
        F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "SITE").otherwise("site"), F.col("o_custkey").cast("string")).alias("site"),
        F.concat(F.lit("7495"), F.lpad(F.floor(F.col("o_totalprice") / 1000).cast("string"), 7, "0")).alias("p1"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.concat(
            F.lit("7900"), F.lpad(F.floor(F.col("o_totalprice") / 500).cast("string"), 7, "0"))).alias("p2"))


def q_dedupe(spark, sf_dir):
    return dedupe_leads(_order_leads(spark, sf_dir))


def q_resume(spark, sf_dir):
    done = table(spark, sf_dir, "pages").select(F.lit("en").alias("brief_id"), F.upper(host(F.col("url"))).alias("site"))
    candidates = hits(spark, sf_dir).select("brief_id", "domain", "pos")
    return not_yet_done(candidates, done)


def _export_rows(spark, sf_dir):
    d = documents(spark, sf_dir)
    c = text_contacts(d.select("doc_id", "lang", "source", "text"), F.col("text"), plan=NANP)
    phones = F.transform("contacts", lambda x: x["phone"])
    rows = c.withColumn("phones", F.when(F.col("lang") != "fr", phones).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("listed", phones).select(
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("site"), F.col("source").alias("name"),
        F.nullif("lang", F.lit("es")).alias("region"), "phones", F.get("listed", F.lit(0)).alias("p1"),
        F.get("listed", F.lit(1)).alias("p2"), F.lit("s;1").alias("source"), F.lit(V.STATUS_FOUND).alias("status"),
        (F.col("lang") != "de").alias("for_definition"))


def q_export_wide(spark, sf_dir):
    return export_table(exportable(_export_rows(spark, sf_dir), reviewed=True, marked_only=True), plan=NANP)


def q_csv_roundtrip(spark, sf_dir):
    """The export written as CSV under its export name and read back."""
    out = export_table(_export_rows(spark, sf_dir), plan=NANP)
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    write_csv(out, path)
    schema = ", ".join(f"{c} STRING" for c in out.columns)
    back = spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


def q_export_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_mktsegment") == "BUILDING", " . ").otherwise(
        F.concat(F.lit(' "'), "c_name", F.lit('" :  '), "c_mktsegment", F.lit(".")))
    at = F.timestamp_seconds(F.lit(1700000000) + F.col("c_custkey") * 3600)
    return c.select("c_custkey", export_name(name, F.concat(F.lit("abcdef"), F.col("c_custkey").cast("string")), at, "csv").alias("file"))


def q_usable_pages(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet", ("page_id", "url"))


QUERIES = {f.__name__: f for f in (
    q_lead_rows, q_catalog_fill, q_dedupe, q_resume, q_export_wide, q_csv_roundtrip, q_export_name, q_usable_pages)}


def _regions(text):
    return "CASE " + " ".join(f"WHEN contains(lower({text}), {q(n)}) THEN {q(n)}"
                              for n in sorted(W.REGION_NAMES, key=lambda n: (-len(n), n))) + " END"


_POLICY = """CASE WHEN n > 10 THEN type = 'mobile' WHEN brief_id = 'de' THEN type = 'mobile' OR (mobiles = 0 AND type = 'city')
             WHEN brief_id = 'es' THEN type = 'city' ELSE type IN ('mobile', 'city') END"""
_OWN_ROWS = " UNION ALL ".join(
    f"SELECT 'own', {i}, {q(d)}, {q(d)}, {q(V.SEED_SNIPPET)}, ['seed'], ['quick']" for i, d in enumerate(W.OWN_SITES, 1))
LEADS = f"""{CHOSEN},
picks AS (SELECT brief_id, pick, domain, title, snippet, engines, queries FROM chosen UNION ALL {_OWN_ROWS}),
{contacts_sql('pc', f"(SELECT page_id, {PLAIN_TEXT_SQL} AS text FROM pages)", 'page_id', 'text')},
{contacts_sql('sc', 'picks', 'brief_id, domain', "trim(title || ' ' || snippet)")},
pos AS (SELECT page_id, {host_sql('url')} AS site,
          trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;?', '&', 'g')) AS title,
          row_number() OVER (PARTITION BY {host_sql('url')} ORDER BY page_id) - 1 AS visit,
          EXISTS (SELECT 1 FROM pc WHERE pc.page_id = pages.page_id) AS has_phone FROM pages),
vis AS (SELECT pos.*, b.brief_id FROM pos, (SELECT DISTINCT brief_id FROM picks) b
        WHERE visit < least({len(PATHS)}, {W.by_brief_sql(W.BUDGET, 'b.brief_id')})),
stop AS (SELECT brief_id, site, min(visit) FILTER (WHERE has_phone) AS found_at,
           arg_min(page_id, visit) FILTER (WHERE has_phone) AS page_id FROM vis GROUP BY ALL),
crawl AS (SELECT vis.brief_id, vis.site, any_value(stop.page_id) AS page_id,
            coalesce(arg_min(title, visit) FILTER (WHERE title <> ''), '') AS title
          FROM vis JOIN stop USING (brief_id, site) WHERE found_at IS NULL OR visit <= found_at GROUP BY ALL),
used AS (
  SELECT c.brief_id, c.domain, pc.phone, pc.ord, pc.type, 'site' AS origin
  FROM picks c JOIN crawl k ON k.brief_id = c.brief_id AND k.site = c.domain JOIN pc ON pc.page_id = k.page_id
  UNION ALL
  SELECT sc.brief_id, sc.domain, sc.phone, sc.ord, sc.type, 'text' FROM sc
  WHERE (sc.brief_id, sc.domain) NOT IN (SELECT (brief_id, site) FROM crawl WHERE page_id IS NOT NULL)),
sized AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE type = 'mobile') OVER w AS mobiles FROM used
          WINDOW w AS (PARTITION BY brief_id, domain)),
picked AS (SELECT brief_id, domain, list(phone ORDER BY ord) AS phones, any_value(origin) AS origin FROM sized
           WHERE {_POLICY} GROUP BY brief_id, domain),
leads AS (
  SELECT c.brief_id, c.pick AS ord, c.domain AS site,
    substring(coalesce(nullif(k.title, ''), nullif(c.title, ''), c.domain), 1, 120) AS name,
    coalesce(nullif(substring(c.snippet, 1, 160), ''), 'Выдача ' || array_to_string(c.engines, '/')) AS offer,
    {_regions('c.' + REGION_TEXT.replace("|| snippet", "|| c.snippet").replace("(queries", "(c.queries"))} AS region,
    coalesce(p.phones, []) AS phones,
    CASE WHEN EXISTS (SELECT 1 FROM crawl x WHERE x.brief_id = c.brief_id AND x.site = c.domain AND x.page_id IS NOT NULL) THEN {q(V.SOURCE_SITE)} ELSE {q(V.SOURCE_SEARCH)} END AS source,
    CASE WHEN len(p.phones) > 0 THEN {q(V.STATUS_FOUND)} ELSE {q(V.STATUS_NO_PHONE)} END AS status,
    CASE WHEN k.site IS NOT NULL OR (p.origin = 'text' AND len(p.phones) > 0) THEN 'success' ELSE 'error' END AS crawl_status
  FROM picks c LEFT JOIN crawl k ON k.brief_id = c.brief_id AND k.site = c.domain LEFT JOIN picked p ON p.brief_id = c.brief_id AND p.domain = c.domain),
cats AS (
  SELECT brief_id, url, text, list(phone ORDER BY ord) AS phones FROM (
    SELECT h.brief_id, h.url, lower(p.text) AS text, pc.phone, pc.ord, pc.type, count(*) OVER w AS n,
      count(*) FILTER (WHERE type = 'mobile') OVER w AS mobiles
    FROM (SELECT brief_id, domain, arg_max(url, pos) AS url FROM hits
          WHERE brief_id <> 'fr' AND {in_domains_sql('domain', W.CATALOGS)} GROUP BY 1, 2) h
    JOIN (SELECT page_id, url, {PLAIN_TEXT_SQL} AS text FROM pages) p USING (url) JOIN pc ON pc.page_id = p.page_id
    WINDOW w AS (PARTITION BY h.brief_id, h.url))
  WHERE {_POLICY} GROUP BY ALL),
named AS (SELECT l.brief_id, l.site, min(cats.url) AS url, arg_min(cats.phones, cats.url) AS phones
          FROM leads l JOIN cats ON cats.brief_id = l.brief_id AND contains(cats.text, split_part(lower(l.site), '.', 1))
          WHERE len(l.phones) = 0 GROUP BY 1, 2),
filled AS (
  SELECT l.* EXCLUDE (phones, source, status), coalesce(n.phones, l.phones) AS phones,
    CASE WHEN n.url IS NOT NULL THEN {q(V.SOURCE_CATALOG)} ELSE l.source END AS source,
    CASE WHEN n.url IS NOT NULL THEN {q(V.STATUS_FOUND)} ELSE l.status END AS status
  FROM leads l LEFT JOIN named n USING (brief_id, site)),
wide AS (SELECT *, phones[1] AS p1, phones[2] AS p2 FROM filled),
seen AS (SELECT brief_id, phone, min(ord) AS first_ord FROM (
           SELECT brief_id, ord, p1 AS phone FROM wide UNION ALL SELECT brief_id, ord, p2 FROM wide)
         WHERE phone IS NOT NULL GROUP BY 1, 2)"""
_T = "CASE WHEN {0} IS NULL THEN NULL WHEN regexp_matches(substring({0}, 2), '^[5679]') THEN 'mobile' ELSE 'city' END"
_EXPORT = f"""WITH {contacts_sql('c', 'documents', 'doc_id', 'text')},
  g AS (SELECT doc_id, list(phone ORDER BY ord) AS all_phones FROM c GROUP BY doc_id),
  e AS (SELECT d.*, CASE WHEN lang <> 'fr' AND len(coalesce(all_phones, [])) > 0 THEN all_phones[1:6] ELSE coalesce(all_phones, [])[1:2] END AS ph
        FROM documents d LEFT JOIN g USING (doc_id))
  SELECT source || '-' || doc_id AS site, source AS name, CASE WHEN lang = 'es' THEN '' ELSE lang END AS region,
    {', '.join(f"coalesce(ph[{i}], '') AS phone_{i}" for i in range(1, 7))}, 's;1' AS source,
    {q(V.STATUS_FOUND)} AS status, CASE WHEN lang <> 'de' THEN {q(V.EXPORT_MARK)} ELSE '' END AS mark FROM e"""

SQL = {
    "q_lead_rows": f"""{LEADS}
        SELECT brief_id, CAST(ord AS INTEGER) AS ord, site, name, offer, region, array_to_string(phones, ',') AS phones, p1, p2,
          {_T.format('p1')} AS p1_type, {_T.format('p2')} AS p2_type, true AS p1_valid, true AS p2_valid, source, status, crawl_status
        FROM wide w WHERE NOT (p1 IS NOT NULL AND p2 IS NULL AND EXISTS (
          SELECT 1 FROM seen s WHERE s.brief_id = w.brief_id AND s.phone = w.p1 AND s.first_ord < w.ord))""",
    "q_catalog_fill": f"""WITH {HITS_SQL}, {contacts_sql('c', 'documents', 'doc_id', 'text')},
        cats AS (SELECT lang AS brief_id, doc_id, lower(text) AS text, list(phone ORDER BY ord) AS phones
                 FROM documents JOIN c USING (doc_id) GROUP BY ALL),
        l AS (SELECT brief_id, domain AS site, min(pos) AS ord FROM hits GROUP BY 1, 2),
        n AS (SELECT l.brief_id, l.site, arg_min(phones, doc_id) AS phones FROM l JOIN cats
              ON cats.brief_id = l.brief_id AND contains(cats.text, split_part(l.site, '.', 1)) GROUP BY 1, 2)
        SELECT l.brief_id, l.ord, l.site, phones[1] AS p1, phones[2] AS p2, {_T.format('phones[1]')} AS p1_type,
          CASE WHEN phones IS NULL THEN {q(V.SOURCE_SITE)} ELSE {q(V.SOURCE_CATALOG)} END AS source,
          CASE WHEN phones IS NULL THEN {q(V.STATUS_NO_PHONE)} ELSE {q(V.STATUS_FOUND)} END AS status
        FROM l LEFT JOIN n USING (brief_id, site)""",
    "q_dedupe": """WITH o AS (SELECT o_orderstatus AS brief_id, o_orderkey AS ord,
          CASE WHEN o_orderpriority = '5-LOW' THEN 'SITE' ELSE 'site' END || o_custkey AS site,
          '7495' || lpad(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR), 7, '0') AS p1,
          CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW')
            THEN '7900' || lpad(CAST(CAST(floor(o_totalprice / 500) AS BIGINT) AS VARCHAR), 7, '0') END AS p2 FROM orders),
        f AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY brief_id, lower(site) ORDER BY ord) AS k FROM o) WHERE k = 1),
        s AS (SELECT brief_id, phone, min(ord) AS first_ord FROM (SELECT brief_id, ord, p1 AS phone FROM f
              UNION ALL SELECT brief_id, ord, p2 FROM f) WHERE phone IS NOT NULL GROUP BY 1, 2)
        SELECT f.* FROM f JOIN s ON s.brief_id = f.brief_id AND s.phone = f.p1 WHERE p2 IS NOT NULL OR first_ord >= ord""",
    "q_resume": f"""WITH {HITS_SQL} SELECT brief_id, domain, pos FROM hits
        WHERE NOT (brief_id = 'en' AND domain IN (SELECT {host_sql('url')} FROM pages))""",
    "q_export_wide": f"SELECT * FROM ({_EXPORT}) WHERE mark <> ''",
    "q_csv_roundtrip": _EXPORT,
    "q_export_name": """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'run-' || substring('abcdef' || c_custkey, 1, 8)
          ELSE c_name || ' ' || c_mktsegment END || ' ' ||
          strftime(make_timestamp((1700000000 + c_custkey * 3600 + 10800) * 1000000), '%d-%m-%Y') || '.csv' AS file FROM customer""",
    "q_usable_pages": "SELECT page_id, url FROM pages WHERE length(html) >= 200",
}
