"""Whole sites and their structured data: every page of a site, no cut of pages or texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.url import host
from contactlake.operators.flatten import flatten_pages
from contactlake.operators.html import visible_text
from contactlake.operators.sitewords import site_keywords, site_words
from contactlake.operators.structured import item_columns, structured_items
from workload.common import host_sql, pages, q
from workload.profile import _PAGE


def q_site_keywords(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", host(F.col("url")).alias("site"), "html")
    flat = flatten_pages(p).select("page_id", "site", visible_text(None).alias("text"))
    return site_keywords(site_words(flat, F.col("text"), "page_id"))


def _company_pages(spark, sf_dir):
    """A page per customer with JSON-LD in four forms: one item, a graph with an offer an order, contact points, not JSON."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.concat(
        F.lit("8495"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("c_phone"))
    # a customer's orders are few
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    org = lambda kind: F.concat(F.lit('"@type":"' + kind + '","name":"'), "c_name", F.lit('"'))
    phone = F.concat(F.lit('"'), "c_phone", F.lit('"'))
    offers = F.transform(F.coalesce("orders", F.array().cast("array<bigint>")),
                         lambda k: F.concat(F.lit(',{"@type":"Offer","name":"order '), k, F.lit('"}')))
    one = F.concat(F.lit("{"), org("Organization"), F.lit(',"telephone":'), phone, F.lit("}"))
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":[{'), org("Corporation"), F.lit(',"legalName":"AO "}'),
                     F.array_join(offers, ""), F.lit("]}"))
    points = F.concat(F.lit("[{"), org("LocalBusiness"), F.lit(',"legalName":"Legal "'), F.lit(',"contactPoint":[{"telephone":'), phone,
                      F.lit('},{"telephone":'), F.col("c_custkey").cast("string"), F.lit("},"), phone, F.lit("]},7]"))
    broken = F.concat(F.lit("{"), org("Organization"))
    form = F.col("c_custkey") % 4
    body = F.when(form == 0, one).when(form == 1, graph).when(form == 2, points).otherwise(broken)
    return c.join(o, "c_custkey", "left").select("c_custkey", F.concat(
        F.lit('<html><head><script type="application/ld+json">'), body, F.lit("</script></head><body>text</body></html>")).alias("html"))


def q_structured_items(spark, sf_dir):
    got = item_columns(structured_items(_company_pages(spark, sf_dir)))
    return got.select("c_custkey", "pos", "type", "name", "legal_name", F.array_join("phones", "|").alias("phones"))


QUERIES = {f.__name__: f for f in (q_site_keywords, q_structured_items)}

_WORDS = "regexp_extract_all(lower(array_to_string(strings, '\n')), '[а-яёa-z][а-яёa-z-]{3,}')"
SQL = {
    "q_site_keywords": f"""WITH {_PAGE},
        w AS (SELECT {host_sql('url')} AS site, page_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM pg),
        c AS (SELECT site, word, count(*) AS n, min({{'p': page_id, 'i': i}}) AS seen FROM w WHERE length(word) >= 5
              AND word NOT IN ({', '.join(q(t) for t in V.KEYWORD_STOP_WORDS)}) GROUP BY 1, 2)
        SELECT site, word, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
          PARTITION BY site ORDER BY n DESC, length(word) DESC, seen) AS rank FROM c) WHERE rank <= 12""",
    "q_structured_items": """WITH cu AS (SELECT c_custkey, c_name, '8495' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS c_phone
          FROM customer), o AS (SELECT o_custkey AS c_custkey, o_orderkey,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
        SELECT c_custkey, CAST(0 AS INTEGER) AS pos, 'Organization' AS type, c_name AS name, CAST(NULL AS VARCHAR) AS legal_name,
          c_phone AS phones FROM cu WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey, 0, NULL, NULL, NULL, '' FROM cu WHERE c_custkey % 4 = 1
        UNION ALL SELECT c_custkey, 1, 'Corporation', c_name, 'AO', '' FROM cu WHERE c_custkey % 4 = 1
        UNION ALL SELECT c_custkey, CAST(1 + k AS INTEGER), 'Offer', 'order ' || o_orderkey, NULL, ''
          FROM cu JOIN o USING (c_custkey) WHERE c_custkey % 4 = 1
        UNION ALL SELECT c_custkey, 0, 'LocalBusiness', c_name, 'Legal', c_phone || '|' || c_custkey || '|' || c_phone
          FROM cu WHERE c_custkey % 4 = 2
        UNION ALL SELECT c_custkey, 1, NULL, NULL, NULL, '' FROM cu WHERE c_custkey % 4 = 2""",
}
