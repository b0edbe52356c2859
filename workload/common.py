"""Roles of the given tables, in Spark and in SQL.

documents are search hits (one brief per language, one query per source), pages are page
snapshots, events are run logs, orders and customer are the run store.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.phone import _CONTEXT, NANP, NumberingPlan
from contactlake.functions.url import host
from contactlake.plans.candidates import brief_parameters
from contactlake.session import spread, stage
from contactlake.sources.readers import parse_briefs

# Word lists with words that occur in the data.
AGGREGATORS = ("spam-farm.example.org", "therin.example.net", "ththhe.example.com")
CATALOGS = ("blog.tiontion.example.com", "cheap-pills.example.com", "ththen.example.com")
JUNK_HOSTS = ("ththth.example.net", "src5.example.net")
INFO_PARTS = ("ththble", "src7")
EDU = r"(?i)(\.edu\.|tionsh\.)"
MEDIA = r"(?i)(^|\.)(m\.[a-z]{2,8}|therou)\."
ARTICLE = r"(?i)(clown|and the.*of the|oué ouè)"
SIGNALS = ("handwh", "keitung", "mentvi", "ciónqu")
NICHE = "whoution threeation"
NICHE_STOP = ("whoution",)
EXCLUDE = ("thther.example.org", "src3.example.net")
CLIENT = "ththan.example.net"
REGIONS = ("tionanska region", "keitung", "mentoi kraj")
REGION_SUFFIXES = ("ska region", " kraj")
REGION_ALIASES = {"keitung": ("schung", "ungsch")}
REGION_NAMES = ("thereon", "whoutha", "there", "schung", "mentoi", "tionha", "onth")
BRIEF_QUERIES = ("hanthe example", "ouaiier")


# One brief per language, different in every setting, and one that names its own sites.
# max_sites and crawl_depth as given; zero and nothing mean the default, the rest is held in bounds.
BRIEFS = (
    ("en", dict(maxSites=200, crawlDepth=2, phoneFilter="business", checkAlive=True)),
    ("de", dict(maxSites=20, crawlDepth=1, phoneFilter="mobile", checkAlive=False)),
    ("fr", dict(maxSites=0, crawlDepth=3, phoneFilter="all", regionMode="exclude", sources=["serp", "site"])),
    ("es", dict(maxSites=3, crawlDepth=0, phoneFilter="city", regionMode="exclude")),
    ("own", dict(maxSites=10, crawlDepth=1, phoneFilter="business", quickCrawl=True,
                 seedDomains="www.therha.example.com, thther.example.org, ththan.example.net, none.example.net, therin.example.net")),
)
# Fixed consequences of the briefs, for the SQL.
SITES = {"en": 200, "de": 20, "fr": 50, "es": 10, "own": 10}
BUDGET = {"en": 6, "de": 4, "fr": 9, "es": 6, "own": 4}
OWN_SITES = ("therha.example.com", "none.example.net", "therin.example.net")


def by_brief_sql(values: dict, brief: str = "brief_id") -> str:
    return f"CASE {brief} " + " ".join(f"WHEN {q(b)} THEN {v}" for b, v in values.items()) + " END"


def briefs(spark: SparkSession) -> DataFrame:
    """The briefs as jobs take them: parsed from their JSON, once."""
    common = dict(clientSite=f"https://{CLIENT}/", niche=NICHE, excludeDomains=", ".join(EXCLUDE),
                  regions="\n".join(REGIONS), queries="\n".join(BRIEF_QUERIES))
    rows = [(name, json.dumps(common | brief)) for name, brief in BRIEFS]
    return stage(brief_parameters(parse_briefs(spark.createDataFrame(rows, "brief_id STRING, value STRING").coalesce(1))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a hit.  Its url is that of the page of the same number, where there
    is one; else an address of its source."""
    d, p = documents(spark, sf_dir), table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.coalesce("url", F.concat(
        F.lit("https://"), "source", F.lit(".example.net/"), F.col("doc_id").cast("string")))
    return (
        d.join(p, d.doc_id == p.page_id, "left").withColumn("url", url)
        .select(
            F.col("lang").alias("brief_id"), F.col("doc_id").cast("int").alias("pos"), "url",
            host(F.col("url")).alias("domain"),
            F.substring(F.substring_index("text", ".", 1), 1, 80).alias("title"),
            F.col("text").alias("snippet"),
            F.concat(F.lit("e"), F.length("source").cast("string")).alias("engine"),
            F.lit(1).alias("page"), F.col("source").alias("query"), F.lit("documents").alias("source"),
        )
    )


# --- SQL building blocks ----------------------------------------------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def netloc_sql(x: str) -> str:
    return (
        f"lower(CASE WHEN contains({x}, '://') THEN "
        f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) "
        f"ELSE regexp_extract({x}, '^([^/?#]*)', 1) END)"
    )


def host_sql(x: str) -> str:
    return f"regexp_replace({netloc_sql(x)}, '^www\\.', '')"


def in_domains_sql(host_expr: str, domains) -> str:
    return "(" + " OR ".join(
        f"({host_expr} = {q(d)} OR ends_with({host_expr}, {q('.' + d)}))" for d in domains) + ")"


def contains_any_sql(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


HITS_SQL = f"""
hits AS (
  SELECT lang AS brief_id, CAST(doc_id AS INTEGER) AS pos, url, {host_sql('url')} AS domain,
         substring(split_part(text, '.', 1), 1, 80) AS title, text AS snippet,
         'e' || length(source) AS engine, source AS query
  FROM (SELECT d.*, coalesce(p.url, 'https://' || d.source || '.example.net/' || d.doc_id) AS url
        FROM documents d LEFT JOIN (SELECT page_id, url FROM pages) p ON d.doc_id = p.page_id)
)"""
_CAPS = by_brief_sql({b: max(100, 3 * n) for b, n in SITES.items()})
FIRST_SQL = f"""
first_seen AS (
  SELECT brief_id, query, domain, min(pos) AS pos, arg_min(url, pos) AS url, arg_min(title, pos) AS title,
         arg_min(snippet, pos) AS snippet, arg_min(engine, pos) AS engine
  FROM hits GROUP BY brief_id, query, domain),
first_hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brief_id, query ORDER BY pos) AS rank_in_query
                 FROM first_seen) WHERE rank_in_query <= {_CAPS})"""
GROUPED_SQL = """
grouped AS (
  SELECT brief_id, domain,
         (list(title ORDER BY length(title) DESC, pos))[1] AS title,
         (list(snippet ORDER BY length(snippet) DESC, pos))[1] AS snippet,
         arg_min(url, pos) AS first_url, list(url ORDER BY pos) AS urls,
         list_sort(list(DISTINCT engine)) AS engines, list_sort(list(DISTINCT query)) AS queries
  FROM first_hits GROUP BY brief_id, domain)"""


def allowed_sql(raw: str, plan: NumberingPlan) -> str:
    """Normalised allowed number or NULL."""
    return (
        f"'{plan.country}' || nullif(regexp_extract(regexp_replace({raw}, '[^0-9]+', '', 'g'), "
        f"'{plan.allowed}', 1), '')"
    )


def type_sql(phone: str, plan: NumberingPlan) -> str:
    n = f"substring({phone}, 2, 10)"
    return (
        f"CASE WHEN {phone} IS NULL OR NOT regexp_matches({phone}, '^{plan.country}[0-9]{{10}}$') THEN 'invalid' "
        f"WHEN regexp_matches({n}, '{plan.toll_free}') THEN 'excluded' "
        f"WHEN regexp_matches({n}, '{plan.mobile}') THEN 'mobile' "
        f"WHEN regexp_matches({n}, '{plan.city}') THEN 'city' ELSE 'invalid' END"
    )


CONTEXT_SQL = _CONTEXT.replace("(?iu)", "(?i)")


def contacts_sql(name: str, src: str, keys: str, text: str, plan: NumberingPlan = NANP) -> str:
    """CTE ``name``: first mention of each number per ``keys``: keys, phone, ord, type."""
    return f"""
{name}_runs AS (
  SELECT {keys}, 0 AS ch, unnest(regexp_extract_all({text}, {q(plan.trunk_run)})) AS raw,
         generate_subscripts(regexp_extract_all({text}, {q(plan.trunk_run)}), 1) AS i FROM {src}
  UNION ALL
  SELECT {keys}, 1 AS ch, unnest(regexp_extract_all({text}, {q(CONTEXT_SQL)}, 1)) AS raw,
         generate_subscripts(regexp_extract_all({text}, {q(CONTEXT_SQL)}, 1), 1) AS i FROM {src}),
{name}_first AS (
  SELECT {keys}, phone, min(ch * 1000000 + i) AS first_at
  FROM (SELECT *, {allowed_sql('raw', plan)} AS phone FROM {name}_runs) WHERE phone IS NOT NULL
  GROUP BY {keys}, phone),
{name} AS (
  SELECT {keys}, phone, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY first_at) - 1 AS INTEGER) AS ord,
         {type_sql('phone', plan)} AS type
  FROM {name}_first)"""


PLAIN_TEXT_SQL = (
    "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', '', 'g'), "
    "'(?s)<!--.*?-->|<[^>]*>', '\n', 'g')"
)
NO_REGION = V.NO_REGION
