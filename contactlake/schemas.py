"""Column types of every table, declared once; nothing is inferred at run time."""

CONTACT = "STRUCT<ord: INT, phone: STRING, type: STRING, source: STRING>"
HITS = (
    "brief_id STRING, pos INT, url STRING, domain STRING, title STRING, snippet STRING, "
    "engine STRING, page INT, query STRING, source STRING"
)
PAGES = "page_id BIGINT, url STRING, html STRING"
PAGES_FETCHED = PAGES + ", status_code INT, fetched_at TIMESTAMP"
CANDIDATES = (
    "brief_id STRING, domain STRING, title STRING, snippet STRING, urls ARRAY<STRING>, "
    "engines ARRAY<STRING>, queries ARRAY<STRING>, final_url STRING"
)
CONTACTS = (
    "page_id BIGINT, site STRING, ord INT, phone STRING, type STRING, source STRING, source_rank INT"
)
LEAD_FIELDS = (
    "site: STRING, name: STRING, offer: STRING, region: STRING, phones: ARRAY<STRING>, "
    "p1: STRING, p2: STRING, p1_type: STRING, p2_type: STRING, p1_valid: BOOLEAN, "
    "p2_valid: BOOLEAN, source: STRING, status: STRING, crawl_status: STRING, "
    "for_definition: BOOLEAN"
)
LEADS = "brief_id STRING, run_id STRING, ord INT, " + LEAD_FIELDS.replace(":", "")
# the two credential fields of a brief are never read
BRIEF_FIELDS = (
    "operatorName: STRING, clientName: STRING, clientSite: STRING, niche: STRING, "
    "regionMode: STRING, regions: STRING, queries: STRING, excludeDomains: STRING, "
    "phoneFilter: STRING, sources: ARRAY<STRING>, checkAlive: BOOLEAN, maxSites: INT, "
    "crawlDepth: INT, requestDelayMs: INT, useProxy: BOOLEAN, quickCrawl: BOOLEAN, "
    "seedDomains: STRING"
)
PIPELINE_FIELDS = (
    "analyze: STRING, serp: STRING, filter: STRING, crawl: STRING, catalog: STRING, dedup: STRING, "
    "logs: ARRAY<STRUCT<ts: STRING, msg: STRING, site: STRING, status: STRING>>, "
    "site_status: MAP<STRING, STRING>, sources_reviewed: BOOLEAN, "
    "filter_progress: STRUCT<checked: INT, total: INT, alive: INT, dead: INT>, "
    "checkpoint: STRUCT<alive_candidates: ARRAY<STRUCT<domain: STRING>>, "
    "serp_hits: ARRAY<STRUCT<domain: STRING>>, catalog_urls: MAP<STRING, STRING>>"
)
RUNS_RAW = (
    "id STRING, status STRING, brief_json STRING, pipeline_json STRING, results_json STRING, "
    "error STRING, is_demo INT, created_at STRING, updated_at STRING"
)
RUN_LOG = "run_id STRING, ts TIMESTAMP, site STRING, status STRING, msg STRING"
RUN_STEPS = "run_id STRING, step STRING, status STRING, log STRING"
REGIONS = (
    "name STRING, ord INT, district_id STRING, district_name STRING, district_short STRING, "
    "label STRING, aliases ARRAY<STRING>"
)
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
