"""From hits to candidates."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.lists import (
    domain_list, error_class, exclude_list, locale_code, operator_name, query_list, region_list, seed_domains,
    status_label,
)
from contactlake.functions.text import (
    clean_phrase, contains_brand, has_service_sense, has_year, hit_blob, looks_like_query, mostly_caps,
    section_junk,
)
from contactlake.functions.url import host
from contactlake.operators import classify as C
from contactlake.operators.hits import (
    catalog_urls, first_hits, group_by_domain, hit_stats, hits_cap, probe_counts, query_errors, reject_counts, union_hits,
    with_fallback,
)
from contactlake.plans.candidates import candidate_job, live_pages
from contactlake.sources.readers import dimension, read_hits
from workload import common as W
from workload.common import (
    FIRST_SQL, GROUPED_SQL, HITS_SQL, contains_any_sql, documents, hits, host_sql, in_domains_sql, pages, q, table,
)

RELEVANCE = dict(signals=W.SIGNALS, synonyms=(), stop=W.NICHE_STOP, root="zzzz")
LISTS = dict(aggregators=W.AGGREGATORS, regions=dict(aliases=W.REGION_ALIASES, suffixes=W.REGION_SUFFIXES),
             junk=dict(domains=W.JUNK_HOSTS, info_parts=W.INFO_PARTS, edu=W.EDU, media=W.MEDIA, article=W.ARTICLE), **RELEVANCE)


def _texts(*values):
    return F.array(*[F.lit(v) for v in values])


def _junk(host_col, title, snippet):
    return C.is_junk(host_col, title, snippet, domains=W.JUNK_HOSTS, info_parts=W.INFO_PARTS, edu=W.EDU,
                     media=W.MEDIA, article=W.ARTICLE)


def job(spark, sf_dir, **lists):
    """The candidate job over all briefs; the pages are the live table."""
    live = live_pages(table(spark, sf_dir, "pages"))
    return candidate_job(hits(spark, sf_dir), W.briefs(spark), live, **(lists or LISTS))


def _first(spark, sf_dir):
    caps = W.briefs(spark).select("brief_id", hits_cap(F.col("max_sites")).alias("hits_cap"))
    return first_hits(hits(spark, sf_dir), caps=caps)


def q_hits_from_xml(spark, sf_dir):
    def xml(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                         F.lit(">"), F.lit("&gt;"))

    clean = F.regexp_replace("snippet", r"[\x00-\x1F\x{FFFE}\x{FFFF}]", " ")
    h = hits(spark, sf_dir)
    group = F.concat(
        F.lit("<group><doc><url>"), xml(F.col("url")), F.lit("</url><title>"), xml(F.regexp_replace("title", r"[\x00-\x1F]", " ")),
        F.lit("</title><passage>"), xml(clean), F.lit("</passage></doc></group>"))
    response = F.when(
        F.col("engine") == "e4", F.lit('<r><response><error code="15">none</error></response></r>')
    ).otherwise(F.concat(F.lit("<r><response><results>"), group, F.lit("</results></response></r>")))
    found, errors = read_hits(h.select("brief_id", "query", F.col("pos").alias("doc_id"), response.alias("xml")))
    return found.select(
        "doc_id", "url", "domain", "title", F.length("snippet").alias("snippet_chars"),
        F.lit("").alias("error")).unionByName(
        errors.select("doc_id", F.lit("").alias("url"), F.lit("").alias("domain"), F.lit("").alias("title"),
                      F.lit(0).alias("snippet_chars"), "error"))


def q_hits_first_capped(spark, sf_dir):
    return _first(spark, sf_dir).select(
        "brief_id", "query", "domain", "pos", "url", "rank_in_query")


def q_hits_by_domain(spark, sf_dir):
    return group_by_domain(_first(spark, sf_dir)).select(
        "brief_id", "domain", "title", "snippet", "first_url", F.array_join("urls", " ").alias("urls"),
        F.array_join("engines", ",").alias("engines"), F.array_join("queries", ",").alias("queries"))


def q_hit_stats(spark, sf_dir):
    return hit_stats(_first(spark, sf_dir), W.briefs(spark))


def q_query_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return query_errors(e.select(
        F.col("user_id").alias("brief_id"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), F.col("props"))).alias("error")))


def q_hits_union(spark, sf_dir):
    h = hits(spark, sf_dir)
    parts = [h.where(F.col("brief_id") == lang).withColumn("origin", F.lit(lang)) for lang in ("en", "de")]
    rest = h.where(~F.col("brief_id").isin("en", "de")).drop("engine")
    return union_hits(*parts, rest).groupBy("origin", "engine").agg(F.count("*").alias("n"))


def q_hits_fallback(spark, sf_dir):
    """Long documents are the primary engine, the others a fallback of three result pages."""
    h = hits(spark, sf_dir).withColumn("page", F.col("pos") % 3)
    long = F.length("snippet") > 6000
    return with_fallback(h.where(long), h.where(~long)).select("brief_id", "query", "pos", "page")


def q_domain_class(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))
    h = F.col("host")
    listed = dimension(spark, [(d,) for d in W.AGGREGATORS], "domain STRING")
    return C.flag_domains(p, "host", listed, "listed").select(
        "page_id", "host", C.is_excluded(h, W.EXCLUDE, F.lit(W.CLIENT)).alias("excluded"),
        C.is_aggregator(h, W.AGGREGATORS).alias("aggregator"), "listed",
        C.domain_class(h, W.EXCLUDE, F.lit(W.CLIENT), W.AGGREGATORS).alias("domain_class"))


def q_catalog_domains(spark, sf_dir):
    return catalog_urls(hits(spark, sf_dir), W.CATALOGS)


def q_junk(spark, sf_dir):
    h = hits(spark, sf_dir)
    return h.select("pos", _junk(F.col("domain"), F.col("title"), F.col("snippet")).alias("junk"))


def q_relevance(spark, sf_dir):
    h = hits(spark, sf_dir)
    c = F.col
    return h.select("pos", C.is_relevant(
        c("domain"), c("title"), c("snippet"), F.array("query"), _texts(*W.BRIEF_QUERIES), F.lit(W.NICHE),
        junk=_junk(c("domain"), c("title"), c("snippet")), **RELEVANCE).alias("relevant"))


def q_region_detect(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", C.detect_region(F.col("text"), W.REGION_NAMES).alias("region"))


def q_region_filter(spark, sf_dir):
    lists = dict(aliases=W.REGION_ALIASES, suffixes=W.REGION_SUFFIXES)
    r, t = _texts(*W.REGIONS), F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", C.regions_match(t, r, F.lit("include"), **lists).alias("include"),
        C.regions_match(t, r, F.lit("exclude"), **lists).alias("exclude"),
        C.hit_region_ok(t, r, F.lit("include"), **lists).alias("hit_include"),
        C.hit_region_ok(t, r, F.lit("exclude"), **lists).alias("hit_exclude"))


def q_reject_reasons(spark, sf_dir):
    return reject_counts(job(spark, sf_dir).judged)


def q_reject_defaults(spark, sf_dir):
    """The packaged word lists on the same hits."""
    return reject_counts(job(spark, sf_dir, aggregators=V.AGGREGATOR_DOMAINS).judged)


def q_alive(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    status = F.when(F.contains("url", F.lit("spam-farm")), 404).otherwise(200)
    return p.select("page_id", C.is_alive(status, F.col("html")).alias("alive"),
                    C.body_usable(status, F.col("html")).alias("usable"))


def q_candidates_cut(spark, sf_dir):
    return job(spark, sf_dir).chosen.select("brief_id", "domain", "pick", "rank", "in_probe", "alive")


def q_probe_counts(spark, sf_dir):
    judged = job(spark, sf_dir).judged.where(F.col("reject_reason").isNull())
    live = live_pages(table(spark, sf_dir, "pages")).withColumnRenamed("url", "first_url")
    kept = judged.join(live, "first_url", "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
    return probe_counts(kept, F.col("max_sites"), V.MAX_SITES)


# --- lists and labels -----------------------------------------------------------------------

def q_list_fields(spark, sf_dir):
    d = documents(spark, sf_dir)
    raw = F.concat(F.lit(" WWW."), "source", F.lit(".com ,"), F.col("lang"), F.lit("\n"), F.col("lang"), F.lit(",,Q "))
    return d.select(
        "doc_id", F.array_join(domain_list(raw), "|").alias("domains"), F.array_join(region_list(raw), "|").alias("regions"),
        F.array_join(query_list(raw), "|").alias("queries"),
        F.array_join(query_list(raw, distinct=True), "|").alias("distinct_queries"),
        F.size(query_list(F.lit(" , "))).alias("default_queries"),
        F.size(query_list(F.lit(""), quick=F.col("lang") == "en")).alias("quick_queries"),
        F.array_join(seed_domains(raw, F.col("lang") == "en"), "|").alias("seeds"))


def q_exclude_list(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(exclude_list(host(F.col("url"))), ", ").alias("excludes"))


def q_error_class(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = (F.get_json_object("props", "$.k").cast("int"))
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("error:HTTP "), (k + 400 + F.when(k > 50, 60).otherwise(0)).cast("string")))
        .when(F.col("event_type") == "view", "error:empty").when(F.col("event_type") == "click", "ConnectTimeout()")
        .when(F.col("event_type") == "signup", "certificate has expired").otherwise("refused"))
    return e.select("event_id", error_class(text).alias("error_class"))


def q_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "RUNNING").when(
        F.col("o_orderpriority") == "1-URGENT", "other").otherwise("")
    name = F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return o.select("o_orderkey", status_label(status).alias("label"), operator_name(name).alias("operator"))


def q_locale(spark, sf_dir):
    codes = (("thereon", 213), ("schung", 1), ("queda", 16), ("whou", 192))
    return documents(spark, sf_dir).select(
        "doc_id", locale_code(F.col("text"), F.col("source"),
                              codes + (("src1", 47),)).alias("locale"))


def q_year_mark(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", has_year(F.concat(F.lit("n "), F.col("n_chars").cast("string")), 1024).alias("year"),
                    has_year(F.col("text"), 2024).alias("in_text"))


def _phrases(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("pos", "raw"))


def q_clean_phrase(spark, sf_dir):
    return _phrases(spark, sf_dir).select("doc_id", "pos", clean_phrase(F.col("raw")).alias("phrase"))


def q_phrase_tests(spark, sf_dir):
    p = F.col("raw")
    brand = _texts("thereon", "schung", "whou")
    return _phrases(spark, sf_dir).select(
        "doc_id", "pos", mostly_caps(p).alias("caps"), contains_brand(p, brand).alias("brand"),
        has_service_sense(p).alias("sense"), looks_like_query(p).alias("query_like"), section_junk(p).alias("junk"))


def q_hit_blob(spark, sf_dir):
    c = F.col
    return hits(spark, sf_dir).select("pos", F.md5(hit_blob(c("title"), c("snippet"), queries=F.array("query", "engine"))).alias("blob"))


QUERIES = {f.__name__: f for f in (
    q_hits_from_xml, q_hits_first_capped, q_hits_by_domain, q_hit_stats, q_query_errors, q_hits_union, q_hits_fallback,
    q_domain_class, q_catalog_domains, q_junk, q_relevance, q_region_detect, q_region_filter, q_reject_reasons,
    q_reject_defaults, q_alive, q_candidates_cut, q_probe_counts, q_list_fields, q_exclude_list, q_error_class,
    q_labels, q_locale, q_year_mark, q_clean_phrase, q_phrase_tests, q_hit_blob)}

# --- SQL ------------------------------------------------------------------------------------

BASE = f"WITH {HITS_SQL}, {FIRST_SQL}, {GROUPED_SQL}"


DATA_LISTS = dict(domains=W.JUNK_HOSTS, info=W.INFO_PARTS, edu=W.EDU, media=W.MEDIA, article=W.ARTICLE,
                  signals=W.SIGNALS, stop=W.NICHE_STOP)
DEFAULT_LISTS = dict(domains=V.JUNK_DOMAINS, info=V.INFO_HOST_PARTS, edu=V.EDU_HOSTS, media=V.MEDIA_HOSTS,
                     article=V.ARTICLE_TEXT.replace("(?iu)", "(?i)"), signals=V.COMMERCIAL_SIGNALS,
                     stop=V.NICHE_STOP_WORDS)


def junk_sql(h, title, snippet, w=DATA_LISTS):
    blob = f"lower({title} || ' ' || {snippet})"
    return (f"({in_domains_sql(h, w['domains'])} OR regexp_matches({h}, {q(w['edu'])}) OR {contains_any_sql(h, w['info'])} "
            f"OR regexp_matches({h}, {q(w['media'])}) OR regexp_matches({blob}, {q(w['article'])}))")


_TOKENS = "regexp_extract_all(lower({0}), '[а-яёa-z0-9]{{4,}}')"


def _query_match_sql(query, blob):
    t = _TOKENS.format(query)
    return f"(len({t}) = 0 OR len(list_filter({t}, lambda w: contains({blob}, substring(w, 1, 5)))) > 0)"


def _static_match(text, blob):
    words = re.findall("[а-яёa-z0-9]{4,}", text.lower())
    return contains_any_sql(blob, [w[:5] for w in words])


def _stems(stop):
    words = [w for t in W.BRIEF_QUERIES + (W.NICHE,) for w in re.findall("[а-яёa-z0-9]{4,}", t.lower())]
    return [w[:6] for w in words if w not in stop]


def relevant_sql(h, title, snippet, hit_queries, w=DATA_LISTS):
    blob = f"lower({title} || ' ' || {snippet} || ' ' || {h})"
    own = f"len(list_filter({hit_queries}, lambda x: {_query_match_sql('x', blob)})) > 0"
    brief = " OR ".join(_static_match(t, blob) for t in W.BRIEF_QUERIES)
    return (f"(NOT {junk_sql(h, title, snippet, w)} AND ({own} OR {brief} OR {contains_any_sql(blob, _stems(w['stop']))} "
            f"OR {contains_any_sql(blob, w['signals'])}))")


def region_named_sql(text):
    needles = []
    for r in W.REGIONS:
        needles += [r, *W.REGION_ALIASES.get(r, ())]
        needles += [r[: -len(s)].strip() for s in W.REGION_SUFFIXES
                    if r.endswith(s) and len(r[: -len(s)].strip()) >= 4]
    return contains_any_sql(f"lower({text})", needles)


_OWN = f"({in_domains_sql('{h}', (W.CLIENT,))} OR {in_domains_sql('{h}', W.EXCLUDE)})"
_AGG = (f"({in_domains_sql('{h}', W.AGGREGATORS)} OR contains({{h}}, '.google.') OR ends_with({{h}}, '.google.com'))")
_CLASS = f"CASE WHEN {_OWN} THEN '{V.STATUS_EXCLUDED}' WHEN {_AGG} THEN '{V.STATUS_AGGREGATOR}' ELSE '{V.STATUS_CANDIDATE}' END"
REGION_TEXT = "title || ' ' || snippet || ' ' || array_to_string(queries, ' ')"
JUDGED = f"""{BASE}, judged AS (
  SELECT *, CASE WHEN {_CLASS.replace('{h}', 'domain')} <> '{V.STATUS_CANDIDATE}' THEN 'excluded'
    WHEN brief_id IN ('fr', 'es') AND {region_named_sql(REGION_TEXT)} THEN 'region'
    WHEN NOT {relevant_sql('domain', 'title', 'snippet', 'queries')} THEN 'irrelevant' END AS reject_reason
  FROM grouped)"""
_START = "lower(substring(html, 1, 3000))"
ALIVE = f"(length(html) >= 200 AND NOT {contains_any_sql(_START, V.PARKING_PHRASES)})"
_N = W.by_brief_sql(W.SITES)
CHOSEN = f"""{JUDGED},
live AS (SELECT url, bool_or({ALIVE}) AS alive FROM pages GROUP BY url),
kept AS (SELECT j.*, coalesce(l.alive, false) AS alive, {_N} AS most,
           greatest({_N} + 20, CAST(floor({_N} * 1.4) AS INTEGER)) AS w,
           row_number() OVER (PARTITION BY brief_id ORDER BY len(queries) DESC, domain) AS rank
         FROM judged j LEFT JOIN live l ON l.url = j.first_url WHERE reject_reason IS NULL),
tiers AS (SELECT kept.*, brief_id <> 'de' AND rank <= w AS in_probe,
            CASE WHEN brief_id = 'de' OR (rank <= w AND alive) THEN 0 WHEN rank > w THEN 1 END AS tier
          FROM kept),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY tier, rank) AS pick
                          FROM tiers WHERE tier IS NOT NULL) WHERE pick <= most)"""
_RAWLIST = "(' WWW.' || source || '.com ,' || lang || '\n' || lang || ',,Q ')"
_PARTS = f"list_filter(list_transform(regexp_split_to_array({_RAWLIST}, '[,\n]'), lambda p: trim(p)), lambda p: p <> '')"
_PH = "SELECT doc_id, unnest(string_split_regex(text, '[.\n]')) AS raw, generate_subscripts(string_split_regex(text, '[.\n]'), 1) - 1 AS pos FROM documents"
_RE_I = lambda p: q(p.replace("(?iuU)", "(?i)").replace("(?iu)", "(?i)"))
_SQUEEZED = "regexp_replace(trim(raw, ' \t\r\f\v\n' || chr(160)), '[\\s\\x{A0}\\x{2028}\\x{85}]+', ' ', 'g')"
_MARKS = "·|-—–:;,."
_LOW = "lower(raw)"
_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
_SENSE_WORDS = f"list_filter(regexp_extract_all(lower(raw), '[а-яёa-z]{{4,}}'), lambda w: w NOT IN ({', '.join(q(w) for w in V.PHRASE_STOP_WORDS)}))"
_SENSE = f"({contains_any_sql(_LOW, V.SERVICE_HINTS)} OR len({_SENSE_WORDS}) >= 2)"
_CAPS = r"(len(regexp_extract_all(raw, '\p{L}')) >= 6 AND len(regexp_extract_all(raw, '\p{Lu}')) > len(regexp_extract_all(raw, '\p{L}')) * 0.65)"
_BW = "regexp_extract_all(lower(raw), '[a-zа-яё0-9]+')"
_HITW = "list_filter(" + _BW + ", lambda w: len(list_filter(['thereon', 'schung', 'whou'], lambda b: contains(b, w) OR contains(w, b))) > 0)"
_TW = _WORDS.format("trim(lower(raw))")
_QUERY_LIKE = (f"len({_TW}) >= 2 AND ({_TW})[1] NOT IN ({', '.join(q(w) for w in V.BAD_QUERY_START)}) AND (regexp_matches("
               f"trim(lower(raw)), {q('^(?:' + '|'.join(V.QUERY_STARTERS) + ')')}) OR (len({_TW}) >= 3 AND {_SENSE}))")
_JUNK = (f"regexp_matches(trim(lower(raw)), {_RE_I(V.SECTION_JUNK)}) OR ({_CAPS} AND length(raw) >= 10) OR (len({_TW}) <= 4 "
         f"AND {contains_any_sql(_LOW, V.SECTION_WORDS)} AND NOT {contains_any_sql(_LOW, V.SECTION_EXCUSES)})")

SQL = {
    "q_hits_from_xml": f"""WITH {HITS_SQL} SELECT pos AS doc_id,
        CASE WHEN engine = 'e4' THEN '' ELSE url END AS url, CASE WHEN engine = 'e4' THEN '' ELSE domain END AS domain,
        CASE WHEN engine = 'e4' THEN '' ELSE trim(regexp_replace(title, '[\\x00-\\x1F]', ' ', 'g')) END AS title,
        CASE WHEN engine = 'e4' THEN 0 ELSE CAST(length(trim(regexp_replace(snippet, '[\\x00-\\x1F]', ' ', 'g'))) AS INTEGER) END AS snippet_chars,
        CASE WHEN engine = 'e4' THEN '[15] none' ELSE '' END AS error FROM hits""",
    "q_hits_first_capped": f"""WITH {HITS_SQL}, {FIRST_SQL}
        SELECT brief_id, query, domain, pos, url, CAST(rank_in_query AS INTEGER) AS rank_in_query FROM first_hits""",
    "q_hits_by_domain": f"""{BASE} SELECT brief_id, domain, title, snippet, first_url, array_to_string(urls, ' ') AS urls,
        array_to_string(engines, ',') AS engines, array_to_string(queries, ',') AS queries FROM grouped""",
    "q_hit_stats": f"""WITH {HITS_SQL}, {FIRST_SQL}, b AS (SELECT unnest([{', '.join(q(n) for n, _ in W.BRIEFS)}]) AS brief_id)
        SELECT brief_id, count(f.pos) AS raw_hits, count(DISTINCT f.domain) AS unique_domains,
        CAST({len(W.BRIEF_QUERIES)} AS BIGINT) AS queries FROM b LEFT JOIN first_hits f USING (brief_id) GROUP BY brief_id""",
    "q_query_errors": """SELECT user_id AS brief_id, 'q' || event_id || ': HTTP ' || props AS error
        FROM events WHERE event_type = 'error'""",
    "q_hits_union": f"""WITH {HITS_SQL} SELECT CASE WHEN brief_id IN ('en', 'de') THEN brief_id END AS origin,
        CASE WHEN brief_id IN ('en', 'de') THEN engine END AS engine, count(*) AS n FROM hits GROUP BY 1, 2""",
    "q_hits_fallback": f"""WITH {HITS_SQL}, h AS (SELECT *, pos % 3 AS page, length(snippet) > 6000 AS main FROM hits),
        m AS (SELECT *, min(page) OVER (PARTITION BY brief_id, query) AS first_page FROM h
              WHERE NOT main AND (brief_id, query) NOT IN (SELECT (brief_id, query) FROM h WHERE main))
        SELECT brief_id, query, pos, page FROM h WHERE main UNION ALL
        SELECT brief_id, query, pos, page FROM m WHERE page = first_page""",
    "q_domain_class": f"""WITH p AS (SELECT page_id, {host_sql('url')} AS host FROM pages)
        SELECT page_id, host, {_OWN.replace('{h}', 'host')} AS excluded, {_AGG.replace('{h}', 'host')} AS aggregator,
        {in_domains_sql('host', W.AGGREGATORS)} AS listed, {_CLASS.replace('{h}', 'host')} AS domain_class FROM p""",
    "q_catalog_domains": f"""WITH {HITS_SQL} SELECT brief_id, domain, arg_max(url, pos) AS url FROM hits
        WHERE {in_domains_sql('domain', W.CATALOGS)} GROUP BY brief_id, domain""",
    "q_junk": f"WITH {HITS_SQL} SELECT pos, {junk_sql('domain', 'title', 'snippet')} AS junk FROM hits",
    "q_relevance": f"WITH {HITS_SQL} SELECT pos, {relevant_sql('domain', 'title', 'snippet', '[query]')} AS relevant FROM hits",
    "q_region_detect": "SELECT doc_id, CASE " + " ".join(
        f"WHEN contains(lower(text), {q(n)}) THEN {q(n)}" for n in sorted(W.REGION_NAMES, key=lambda n: (-len(n), n)))
        + " END AS region FROM documents",
    "q_region_filter": f"""SELECT doc_id, {region_named_sql('text')} AS include, NOT {region_named_sql('text')} AS exclude,
        true AS hit_include, NOT {region_named_sql('text')} AS hit_exclude FROM documents""",
    "q_reject_reasons": f"""{JUDGED} SELECT brief_id, coalesce(reject_reason, 'kept') AS reason, count(*) AS n
        FROM judged GROUP BY 1, 2""",
    "q_reject_defaults": f"""{BASE}, judged AS (
        SELECT *, CASE WHEN {_OWN.replace('{h}', 'domain')} OR {in_domains_sql('domain', V.AGGREGATOR_DOMAINS)}
            OR contains(domain, '.google.') OR ends_with(domain, '.google.com') THEN 'excluded'
          WHEN brief_id IN ('fr', 'es') AND {contains_any_sql(f"lower({REGION_TEXT})", W.REGIONS)} THEN 'region'
          WHEN NOT {relevant_sql('domain', 'title', 'snippet', 'queries', DEFAULT_LISTS)} THEN 'irrelevant' END AS reject_reason
        FROM grouped)
        SELECT brief_id, coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1, 2""",
    "q_alive": f"""SELECT page_id, NOT contains(url, 'spam-farm') AND {ALIVE} AS alive,
        NOT contains(url, 'spam-farm') AS usable FROM pages""",
    "q_candidates_cut": f"""{CHOSEN} SELECT brief_id, domain, CAST(pick AS INTEGER) AS pick, CAST(rank AS INTEGER) AS rank,
        in_probe, alive FROM chosen""",
    "q_probe_counts": f"""{CHOSEN} SELECT brief_id, count(*) AS checked, count(*) FILTER (WHERE alive) AS alive,
        count(*) FILTER (WHERE NOT alive) AS dead FROM kept WHERE rank <= w GROUP BY brief_id""",
    "q_list_fields": f"""SELECT doc_id,
        lower(source) || '.com|' || lang || '|q' AS domains,
        array_to_string(list_transform({_PARTS}, lambda p: lower(p)), '|') AS regions,
        array_to_string({_PARTS}, '|') AS queries,
        'WWW.' || source || '.com|' || lang || '|Q' AS distinct_queries, {len(V.DEFAULT_QUERIES)} AS default_queries,
        CASE WHEN lang = 'en' THEN 0 ELSE {len(V.DEFAULT_QUERIES)} END AS quick_queries,
        CASE WHEN lang = 'en' THEN source || '.com|' || lang || '|' || lang || '|q' ELSE '' END AS seeds FROM documents""",
    "q_exclude_list": f"""SELECT page_id, {host_sql('url')} || ', ' || {q(', '.join(V.STANDARD_EXCLUDE))} AS excludes FROM pages""",
    "q_error_class": """WITH t AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
        c AS (SELECT *, k + 400 + CASE WHEN k > 50 THEN 60 ELSE 0 END AS code FROM t)
        SELECT event_id, CASE event_type WHEN 'view' THEN 'empty' WHEN 'click' THEN 'timeout' WHEN 'signup' THEN 'tls'
          WHEN 'error' THEN CASE WHEN code IN (401, 403) THEN 'forbidden' WHEN code = 404 THEN 'not_found'
            WHEN code >= 500 THEN 'server_error' ELSE 'http_error' END
          ELSE 'other' END AS error_class FROM c""",
    "q_labels": f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN {q(V.STATUS_LABELS['done'])}
          WHEN 'O' THEN {q(V.STATUS_LABELS['running'])}
          ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'other' ELSE {q(V.NO_LABEL)} END END AS label,
        CASE WHEN o_orderpriority = '5-LOW' THEN {q(V.NO_OPERATOR)} ELSE o_orderpriority END AS operator FROM orders""",
    "q_locale": """SELECT doc_id, CASE WHEN contains(lower(text), 'thereon') THEN 213 WHEN contains(lower(text), 'schung') THEN 1
        WHEN contains(lower(text), 'queda') THEN 16 WHEN contains(lower(text), 'whou') THEN 192
        WHEN contains(lower(text), 'src1') THEN 47 WHEN contains(source, 'src1') THEN 47 END AS locale FROM documents""",
    "q_year_mark": r"""SELECT doc_id, n_chars = 1024 AS year,
        regexp_matches(text, '(^|[^\p{L}\p{N}_])2024($|[^\p{L}\p{N}_])') AS in_text FROM documents""",
    "q_clean_phrase": f"""WITH p AS ({_PH}), t AS (
        SELECT doc_id, CAST(pos AS INTEGER) AS pos,
          trim(regexp_replace({_SQUEEZED}, {_RE_I(V.LABEL_PREFIX)}, ''), {q(_MARKS)}) AS s FROM p)
        SELECT doc_id, pos, CASE WHEN length(s) BETWEEN 4 AND 90 AND NOT regexp_matches(s, {_RE_I(V.SKIP_PHRASE)})
          AND NOT regexp_matches(s, {_RE_I(V.SECTION_JUNK)}) AND NOT regexp_matches(s, {_RE_I(V.PROMO)})
          AND lower(s) NOT IN ({', '.join(q(w) for w in V.PHRASE_STOP_WORDS)})
          AND NOT regexp_matches(s, '^[0-9\\s+().-]+$') THEN s END AS phrase FROM t""",
    "q_phrase_tests": f"""WITH p AS ({_PH}) SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_CAPS} AS caps,
        len({_BW}) > 0 AND len({_HITW}) >= greatest(1, len({_BW}) // 2) AS brand, {_SENSE} AS sense,
        {_QUERY_LIKE} AS query_like, {_JUNK} AS junk
        FROM p""",
    "q_hit_blob": f"WITH {HITS_SQL} SELECT pos, md5(title || ' ' || snippet || ' ' || query || ' ' || engine) AS blob FROM hits",
}
