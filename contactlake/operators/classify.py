"""Row classification: domain classes, junk, relevance, regions, live pages.

All tests are column expressions, so they run inside the scan stage.  A host list
is checked through the host's suffixes (equality), never with ``like``.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.lists import contains_any, one_of
from contactlake.functions.text import hit_blob
from contactlake.functions.url import host_suffixes, strip_www


def in_domains(host: Column, domains) -> Column:
    """Host equals or is a subdomain of a listed domain (Python sequence or array column)."""
    suffixes = host_suffixes(strip_www(F.lower(host)))
    if isinstance(domains, Column):
        return F.coalesce(F.arrays_overlap(suffixes, domains), F.lit(False))
    return F.exists(suffixes, lambda s: s.isin(*domains)) if domains else F.lit(False)


def flag_domains(df: DataFrame, host: str, domains: DataFrame, flag: str) -> DataFrame:
    """The same rule against a table of domains of any size (column ``domain``).

    Only distinct hosts are exploded into suffixes; both joins are equi-joins.
    """
    known = (
        df.select(host).distinct()
        .select(host, F.explode(host_suffixes(strip_www(F.lower(F.col(host))))).alias("domain"))
        .join(domains.select("domain"), "domain", "left_semi")
        .select(host).distinct()
    )
    return (
        df.join(known.withColumn(flag, F.lit(True)), host, "left")
        .withColumn(flag, F.coalesce(flag, F.lit(False)))
    )


def is_excluded(host: Column, exclude, client: Column) -> Column:
    own = in_domains(host, F.array(client)) & (client != "")
    return F.coalesce(own, F.lit(False)) | in_domains(host, exclude)


def is_aggregator(host: Column, domains=V.AGGREGATOR_DOMAINS) -> Column:
    h = F.lower(host)
    return in_domains(h, domains) | F.contains(h, F.lit(".google.")) | h.endswith(".google.com")


def is_catalog(host: Column, domains=V.CATALOG_DOMAINS) -> Column:
    return in_domains(host, domains)


def is_junk(host: Column, title: Column, snippet: Column, domains=V.JUNK_DOMAINS,
            info_parts=V.INFO_HOST_PARTS, edu=V.EDU_HOSTS, media=V.MEDIA_HOSTS,
            article=V.ARTICLE_TEXT) -> Column:
    """News, banks, universities, reference texts: not a competitor."""
    h = strip_www(F.lower(host))
    return (
        in_domains(h, domains) | h.rlike(edu) | contains_any(h, info_parts) | h.rlike(media)
        | F.lower(hit_blob(title, snippet)).rlike(article)
    )


def domain_class(host: Column, exclude, client: Column, aggregators=V.AGGREGATOR_DOMAINS) -> Column:
    return (
        F.when(is_excluded(host, exclude, client), V.STATUS_EXCLUDED)
        .when(is_aggregator(host, aggregators), V.STATUS_AGGREGATOR)
        .otherwise(V.STATUS_CANDIDATE)
    )


# --- relevance ---------------------------------------------------------------

_TOKEN = "([а-яёa-z0-9]{4,})"


def _tokens(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(1))


def query_matches(query: Column, blob: Column, synonyms=V.QUERY_SYNONYMS) -> Column:
    """A word of the query, or its five-letter start, or a synonym occurs in the text.

    A query without a word of four letters matches everything.
    """
    low = F.lower(query)
    ws = _tokens(low)
    by_synonym = reduce(
        lambda a, b: a | b,
        [F.contains(low, F.lit(n)) & contains_any(blob, vs) for n, vs in synonyms], F.lit(False),
    )
    # a contained word contains its own start, so testing the start covers both cases
    return (F.size(ws) == 0) | F.exists(ws, lambda w: F.contains(blob, F.left(w, F.lit(5)))) | by_synonym


def niche_stems(texts: Column, stop=V.NICHE_STOP_WORDS, root=V.NICHE_ROOT) -> Column:
    low = F.transform(texts, lambda t: F.lower(F.coalesce(t, F.lit(""))))
    tokens = F.filter(F.flatten(F.transform(low, _tokens)), lambda t: ~one_of(t, stop))
    rooted = F.transform(F.filter(low, lambda t: F.contains(t, F.lit(root))), lambda t: F.lit(root))
    return F.array_distinct(F.concat(rooted, F.transform(tokens, lambda t: F.left(t, F.lit(6)))))


def is_relevant(host: Column, title: Column, snippet: Column, hit_queries: Column,
                brief_queries: Column, niche: Column, junk: Column | None = None,
                signals=V.COMMERCIAL_SIGNALS, synonyms=V.QUERY_SYNONYMS,
                stop=V.NICHE_STOP_WORDS, root=V.NICHE_ROOT) -> Column:
    blob = F.lower(hit_blob(title, snippet, host))
    junk = is_junk(host, title, snippet) if junk is None else junk
    stems = niche_stems(F.concat(brief_queries, F.array(niche)), stop, root)
    wanted = (
        F.exists(hit_queries, lambda q: query_matches(q, blob, synonyms))
        | F.exists(brief_queries, lambda q: query_matches(q, blob, synonyms))
        | F.exists(stems, lambda s: F.contains(blob, s))
        | contains_any(blob, signals)
    )
    return ~junk & wanted


# --- regions -------------------------------------------------------------------

def region_needles(region: Column, aliases=V.REGION_ALIASES, suffixes=V.REGION_SUFFIXES) -> Column:
    """Strings whose presence names the region: the name, its aliases, its stem."""
    r = F.trim(F.lower(region))
    none = F.array().cast("array<string>")
    named = reduce(
        lambda c, kv: F.when(r == kv[0], F.array(*[F.lit(a) for a in kv[1]])).otherwise(c),
        aliases.items(), none,
    )
    stems = F.filter(
        F.transform(
            F.array(*[F.lit(s) for s in suffixes]),
            lambda s: F.when(r.endswith(s), F.trim(F.left(r, F.length(r) - F.length(s)))),
        ) if suffixes else none,
        lambda st: F.length(st) >= 4,
    )
    return F.filter(F.concat(F.array(r), named, stems), lambda n: n != "")


def regions_match(text: Column, regions: Column, mode: Column, **lists) -> Column:
    """include: some region is named; exclude: none is.  No regions: always true."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    named = F.exists(
        regions, lambda r: F.exists(region_needles(r, **lists), lambda n: F.contains(hay, n))
    )
    return F.when(F.size(regions) == 0, True).when(mode == "include", named).otherwise(~named)


def hit_region_ok(text: Column, regions: Column, mode: Column, **lists) -> Column:
    """At the hit stage a region list rejects only in exclude mode."""
    return F.when(mode == "exclude", regions_match(text, regions, F.lit("exclude"), **lists)).otherwise(True)


def all_regions() -> tuple[str, ...]:
    return tuple(sorted(name for *_, names in V.DISTRICTS for name in names))


def detect_region(text: Column, names=None) -> Column:
    """Longest region name contained in the text, NULL when there is none."""
    low = F.lower(text)
    ordered = sorted(names or all_regions(), key=lambda n: (-len(n), n))
    return F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in ordered])


# --- pages -------------------------------------------------------------------------

def is_alive(status: Column, html: Column, phone_required: Column | None = None) -> Column:
    """Live site: no error status, a body, no parking text at its start."""
    start = F.lower(F.substring(html, 1, 3000))
    ok = (
        (F.coalesce(status, F.lit(200)) < 400) & (F.length(html) >= 200)
        & ~contains_any(start, V.PARKING_PHRASES)
    )
    if phone_required is not None:
        ok = ok & phone_required
    return F.coalesce(ok, F.lit(False))


def body_usable(status: Column, html: Column) -> Column:
    """Rule for keeping a fetched page."""
    tagged = F.contains(F.lower(html), F.lit("<html"))
    return F.coalesce(
        (F.coalesce(status, F.lit(200)) < 400)
        & ((F.octet_length(html) >= 200) | tagged) & (tagged | (F.length(html) > 400)),
        F.lit(False),
    )
