"""List fields, labels and other small lookups."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.url import strip_www


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_list(text: Column) -> Column:
    """Comma or newline separated text -> trimmed, non-empty parts in order."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[,\n]")
    return F.filter(F.transform(parts, _strip), lambda p: p != "")


def domain_list(text: Column) -> Column:
    return F.array_distinct(
        F.filter(F.transform(split_list(text), lambda p: strip_www(F.lower(p))), lambda d: d != "")
    )


def region_list(text: Column) -> Column:
    return F.transform(split_list(text), F.lower)


def query_list(text: Column, distinct: bool = False, default: tuple[str, ...] = V.DEFAULT_QUERIES,
               quick: Column | None = None) -> Column:
    """Search phrases; an empty field takes the default list, except in quick mode."""
    items = split_list(text)
    items = F.array_distinct(items) if distinct else items
    filler = F.array(*[F.lit(q) for q in default]).cast("array<string>")
    if quick is not None:
        filler = F.when(quick, F.array().cast("array<string>")).otherwise(filler)
    return F.when(F.size(items) > 0, items).otherwise(filler) if default else items


def seed_domains(text: Column, quick: Column, default: tuple[str, ...] = V.SEED_DOMAINS) -> Column:
    """Candidate sites named by the brief; only in quick mode."""
    given = F.transform(split_list(text), lambda p: strip_www(F.lower(p)))
    seeds = F.when(F.size(given) > 0, given).otherwise(F.array(*[F.lit(d) for d in default]))
    return F.when(quick, seeds).otherwise(F.array().cast("array<string>"))


def exclude_list(client_domain: Column, standard: tuple[str, ...] = V.STANDARD_EXCLUDE) -> Column:
    """Client domain first, then the standard list, each once."""
    own = F.filter(F.array(client_domain), lambda d: d.isNotNull() & (d != ""))
    return F.array_distinct(F.concat(own, F.array(*[F.lit(d) for d in standard])))


def error_class(message: Column) -> Column:
    """Class of a fetch error text."""
    m = F.trim(F.regexp_replace(F.trim(F.coalesce(message, F.lit(""))), r"^error:", ""))
    low = F.lower(m)
    code = F.regexp_extract(low, r"^http .*?(\S+)$", 1)
    return (
        F.when((m == "empty") | (low == "unreachable"), "empty")
        .when(low.startswith("http ") & code.isin("401", "403"), "forbidden")
        .when(low.startswith("http ") & (code == "404"), "not_found")
        .when(low.startswith("http ") & (code.try_cast("int") >= 500), "server_error")
        .when(low.startswith("http "), "http_error")
        .when(contains_any(low, ("timeout", "timed out") + V.TIMEOUT_NAMES), "timeout")
        .when(contains_any(low, V.TLS_MARKERS), "tls")
        .otherwise("other")
    )


def status_label(status: Column) -> Column:
    """Display label; an unknown status is shown as it is."""
    known = reduce(
        lambda c, kv: c.when(F.lower(status) == kv[0], kv[1]), list(V.STATUS_LABELS.items())[1:],
        F.when(F.lower(status) == "done", V.STATUS_LABELS["done"]),
    )
    return F.coalesce(known, F.nullif(status, F.lit("")), F.lit(V.NO_LABEL))


def operator_name(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit(V.NO_OPERATOR))


def contains_any(text: Column, terms) -> Column:
    """Substring test against a fixed list: a chain of ``contains`` inside codegen, no join."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


def one_of(word: Column, words) -> Column:
    """The whole (short) text is one of the words: one pattern instead of one literal each."""
    return word.rlike(rf"^(?:{'|'.join(map(re.escape, words))})\z")


def phrase_contains(phrase: Column, terms) -> Column:
    """``contains_any`` for short phrases, as a single pattern."""
    return phrase.rlike("|".join(map(re.escape, terms)))


def count_contained(text: Column, terms) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0))


def first_contained(text: Column, pairs) -> Column:
    """Value of the first (term, value) pair whose term occurs in the text, else NULL."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(v)) for t, v in pairs])


def locale_code(query: Column, regions: Column, codes=V.LOCALE_CODES) -> Column:
    """Locale of a search: from the query text, else from the brief's regions."""
    return F.coalesce(first_contained(F.lower(query), codes), first_contained(F.lower(regions), codes))


def export_name(client_name: Column, run_id: Column, at: Column, ext: str, prefix: str = "run") -> Column:
    """``<client name> dd-MM-yyyy.<ext>`` with the date at UTC+3."""
    cleaned = F.regexp_replace(client_name, r"""[<>:"/\\|?*\n\r\t]""", "")
    cleaned = F.regexp_replace(cleaned, r"\s+", " ")
    cleaned = F.regexp_replace(F.trim(cleaned), r"^\.+|\.+$", "")
    base = F.coalesce(
        F.nullif(F.substring(cleaned, 1, 80), F.lit("")),
        F.concat(F.lit(prefix + "-"), F.substring(run_id, 1, 8)),
    )
    # counted in days, so that the session time zone has no say
    days = F.floor((F.unix_seconds(at) + 3 * 3600) / 86_400).cast("int")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "dd-MM-yyyy")
    return F.concat(base, F.lit(" "), day, F.lit("." + ext))
