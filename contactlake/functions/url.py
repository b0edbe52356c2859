"""URL and host expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions import let

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def netloc(url: Column) -> Column:
    """Lower-cased authority part, port kept; the scheme is optional."""
    with_scheme = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_extract(url, r"^([^/?#]*)", 1)
    return F.lower(F.when(F.contains(url, F.lit("://")), with_scheme).otherwise(bare))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def host(url: Column) -> Column:
    """Host without a leading ``www.``; empty for text without one."""
    return strip_www(netloc(url))


def host_without_port(url: Column) -> Column:
    return F.regexp_replace(host(url), r":[0-9]*$", "")


def path_of(url: Column) -> Column:
    """Path without the parameters of the last segment; empty when there is none."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; paths without them are not touched."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def resolve(ref: Column, base: Column) -> Column:
    """Absolute form of a reference found on page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(ref.rlike(_SCHEME), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, _drop_dots(ref_path), tail))
        .when(ref.startswith("?"), F.concat(origin, base_path, ref))
        .when(ref.startswith("#"), F.concat(no_fragment, ref))
        .otherwise(F.concat(origin, _drop_dots(F.concat(folder, ref_path)), tail))
    )


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """http(s) scheme, lower-cased host, path (default ``/``) and query; NULL when there is no host."""
    raw = F.nullif(F.trim(url), F.lit(""))
    if base is not None:
        return let(resolve(raw, base), lambda absolute: normalize_url(absolute))
    raw = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = netloc(raw)
    path = path_of(raw)
    query = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    return F.when(
        authority != "",
        F.concat(
            F.when(scheme.isin("http", "https"), scheme).otherwise("https"), F.lit("://"),
            authority,
            F.when(path == "", "/").otherwise(path),
            F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def same_host(url: Column, root: Column) -> Column:
    """Same site or a subdomain of it; ``root`` is a host without ``www.``."""
    h = host(url)
    return (h == root) | h.endswith(F.concat(F.lit("."), root))


def clean_site_input(text: Column) -> Column:
    """Site URL from free text: the first http(s) URL, else a bare host; NULL without a dotted host."""
    t = F.trim(text)
    found = F.regexp_extract(t, r"""(?i)https?://[^\s<>"'·|]+""", 0)
    bare = rf"(?iuU)[\w.\-]+\.({'|'.join(V.SITE_ZONES)})(?![\w])"
    ending = r"[.,;)]+$"
    site = (
        F.when(found != "", F.regexp_replace(found, ending, ""))
        .when(
            ~F.contains(t, F.lit("://")) & t.rlike(bare),
            F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace(t, r"^/+", ""), ending, "")),
        )
        .otherwise(t)
    )
    return let(site, lambda s: let(
        normalize_url(s), lambda url: F.when(F.contains(netloc(url), F.lit(".")), url)))


def host_suffixes(h: Column) -> Column:
    """``a.b.c`` -> [``a.b.c``, ``b.c``, ``c``]: turns the subdomain rule into equality."""
    parts = F.split(h, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
