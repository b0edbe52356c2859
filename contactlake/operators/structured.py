"""Structured data of pages (JSON-LD) as VARIANT values.

Each block is parsed once; items, names and numbers are paths into the parsed value.  Narrow: no
shuffle and no Python.  The page parser (``flatten``) reads the same blocks for whole pages, at any
depth; this form serves tables of structured data, whose shape is only known by its paths.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json\b[^>]*>(.*?)</script"
ORGANISATIONS = ("Organization", "LocalBusiness", "Corporation")


def structured_blocks(html: Column) -> Column:
    """Parsed JSON-LD blocks of a page: array<variant>, in page order; a block that is not JSON is left out."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_BLOCK), F.lit(1))
    return F.filter(F.transform(raw, F.try_parse_json), lambda v: v.isNotNull())


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: Column, path: str = "$") -> Column:
    """A string or number at a path; null for what is nested."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(~kind.rlike("^(OBJECT|ARRAY|VOID)"), F.trim(F.try_variant_get(v, path, "string")))


def structured_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per item of the structured data of each page: the other columns, pos, item.

    Items are the blocks, the members of a block that is a list, and behind an item the members of its
    ``@graph``.  Pages without structured data have no row.
    """
    keep = [c for c in pages.columns if c != html]
    blocks = structured_blocks(F.col(html))
    tops = F.flatten(F.transform(blocks, lambda v: F.coalesce(_list(v, "$"), F.array(v))))
    items = F.flatten(F.transform(tops, lambda v: F.concat(F.array(v), F.coalesce(
        _list(v, "$['@graph']"), F.array().cast("array<variant>")))))
    return pages.select(*keep, F.posexplode_outer(items).alias("pos", "item")).where(F.col("pos").isNotNull())


def item_phones(item: Column) -> Column:
    """Numbers as written under telephone and phone, and of the contact points, in this order."""
    def all_of(path: str) -> Column:
        v = F.try_variant_get(item, path, "variant")
        return F.coalesce(_list(item, path), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))

    direct = F.flatten(F.array(*[F.transform(all_of(f"$.{k}"), lambda t: _text(t)) for k in ("telephone", "phone")]))
    points = F.transform(all_of("$.contactPoint"), lambda p: F.coalesce(_text(p, "$.telephone"), _text(p)))
    return F.filter(F.concat(direct, points), lambda t: t.isNotNull() & (t != ""))


def item_columns(items: DataFrame, item: str = "item") -> DataFrame:
    """The VARIANT as columns type, name, legal_name (of organisations), phones; others pass through."""
    v = F.col(item)
    kind = _text(v, "$['@type']")
    return items.select(
        *[c for c in items.columns if c != item], kind.alias("type"), _text(v, "$.name").alias("name"),
        F.when(kind.isin(*ORGANISATIONS), _text(v, "$.legalName")).alias("legal_name"), item_phones(v).alias("phones"))
