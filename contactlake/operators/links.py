"""Links of pages: absolute form, best links per page, section pages, frontier."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.url import host, normalize_url, path_of, resolve, same_host
from contactlake.operators.flatten import FLAT_COLUMNS
from contactlake.session import cut_lineage, stage


def _keys(flat: DataFrame) -> list[str]:
    return [c for c in flat.columns if c not in FLAT_COLUMNS]


def _absolute(hrefs: Column, base: Column) -> Column:
    """Trimmed references -> normalised absolute urls; one step per transform, so no step repeats."""
    refs = F.filter(F.transform(hrefs, lambda h: F.trim(h)), lambda r: r != "")
    urls = F.transform(F.transform(refs, lambda r: resolve(r, base)), lambda u: normalize_url(u))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))


def _targets(base: Column) -> Column:
    """Distinct absolute link targets of a flat page in document order."""
    return _absolute(F.transform(F.filter("links", lambda k: k["href"].isNotNull()), lambda k: k["href"]), base)


def _own(urls: Column, base: Column) -> Column:
    """The urls on the site of ``base``, whose host is computed once per page."""
    return F.flatten(F.transform(
        F.array(host(base)), lambda root: F.filter(urls, lambda u: same_host(u, root))))


def page_links(flat: DataFrame, url: str = "url") -> DataFrame:
    """One row per (page, distinct target): ``pos``, ``target``, ``same_host``."""
    rows = flat.select(*_keys(flat), F.posexplode_outer(_targets(F.col(url))).alias("pos", "target"))
    return rows.where(F.col("target").isNotNull()).withColumn(
        "same_host", same_host(F.col("target"), host(F.col(url))))


def top_links(flat: DataFrame, url: str = "url", k: int = 8, hints: str = V.PATH_HINTS) -> DataFrame:
    """The k best same-site links per page: contact-like paths first, else document order.

    Scored and cut inside the row; no shuffle.
    """
    scored = F.transform(_own(_targets(F.col(url)), F.col(url)), lambda u, i: F.struct(
        F.when(path_of(u).rlike(hints), -15).otherwise(0).alias("minus_score"),
        i.alias("pos"), u.alias("target")))
    best = F.slice(F.array_sort(scored), 1, k)
    return (
        flat.select(*_keys(flat), F.posexplode_outer(best).alias("rank", "k")).where(F.col("k").isNotNull())
        .select(*_keys(flat), "rank", "k.target", (-F.col("k.minus_score")).alias("score"))
    )


def section_links(flat: DataFrame, site: str = "site", url: str = "url", k: int = 4,
                  hints: str = V.SECTION_HINTS) -> DataFrame:
    """Up to k links per site whose label or path hints at services, products or about pages.

    Input: the home pages.  Links on one page come in document order; the group limit
    keeps k rows per site in every map partition.
    """
    def labelled(k: Column) -> Column:
        label = F.lower(F.array_join(F.slice(F.col("strings"), k["s"] + 1, k["e"] - k["s"]), " "))
        return F.struct(F.trim(k["href"]).alias("ref"), label.rlike(hints).alias("by_label"))

    refs = F.filter(
        F.transform(F.filter("links", lambda k: k["href"].isNotNull()), labelled), lambda x: x["ref"] != "")
    whole = F.transform(refs, lambda x: F.struct(resolve(x["ref"], F.col(url)).alias("url"), x["by_label"].alias("by_label")))
    plain = F.transform(whole, lambda x: F.struct(normalize_url(x["url"]).alias("url"), x["by_label"].alias("by_label")))
    hinted = F.filter(plain, lambda x: x["url"].isNotNull() & (x["by_label"] | F.lower(path_of(x["url"])).rlike(hints)))
    targets = _own(F.array_distinct(F.transform(hinted, lambda x: x["url"])), F.col(url))
    order = Window.partitionBy(site).orderBy(url, "pos")
    return (
        flat.select(site, url, F.posexplode_outer(targets).alias("pos", "target")).where(F.col("target").isNotNull())
        .groupBy(site, "target").agg(F.min(F.struct(F.col(url), "pos")).alias("at"))
        .select(site, "target", "at.*")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(site, "rank", "target")
    )


def expand_frontier(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Urls reachable from the seeds in at most ``depth`` steps: (site, url, level).

    ``links``: (site, url, target); ``seeds``: (site, url).  Each level is one join on
    (site, url) and one anti join on what is known, then a reliable checkpoint, so the
    plan stays short and a lost executor costs one level at most.  The links are staged
    first, so pages behind them are parsed once.
    """
    links = stage(links.select("site", "url", "target"))
    known = cut_lineage(seeds.select("site", "url").distinct().withColumn("level", F.lit(0)))
    fresh = known
    for level in range(1, depth + 1):
        fresh = cut_lineage(
            fresh.join(links, ["site", "url"])
            .select("site", F.col("target").alias("url")).distinct()
            .join(known, ["site", "url"], "left_anti")
            .withColumn("level", F.lit(level))
        )
        known = known.unionByName(fresh)
    return known


def visit_order(path: Column, paths=("/",) + V.CONTACT_PATHS + V.ABOUT_PATHS) -> Column:
    """Position of a path in the visiting order, NULL for other paths; home is 0.

    A slash at the end makes no difference.
    """
    bare = F.regexp_replace(path, "/+$", "")
    trimmed = F.when(bare == "", "/").otherwise(bare)
    return F.coalesce(*[F.when(trimmed == p, F.lit(i)) for i, p in enumerate(paths)])


def page_budget(depth):
    """Pages visited at a depth (a number or a column)."""
    return max(4, 3 * depth) if isinstance(depth, int) else F.greatest(F.lit(4), depth * 3)
