"""Run store: summaries, listing, progress, resuming, comparison."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.lists import operator_name, query_list, status_label
from contactlake.functions.url import host

FINISHED_SITE = ("success", "error", "skip")


def summarize_runs(runs: DataFrame) -> DataFrame:
    """List item per run.  Counts come from the row's own arrays; nothing is shuffled."""
    b = F.col("brief")
    queries = query_list(b["queries"], distinct=True, default=())
    regions = F.filter(F.transform(F.split(F.coalesce(b["regions"], F.lit("")), ","), lambda r: F.trim(r)), lambda r: r != "")
    return runs.select(
        "id", "status", status_label(F.col("status")).alias("status_label"),
        operator_name(b["operatorName"]).alias("operator_name"),
        F.coalesce(b["clientName"], F.lit("")).alias("client_name"),
        F.coalesce(b["clientSite"], F.lit("")).alias("client_site"),
        F.substring(F.coalesce(b["niche"], F.lit("")), 1, 120).alias("niche"),
        queries.alias("queries"), F.size(queries).alias("queries_count"),
        regions.alias("regions"), F.size(regions).alias("regions_count"),
        F.coalesce(b["regionMode"], F.lit("include")).alias("region_mode"),
        F.coalesce(F.size("results"), F.lit(0)).alias("sites_count"),
        F.size(F.filter("results", lambda r: F.coalesce(r["p1"], F.lit("")) != "")).alias("phones_count"),
        "created_at", "updated_at", "is_demo",
    )


def of_operator(rows: DataFrame, name: Column | str, column: str = "operator_name") -> DataFrame:
    """Rows of one operator; case does not matter, a blank name is the default name."""
    wanted = F.lit(name) if isinstance(name, str) else name
    return rows.where(F.lower(operator_name(F.col(column))) == F.lower(operator_name(wanted)))


def latest_runs(rows: DataFrame, limit: int = 100) -> DataFrame:
    return rows.orderBy(F.col("created_at").desc(), F.col("id")).limit(max(1, min(500, limit)))


def count_runs(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def page_of(rows: DataFrame, page: int, *order: Column, size: int = V.PAGE_SIZE) -> DataFrame:
    """One page of an ordered table; the page number is clamped to the existing pages."""
    total = rows.count()
    last = max(1, -(-total // size))
    at = max(1, min(page, last))
    return rows.orderBy(*order).offset((at - 1) * size).limit(size)


def progress(runs: DataFrame, steps: DataFrame, sites: DataFrame | None = None,
             probes: DataFrame | None = None) -> DataFrame:
    """Percent done and current step per run.

    ``runs``: run_id, status; ``steps``: run_id, step, status; ``sites``: run_id, site,
    status; ``probes``: run_id, checked, total.  Done steps count 16, a running step 8 plus
    a share of its own progress.
    """
    n = len(V.STEPS)
    ranked = reduce(lambda c, i: c.when(F.col("step") == V.STEPS[i], i), range(1, n),
                    F.when(F.col("step") == V.STEPS[0], 0))
    running = F.col("status") == "running"
    base = steps.withColumn("at", ranked).where("at is not null").groupBy("run_id").agg(
        F.sum(F.when(F.col("status") == "done", 100 // n).when(running, 100 // (2 * n)).otherwise(0)).alias("base"),
        F.max_by("step", F.when(running, F.col("at"))).alias("current"),
        F.bool_or(running & (F.col("step") == "filter")).alias("filtering"),
        F.bool_or(running & (F.col("step") == "crawl")).alias("crawling"),
    )
    out = runs.select("run_id", "status").join(base, "run_id", "left")
    extra = F.lit(0)
    if probes is not None:
        out = out.join(probes.select("run_id", "checked", "total"), "run_id", "left")
        extra = extra + F.when(
            F.col("filtering") & (F.col("total") > 0),
            F.floor(F.lit(100 // n * 0.75) * F.col("checked") / F.col("total"))).otherwise(0)
    if sites is not None:
        done = sites.groupBy("run_id").agg(
            F.count_if(F.col("status").isin(*FINISHED_SITE)).alias("done_sites"), F.count("*").alias("all_sites"))
        out = out.join(done, "run_id", "left")
        extra = extra + F.when(
            F.col("crawling") & (F.col("all_sites") > 0),
            F.floor(F.lit(100 // n * 0.5) * F.col("done_sites") / F.col("all_sites"))).otherwise(0)
    cap = F.when(F.col("status").isin("running", "pending"), 99).otherwise(100)
    return out.select(
        "run_id", "status",
        F.when(F.col("status") == "done", 100)
        .otherwise(F.least(F.coalesce("base", F.lit(0)) + F.coalesce(extra, F.lit(0)), cap)).cast("int").alias("progress"),
        F.when(F.col("status") == "done", "").otherwise(F.coalesce("current", F.lit(""))).alias("current_step"),
    )


def latest_site_status(log: DataFrame, *order: str) -> DataFrame:
    """Last logged status per (run, site)."""
    return log.where(F.col("site").isNotNull()).groupBy("run_id", "site").agg(
        F.max_by("status", F.struct(*order)).alias("status"))


def reset_running(steps: DataFrame) -> DataFrame:
    """Steps of a stopped run: running ones are pending again."""
    return steps.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def can_resume(active: Column | None = None) -> Column:
    """Whether a decoded run can go on; ``active``: it is being worked on right now."""
    p = F.col("pipeline")
    active = F.lit(False) if active is None else active
    filled = F.coalesce(F.size(p["checkpoint"]["alive_candidates"]) > 0, F.lit(False))
    has_rows = F.coalesce(F.size("results") > 0, F.lit(False))
    any_done = reduce(lambda a, b: a | b, [F.coalesce(p[s] == "done", F.lit(False)) for s in V.STEPS])
    logged = F.coalesce(F.size(p["logs"]) >= 2, F.lit(False))
    return (
        F.when(F.col("status") == "running", ~active)
        .when(~F.col("status").isin("stopped", "error"), False)
        .otherwise(filled | has_rows | any_done | logged)
    )


def same_client(summaries: DataFrame, statuses: tuple[str, ...], newest: int | None = None,
                exact_site: bool = False) -> DataFrame:
    """Latest run per client in one of the statuses.

    ``newest`` looks at so many of the newest runs only (the reference: 30), whatever their client and
    status; None at all.  ``exact_site`` compares the whole address, else the host.
    """
    site = F.regexp_replace(F.lower(F.trim("client_site")), "/+$", "") if exact_site else host(F.trim("client_site"))
    recent = summaries if newest is None else summaries.orderBy(F.col("created_at").desc(), F.col("id")).limit(newest)
    return (
        recent.withColumn("client_key", site).where(F.col("client_key") != "")
        .where(F.col("status").isin(*statuses))
        .groupBy("client_key")
        .agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))
    )


def compare_runs(a: DataFrame, b: DataFrame, key: str = "site") -> DataFrame:
    """Sites new in b, removed since a, and common to both."""
    sides = a.select(key, F.lit(1).alias("side")).unionByName(b.select(key, F.lit(2).alias("side")))
    return (
        sides.groupBy(key).agg(F.bit_or("side").alias("sides"))
        .select(key, F.when(F.col("sides") == 3, "common").when(F.col("sides") == 2, "new")
                .otherwise("removed").alias("change"))
    )


def newest_version(versions: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key of an append-only table."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")

