"""Wide export, CSV sink, export gate, run upsert."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.phone import RU, NumberingPlan, normalize_digits


class ExportRefused(ValueError):
    """The run is not reviewed, or a marked-only selection is empty."""


def export_phones(plan: NumberingPlan = RU, limit: int = V.MAX_EXPORT_PHONES) -> Column:
    """Numbers to export from ``phones``, or from p1 and p2 when that list is empty."""
    raw = F.when(F.size("phones") > 0, F.col("phones")).otherwise(F.array("p1", "p2"))
    kept = F.filter(F.transform(raw, lambda p: normalize_digits(p, plan)), lambda p: p.isNotNull())
    return F.slice(kept, 1, limit)


def widen_phones(df: DataFrame, phones: str = "phones", width: int = V.MAX_EXPORT_PHONES) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != phones],
        *[F.coalesce(F.get(F.col(phones), F.lit(i)), F.lit("")).alias(f"phone_{i + 1}") for i in range(width)])


def export_width(leads: DataFrame, plan: NumberingPlan = RU, limit: int = V.MAX_EXPORT_PHONES) -> int:
    """Widest row of the selection, between 1 and the limit: a one-row aggregate."""
    n = leads.agg(F.max(F.size(export_phones(plan, limit)))).first()[0]
    return max(1, min(limit, n or 0))


def export_table(leads: DataFrame, width: int = V.MAX_EXPORT_PHONES, plan: NumberingPlan = RU) -> DataFrame:
    """Flat text columns: site, name, region, phone_1..n, source, status, mark."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    wide = widen_phones(
        leads.withColumn("phones", F.slice(export_phones(plan), 1, width)), width=width)
    return wide.select(
        text("site"), text("name"), text("region"), *[f"phone_{i + 1}" for i in range(width)],
        text("source"), text("status"),
        F.when(F.col("for_definition"), V.EXPORT_MARK).otherwise("").alias("mark"))


def exportable(leads: DataFrame, reviewed: bool, marked_only: bool = False) -> DataFrame:
    """The rows that may be exported; raises when the gate is shut."""
    if not reviewed:
        raise ExportRefused("the sources of this run are not marked as reviewed")
    if not marked_only:
        return leads
    rows = leads.where(F.coalesce("for_definition", F.lit(False)))
    if rows.isEmpty():
        raise ExportRefused("no row is marked for definition")
    return rows


def write_csv(table: DataFrame, path: str, labels: bool = True) -> None:
    """Semicolon CSV with a byte order mark before the first header cell.

    One file per partition; every file carries the header, so each opens on its own.
    """
    names = list(table.columns)
    if labels:
        wide = [f"{V.EXPORT_PHONE} {i + 1}" for i in range(sum(c.startswith("phone_") for c in names))]
        names = [*V.EXPORT_HEAD, *wide, *V.EXPORT_TAIL]
    names[0] = "﻿" + names[0]
    table.toDF(*names).write.mode("overwrite").option("sep", ";").option("header", True).option(
        "emptyValue", "").csv(path)


RUN_FIELDS = ("status", "brief_json", "pipeline_json", "results_json", "error", "is_demo")


def upsert_runs(runs: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Current run table after a set of partial updates.

    Only supplied (non-NULL) fields change, ``updated_at`` always; an unknown id is a new
    run with defaults.  Several updates of one id apply in ``seq`` order: the last supplied
    value of each field wins, which is one aggregate before the join.
    """
    last = updates.groupBy("id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"new_{f}") for f in RUN_FIELDS])
    fresh = {"status": F.lit("pending"), "pipeline_json": F.lit("{}"), "results_json": F.lit("[]"),
             "is_demo": F.lit(0), "brief_json": F.lit("{}")}
    joined = runs.withColumn("_old", F.lit(True)).join(
        last.withColumn("_new", F.lit(True)), "id", "full_outer")
    return joined.select(
        "id",
        *[F.coalesce(F.col(f"new_{f}"), F.col(f), F.when(F.col("_old").isNull(), fresh.get(f, F.lit(None))))
          .alias(f) for f in RUN_FIELDS],
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("_new"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
