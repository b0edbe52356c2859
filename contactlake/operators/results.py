"""The result grid: filter, sort, groups, totals, marks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import fixed_values as V

SEARCHED = ("site", "name", "offer", "p1", "p2", "source", "region")


def matches(status: str = "", phone_type: str = "", region: str = "", marked: bool | None = None,
            search: str = "") -> Column:
    """Grid filter; an empty argument does not restrict."""
    test = F.lit(True)
    if status:
        test = test & (F.col("status") == status)
    if phone_type:
        test = test & (F.coalesce(F.col("p1_type") == phone_type, F.lit(False))
                       | F.coalesce(F.col("p2_type") == phone_type, F.lit(False)))
    if region:
        test = test & (F.coalesce("region", F.lit("")) == region)
    if marked is not None:
        test = test & (F.coalesce("for_definition", F.lit(False)) == marked)
    if search:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in SEARCHED]))
        test = test & F.contains(hay, F.lit(search.lower()))
    return F.coalesce(test, F.lit(False))


def grid_order(column: str, descending: bool = False) -> list[Column]:
    """Any column as lower-cased text, ties in original order."""
    key = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return [key.desc() if descending else key.asc(), F.col("ord").asc()]


def _out() -> Column:
    return F.col("status").isin(V.STATUS_EXCLUDED, V.STATUS_AGGREGATOR)


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def result_stats(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(_filled("p1") | _filled("p2")).alias("with_phone"),
        F.count_if(F.coalesce("for_definition", F.lit(False))).alias("marked"),
        F.count_if(_out()).alias("excluded"),
    )


def region_groups(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("region", F.lit("")), F.lit(V.NO_REGION)).alias("region")
    return rows.groupBy(name).agg(F.count("*").alias("n"))


def with_district(rows: DataFrame, regions: DataFrame, region: str = "region") -> DataFrame:
    """``regions``: name, district_id, ... — the packaged dimension is broadcast by its reader."""
    return rows.join(regions.withColumnRenamed("name", region), region, "left")


def district_totals(regions: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected and all regions per district, and overall (district NULL).

    ``regions``: district, name; ``selected``: name.
    """
    flagged = regions.join(selected.select("name").distinct().withColumn("on", F.lit(True)), "name", "left")
    totals = flagged.rollup("district").agg(
        F.count_if(F.coalesce("on", F.lit(False))).alias("selected"), F.count("*").alias("total"),
        F.grouping("district").alias("is_total"))
    return totals.withColumn(
        "state", F.when(F.col("selected") == 0, "none").when(F.col("selected") == F.col("total"), "all")
        .otherwise("partial"))


def annotate(rows: DataFrame, updates: DataFrame, key: str = "site") -> DataFrame:
    """Apply (site, for_definition, status) updates; NULL parts leave the row as it is.

    Several updates of one site apply in ``seq`` order, field by field.
    """
    last = updates.groupBy(F.trim(F.lower(F.col(key))).alias("k")).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"new_{f}")
          for f in ("for_definition", "status")],
        (F.count("for_definition") + F.count("status")).alias("n_changes"))
    return (
        rows.withColumn("k", F.trim(F.lower(F.col(key)))).join(last, "k", "left")
        .withColumn("for_definition", F.coalesce("new_for_definition", "for_definition"))
        .withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("changes", F.coalesce("n_changes", F.lit(0)))
        .drop("k", "new_for_definition", "new_status", "n_changes")
    )


def annotate_counts(annotated: DataFrame) -> DataFrame:
    """Changed fields, marked rows and all rows."""
    return annotated.agg(
        F.sum("changes").alias("changed"),
        F.count_if(F.coalesce("for_definition", F.lit(False))).alias("marked"),
        F.count("*").alias("n_rows"))


def mark_visible(rows: DataFrame, visible: Column, value: bool = True) -> DataFrame:
    """Set the mark on the visible rows, except excluded ones and aggregators."""
    return rows.withColumn(
        "for_definition",
        F.when(visible & ~_out(), F.lit(value)).otherwise(F.coalesce("for_definition", F.lit(False))))


def clear_marks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("for_definition", F.lit(False))
