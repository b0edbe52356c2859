"""The expressions a SQL user needs, as SQL functions, and the page table function."""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from contactlake.functions.phone import RU, NumberingPlan


def _quote(pattern: str) -> str:
    return "r'" + pattern + "'"


def register(spark: SparkSession, plan: NumberingPlan = RU) -> None:
    """site_host, normalize_phone, phone_type, format_phone; flatten_page as a table function.

    SQL functions are inlined by the optimizer, so they cost what the expression costs.
    """
    c, digits = plan.country, "regexp_replace(raw, '[^0-9]+', '')"
    national = "substring(phone, 2, 10)"
    functions = {
        "site_host(url STRING)": (
            "regexp_replace(lower(if(contains(url, '://'), "
            "regexp_extract(url, r'^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), "
            "regexp_extract(url, r'^([^/?#]*)', 1))), r'^www\\.', '')"),
        "normalize_phone(raw STRING)":
            f"'{c}' || nullif(regexp_extract({digits}, {_quote(plan.allowed)}, 1), '')",
        "phone_type(phone STRING)": (
            f"CASE WHEN phone IS NULL OR NOT phone RLIKE '^{c}[0-9]{{10}}$' THEN 'invalid' "
            f"WHEN {national} RLIKE '{plan.toll_free}' THEN 'excluded' "
            f"WHEN {national} RLIKE '{plan.mobile}' THEN 'mobile' "
            f"WHEN {national} RLIKE '{plan.city}' THEN 'city' ELSE 'invalid' END"),
        "format_phone(raw STRING)": (
            f"coalesce(regexp_replace('{c}' || nullif(regexp_extract({digits}, {_quote(plan.national)}, 1), ''), "
            "r'^(\\d)(\\d{3})(\\d{3})(\\d{2})(\\d{2})$', '+$1 ($2) $3-$4-$5'), raw, '')"),
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}")
    spark.udtf.register("flatten_page", _page_function())


def _page_function():
    from contactlake.operators.flatten import FLAT_COLUMNS, FLAT_SCHEMA, _flatten

    class FlattenPage:
        def eval(self, html: str):
            flat = _flatten(html)
            yield tuple(flat[k] for k in FLAT_COLUMNS)

    return udtf(FlattenPage, returnType=FLAT_SCHEMA)
