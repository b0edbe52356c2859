"""Page snapshots, search responses, briefs, stored runs, legacy sheets, dimensions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake import schemas as S
from contactlake.functions.phone import RU, NumberingPlan, normalize_digits
from contactlake.functions.url import clean_site_input, host
from contactlake.operators.classify import body_usable
from contactlake.session import BROADCAST_MAX_ROWS, spread


# --- page snapshots ------------------------------------------------------------------

def read_pages(spark: SparkSession, path: str, columns: tuple[str, ...] = ("page_id", "url", "html")) -> DataFrame:
    """Usable pages of a parquet snapshot, only the needed columns."""
    df = spread(spark.read.parquet(path))
    status = F.col("status_code") if "status_code" in df.columns else F.lit(None).cast("int")
    return df.where(body_usable(status, F.col("html"))).select(*columns)


# --- search responses ------------------------------------------------------------------

_RESPONSE = "STRUCT<ok: STRING>"
_GROUP = "doc ARRAY<STRUCT<url: STRING, title: STRING, snippet: STRING, passage: STRING>>"


def parse_search_responses(responses: DataFrame, xml: str = "xml", source: str = "search-xml") -> DataFrame:
    """Search response texts -> response rows with ``error`` and ``docs``.

    Each ``group`` element is parsed on its own, wherever it sits.  A response with an
    ``error`` element, or one that is not well formed, carries an error and no documents.
    """
    text = F.coalesce(F.trim(F.col(xml)), F.lit(""))
    error = F.regexp_extract(text, r"(?s)(<error\b[^>]*?(?:/>|>.*?</error>))", 1)
    code = F.trim(F.regexp_extract(error, r"""^<error\b[^>]*?\bcode\s*=\s*["']([^"']*)["']""", 1))
    words = F.trim(F.regexp_extract(error, r"(?s)^<error\b[^>]*>(.*?)</error>$", 1))
    message = F.when((words != "") & (code != ""), F.concat(F.lit("["), code, F.lit("] "), words)).when(
        words != "", words).when(code != "", F.concat(F.lit("["), code, F.lit("]")))
    # the root must be one balanced element: from_xml yields NULL otherwise
    broken = (text != "") & F.from_xml(text, "_corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})[
        "_corrupt"].isNotNull()
    groups = F.regexp_extract_all(text, F.lit(r"(?s)<group\b[^>]*>.*?</group>"), F.lit(0))
    return (
        responses.withColumn("error", F.coalesce(message, F.when(broken, F.lit("malformed xml"))))
        .withColumn("groups", F.when(F.col("error").isNull(), groups))
        .withColumn("source", F.lit(source))
        .drop(xml)
    )


def read_hits(responses: DataFrame, xml: str = "xml", source: str = "search-xml") -> tuple[DataFrame, DataFrame]:
    """(hits, error rows) of a table of search responses.

    Documents without a url or host are dropped; ``passage`` stands in for a missing snippet.
    """
    parsed = parse_search_responses(responses, xml, source)
    keys = [c for c in responses.columns if c != xml]
    doc = (
        parsed.select(*keys, "source", F.posexplode("groups").alias("pos", "g"))
        .withColumn("g", F.from_xml("g", _GROUP))
        .withColumn("d", F.get("g.doc", F.lit(0)))
    )

    def field(name: str) -> Column:
        return F.trim(F.coalesce(F.col("d")[name], F.lit("")))

    hits = (
        doc.select(
            *keys, "source", "pos", field("url").alias("url"), field("title").alias("title"),
            F.coalesce(F.nullif(field("snippet"), F.lit("")), field("passage")).alias("snippet"))
        .withColumn("domain", host(F.col("url")))
        .where((F.col("url") != "") & (F.col("domain") != ""))
    )
    return hits, parsed.where(F.col("error").isNotNull()).select(*keys, "error")


# --- briefs ---------------------------------------------------------------------------------

_ENTRY = (
    r"(?m)^[ \t]*([^#:\n][^:\n]*?)[ \t]*:[ \t]*"
    r"(?:\n[ \t]*---[ \t]*\n((?s:.*?))(?:\n?^[ \t]*---[ \t]*$|\z)|([^\n]*)$)"
)
BRIEF_DEFAULTS = {
    "operatorName": "", "clientName": "", "niche": "", "regionMode": "include", "regions": "",
    "queries": "", "excludeDomains": "", "phoneFilter": "business", "seedDomains": "",
}

_TYPED_FIELDS = ("clientSite", "sources", "checkAlive", "maxSites", "crawlDepth", "requestDelayMs", "useProxy", "quickCrawl")


def parse_briefs(files: DataFrame, text: str = "value") -> DataFrame:
    """Brief texts (labelled lines with fenced blocks, or JSON) -> one typed ``brief`` struct."""
    raw = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"^\x{FEFF}", "")
    is_json = F.trim("_raw").startswith("{")
    # each entry is matched once for its label and once for either form of its value, never again by itself
    label, fenced, line = (F.regexp_extract_all("_raw", F.lit(_ENTRY), F.lit(k)) for k in (1, 2, 3))
    field_of = {f.lower(): f for f in (*BRIEF_DEFAULTS, *_TYPED_FIELDS)} | {k.lower(): f for k, f in V.BRIEF_LABELS.items()}
    named = F.create_map(*[F.lit(x) for kv in field_of.items() for x in kv])
    fields = F.transform(label, lambda k: F.coalesce(F.element_at(named, F.lower(k)), F.lit("")))
    values = F.zip_with(fenced, line, lambda a, b: F.trim(F.concat(a, b)))

    def given(field: str) -> Column:
        """The last value given; both arrays stand in reverse."""
        return F.get("_values", (F.array_position("_fields", F.lit(field)) - 1).cast("int"))

    def flag(field: str, default: bool) -> Column:
        low = F.lower(given(field))
        return F.when(low.isin(*V.YES_WORDS), True).when(low.isin(*V.NO_WORDS), False).otherwise(default)

    def number(field: str, default: int) -> Column:
        return F.coalesce(given(field).try_cast("int"), F.lit(default))

    wanted = F.filter(F.split(given("sources"), r"[,;\s]+"), lambda s: s != "")
    default_sources = F.array(F.lit("serp"), F.lit("site"), F.lit("catalog"))
    from_text = F.struct(
        *[F.coalesce(given(f), F.lit(d)).alias(f) for f, d in BRIEF_DEFAULTS.items()],
        given("clientSite").alias("clientSite"),
        F.coalesce(wanted, default_sources).alias("sources"),
        flag("checkAlive", True).alias("checkAlive"), number("maxSites", 50).alias("maxSites"),
        number("crawlDepth", 2).alias("crawlDepth"), number("requestDelayMs", 500).alias("requestDelayMs"),
        flag("useProxy", False).alias("useProxy"), flag("quickCrawl", False).alias("quickCrawl"))
    nested = F.from_json("_raw", f"STRUCT<brief: STRUCT<{S.BRIEF_FIELDS}>>")["brief"]
    flat = F.from_json("_raw", f"STRUCT<{S.BRIEF_FIELDS}>")
    j = F.coalesce(nested, flat)
    defaults = {"checkAlive": True, "maxSites": 50, "crawlDepth": 2, "requestDelayMs": 500,
                "useProxy": False, "quickCrawl": False}
    from_json = F.struct(
        *[F.coalesce(F.col("_json")[f], F.lit(d)).alias(f) for f, d in BRIEF_DEFAULTS.items()],
        F.col("_json")["clientSite"].alias("clientSite"),
        F.coalesce(F.col("_json")["sources"], default_sources).alias("sources"),
        *[F.coalesce(F.col("_json")[f], F.lit(d)).alias(f) for f, d in defaults.items()])
    keys = [c for c in files.columns if c != text]
    return (
        files.withColumn("_raw", raw).withColumn("_fields", F.reverse(fields)).withColumn("_values", F.reverse(values))
        .withColumn("_json", F.when(is_json, j))
        .withColumn("brief", F.when(is_json, from_json).otherwise(from_text))
        .withColumn("brief", F.col("brief").withField("clientSite", clean_site_input(F.col("brief.clientSite"))))
        .select(*keys, "brief")
    )


def read_briefs(spark: SparkSession, path: str) -> DataFrame:
    return parse_briefs(
        spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name")))


# --- stored runs -------------------------------------------------------------------------------

def decode_runs(raw: DataFrame) -> DataFrame:
    """JSON text columns of the run table -> structs; missing JSON reads as empty."""
    return raw.select(
        "id", "status",
        F.from_json("brief_json", f"STRUCT<{S.BRIEF_FIELDS}>").alias("brief"),
        F.from_json(F.coalesce("pipeline_json", F.lit("{}")), f"STRUCT<{S.PIPELINE_FIELDS}>").alias("pipeline"),
        F.from_json(F.coalesce("results_json", F.lit("[]")), f"ARRAY<STRUCT<{S.LEAD_FIELDS}>>").alias("results"),
        "error", (F.coalesce("is_demo", F.lit(0)) != 0).alias("is_demo"),
        F.try_to_timestamp("created_at").alias("created_at"), F.try_to_timestamp("updated_at").alias("updated_at"),
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return decode_runs(spark.read.schema(S.RUNS_RAW).parquet(path))


def run_results(runs: DataFrame) -> DataFrame:
    """One row per stored result."""
    return runs.select(
        F.col("id").alias("run_id"), F.posexplode("results").alias("ord", "r")
    ).select("run_id", "ord", "r.*")


# --- legacy sheets ------------------------------------------------------------------------------

def legacy_rows(rows: DataFrame, cells: str = "cells", plan: NumberingPlan = RU) -> DataFrame:
    """Six-cell rows of an old export -> site, name, region, phones, source, status.

    The contact cell holds 11-digit runs; when none fits, the whole cell is tried.
    """
    def cell(i: int) -> Column:
        return F.coalesce(F.get(F.col(cells), F.lit(i)), F.lit(""))

    runs = F.transform(
        F.regexp_extract_all(cell(3), F.lit(r"([0-9]{11})"), F.lit(1)), lambda r: normalize_digits(r, plan))
    found = F.array_distinct(F.filter(runs, lambda p: p.isNotNull()))
    whole = F.filter(F.array(normalize_digits(cell(3), plan)), lambda p: p.isNotNull())
    keys = [c for c in rows.columns if c != cells]
    return rows.select(
        *keys, cell(0).alias("site"), cell(1).alias("name"), cell(2).alias("region"),
        F.when(F.size(found) > 0, found).otherwise(whole).alias("phones"),
        cell(4).alias("source"), cell(5).alias("status"))


def read_legacy_sheet(spark: SparkSession, path: str, plan: NumberingPlan = RU) -> DataFrame:
    """SpreadsheetML file(s); the header row is recognised by its first cell."""
    raw = spark.read.schema("Cell ARRAY<STRUCT<Data: STRING>>").format("xml").option("rowTag", "Row").load(path)
    cells = raw.select(F.transform("Cell", lambda c: c["Data"]).alias("cells"))
    return legacy_rows(
        cells.where(F.coalesce(F.get("cells", F.lit(0)), F.lit("")) != V.EXPORT_HEAD[0]), plan=plan)


# --- dimensions -----------------------------------------------------------------------------------

def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Packaged list as a table; broadcast only while its known size allows it."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_MAX_ROWS else df


def region_label(name: str) -> str:
    return V.REGION_LABELS.get(name, name.replace(" область", " обл."))


def regions(spark: SparkSession) -> DataFrame:
    ordered = sorted((name, d[0], d[1], d[2]) for d in V.DISTRICTS for name in d[3])
    return dimension(spark, [
        (name, i, did, dname, short, region_label(name), list(V.REGION_ALIASES.get(name.lower(), ())))
        for i, (name, did, dname, short) in enumerate(ordered)
    ], S.REGIONS)


def domain_lexicon(spark: SparkSession) -> DataFrame:
    lists = {"aggregator": V.AGGREGATOR_DOMAINS, "catalog": V.CATALOG_DOMAINS, "junk": V.JUNK_DOMAINS,
             "exclude": V.STANDARD_EXCLUDE, "seed": V.SEED_DOMAINS}
    return dimension(spark, [(k, d) for k, ds in lists.items() for d in ds], "kind STRING, domain STRING")


def term_lexicon(spark: SparkSession) -> DataFrame:
    rows = [("model", m, t, i) for m, ts in V.MODEL_SIGNALS for i, t in enumerate(ts)]
    rows += [("synonym", n, t, i) for n, ts in V.QUERY_SYNONYMS for i, t in enumerate(ts)]
    rows += [("audience", g, t, i) for g, ts in (("b2b", V.B2B_SIGNALS), ("b2c", V.B2C_SIGNALS))
             for i, t in enumerate(ts)]
    rows += [("city", label, t, i) for i, (t, label) in enumerate(V.GEO_CITIES)]
    return dimension(spark, rows, "kind STRING, group STRING, term STRING, ord INT")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
